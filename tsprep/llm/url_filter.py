"""URL rules in a sorted digest array.

A rule is a host and the beginning of a path, written together (`example.net/en/`); it fits the host, all its
subdomains, and every path that starts with its own. Each rule has a 64-bit XXH64 key; the keys lie sorted in a
file that workers map into memory, beside the rules' full strings. A url is judged by probing the keys of each
(host suffix at a label's start, path prefix of a length that some rule has) with a vectorised binary search;
a hit counts only if the stored string is the probed one. The longest rule that fits wins (by characters; of equal
ones that with the longer host).

An index holds `max_rules` at most, so what the driver holds and sends to the executors is bounded; longer lists, which may be a
table, are split into blocks by a hash, one block is an index at a time, and the longest rule found so far is kept. A worker
writes and maps an index's file once, in its own temporary folder, and keeps it from task to task.

Defined results: a null url, or one without `://`, has an empty host and path, and no rule; a url
that no rule fits gets the default verdict. A rule listed twice must have one action, else ValueError.
Columns other than the id and the url are ignored.
"""

from __future__ import annotations

import math
import mmap
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialised, record_batch

MAX_RULES = 2_000_000
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """Sorted 64-bit keys with the strings that they stand for."""

    def __init__(self, strings: Iterable[str], values: Iterable[int]):
        given = dict(zip(strings, values, strict=True))
        keys = np.fromiter((xxhash.xxh64_intdigest(s.encode()) for s in given), np.uint64, len(given))
        order = np.argsort(keys, kind="stable")
        names = list(given)
        texts = [names[k].encode() for k in order]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        marks = np.fromiter(given.values(), np.uint8, len(given))[order]
        self.n = len(given)
        self.image = keys[order].tobytes() + offsets.tobytes() + marks.tobytes() + b"".join(texts)

    def __getstate__(self):
        return {"n": self.n, "image": self.image}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def mapped(self) -> DigestArray:
        """The same, its arrays in a file mapped into memory; the file goes with the process."""
        if hasattr(self, "keys"):
            return self
        with tempfile.TemporaryFile() as file:
            file.write(self.image)
            file.flush()
            view = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)) if self.image else memoryview(b"")
        self.image = b""
        n = self.n
        self.keys = np.frombuffer(view, np.uint64, n)
        self.offsets = np.frombuffer(view, np.int64, n + 1, 8 * n)
        self.values = np.frombuffer(view, np.uint8, n, 16 * n + 8)
        self.texts = view[17 * n + 8 :]
        return self

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Where each probe is stored; -1 where it is not. Equal keys of different strings lie side by side."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(probes), -1, np.int64)
        for k in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == keys)) if self.n else ():
            j = int(at[k])
            while j < self.n and self.keys[j] == keys[k]:
                if self.texts[self.offsets[j] : self.offsets[j + 1]] == probes[k]:
                    found[k] = j
                    break
                j += 1
        return found


def _suffixes(host: str) -> list[str]:
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def _index(rules: list[tuple[str, str]]) -> tuple[DigestArray, list[int]]:
    lengths = sorted({len(rule) - rule.index("/") for rule, _ in rules})
    return DigestArray((rule for rule, _ in rules), (int(action == BLOCK) for _, action in rules)), lengths


def _blocks(rules: Iterable[tuple[str, str]] | DataFrame, max_rules: int) -> Iterator[list[tuple[str, str]]]:
    """The distinct rules, so many at a time; of a table only a block is on the driver."""
    if not isinstance(rules, DataFrame):
        known: dict[str, str] = {}
        for rule, action in rules:
            if action not in (ALLOW, BLOCK) or "/" not in rule or known.setdefault(rule, action) != action:
                raise ValueError(f"not one rule with one action: {rule!r}, {action!r}")
        listed = sorted(known.items(), key=lambda r: xxhash.xxh64_intdigest(r[0].encode()))
        yield from [listed[k : k + max_rules] for k in range(0, len(listed), max_rules)] or [[]]
        return
    table = rules.select(F.col(rules.columns[0]).alias("rule"), F.col(rules.columns[1]).alias("action")).distinct()
    wrong = table.groupBy("rule").agg(F.count("*").alias("n"), F.min("action").alias("action")).where(f"n > 1 OR rule IS NULL OR NOT contains(rule, '/') OR action IS NULL OR action NOT IN ('{ALLOW}', '{BLOCK}')")
    if (bad := wrong.first()) is not None:
        raise ValueError(f"not one rule with one action: {bad.rule!r}")
    n = max(1, math.ceil(1.1 * table.count() / max_rules))
    for k in range(n):
        yield [(r.rule, r.action) for r in table.where(F.pmod(F.xxhash64("rule"), F.lit(n)) == k).toLocalIterator()]


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] | DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW, max_rules: int = MAX_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row; rules: (host and path, action) pairs, or a table of two such columns."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    schema = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), *(T.StructField(c, T.StringType()) for c in rows.columns[1:])])
    before = None
    for block in _blocks(rules, max_rules):
        if before is not None:
            rows = materialised(rows)
            before.destroy()
        index, lengths = _index(block)
        before = spark.sparkContext.broadcast(index)
        rows = arrow_map(rows, _probe(before, lengths), schema)
    return rows


def _probe(shared, lengths: list[int]):
    def work(batches):
        index = shared.value.mapped()
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = batch.column("rule").to_pylist(), batch.column("verdict").to_pylist()
            probes, of = [], []
            for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                ends = [path[:n].encode() for n in lengths if n <= len(path)]
                for suffix in _suffixes(host) if ends else ():
                    for end in ends:
                        probes.append(suffix.encode() + end)
                        of.append(k)
            found = index.find(probes)
            for p in np.flatnonzero(found >= 0):
                k, text = of[p], probes[p].decode()
                if rule[k] is None or _rank(text) > _rank(rule[k]):
                    rule[k], verdict[k] = text, BLOCK if index.values[found[p]] else ALLOW
            yield record_batch(page_id=batch.column("page_id"), host=hosts, path=paths, rule=_strings(rule), verdict=verdict)

    return work


def _rank(rule: str) -> tuple[int, int]:
    return len(rule), rule.index("/")


def _strings(values):
    import pyarrow as pa

    return pa.array(values, pa.string())
