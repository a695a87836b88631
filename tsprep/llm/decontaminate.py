"""Benchmark decontamination by templates.

Words of benchmark items and documents are canonicalised: lower-case without the signs around them, with numbers, units
and names (capitalised within a sentence) replaced by typed placeholders, so that a question whose figures
or names have been changed keeps its template. As capitals tell names only in ordinary writing, a second template leaves
names as lower-case words: it finds items in documents of other letter case. In a third one names are names at the start of a
sentence too, so that an item's first word may change wherever a copy stands; a fourth has all words as they are, lower-case,
and finds verbatim copies however few of their words are literal. Windows of template words are hashed; the items' windows are the build side
of a hash join that each document's windows probe. A hit is checked word by word. Windows at one alignment of item and document
are checked together for slot consistency: one value of the item always becomes one value of the document, and no two the same;
where that fails, only the alignment's windows that are equal word by word count. A document
is contaminated by an item if what counts covers `min_covered` of the item's words, or the whole of a shorter item. A slot is
changed where no alignment leaves its word as it was.

The build side is bounded: a benchmark of more than `max_build_words` words is split by a hash of its items into blocks
that are probed one after the other, each exactly.

Defined results: null or empty texts and items match nothing. Whole items are found word by word from `min_verbatim_words` words
on (all, unless told otherwise); items with under `min_words` words, and windows with fewer than half their words literal, are found in no other way, as their
templates would hit clean documents. Repeated items and
rows each count. A document is reported once for each item that contaminates it. Ids may be of any type that can be sorted.
"""

from __future__ import annotations

import math
import pickle
import re
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, rows_map, slices

WINDOW, MIN_WORDS, MIN_VERBATIM_WORDS, MIN_COVERED, MAX_BUILD_WORDS = 8, 4, 1, 13, 2_000_000
#: Words that a worker keeps at most.
LEXICON = 500_000
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Unit words and number words, lower-case.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres "
    "centimeter centimeters centimetre centimetres usd eur dollar dollars cent cents euro euros percent mph kph hz khz mhz ghz kb mb gb tb w kw mw v a j kj cal kcal".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:%|°|[a-zµ]{1,3})?")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = np.array([0, *(xxhash.xxh64_intdigest(name) for name in ("<number>", "<unit>", "<name>"))], np.uint64)


class Lexicon(dict):
    """Word -> number; by number: the literal's hash, the kind it has within a sentence, whether a sentence ends with it."""

    def __init__(self):
        super().__init__()
        self._new: list[tuple[int, int, bool]] = []
        self.hash, self.kind, self.ends = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        bare = _EDGES.sub("", word)
        low = bare.lower()
        if low in NUMBER_WORDS or _NUMBER.fullmatch(low):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif bare[:1].isupper():
            kind = NAME
        else:
            kind = LITERAL
        self._new.append((xxhash.xxh64_intdigest((low or word).encode("utf-8", "surrogatepass")), kind, word[-1] in ".!?:"))
        self[word] = n = len(self)
        return n

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self) > LEXICON:
            self.clear()
            self.__init__()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self._new:
            h, k, e = zip(*self._new, strict=True)
            self.hash = np.concatenate([self.hash, np.array(h, np.uint64)])
            self.kind = np.concatenate([self.kind, np.array(k, np.uint8)])
            self.ends = np.concatenate([self.ends, np.array(e, bool)])
            self._new = []
        return found

    def templates(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts in a row: kinds of each template (names within sentences, no names, names anywhere, all words as they are), literal hashes, kinds that words have within a sentence; and where each text begins, with the end."""
        words = [t.split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = self.look_up([w for ws in words for w in ws])
        literal, kind, ends = self.hash[at], self.kind[at], self.ends[at]
        first = np.zeros(len(at), bool)
        first[1:] = ends[:-1]
        first[bounds[:-1][sizes > 0]] = True
        named = np.where((kind == NAME) & first, LITERAL, kind)
        caseless = np.where(kind == NAME, LITERAL, kind)
        return [named, caseless, kind, np.zeros(len(at), np.uint8)], literal, kind, bounds


def _codes(kind: np.ndarray, literal: np.ndarray) -> np.ndarray:
    return np.where(kind == LITERAL, literal, _CODES[kind])


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = codes[:n].copy()
    for j in range(1, size):
        total *= _BASE
        total += codes[j : n + j]
    return total ^ (total >> np.uint64(29))


class Windows:
    """The items' windows by hash, and their templates."""

    def __init__(self, items: list[tuple[Any, str | None]], window: int = WINDOW, min_words: int = MIN_WORDS, min_verbatim_words: int = MIN_VERBATIM_WORDS, min_covered: int = MIN_COVERED):
        self.min_covered = min_covered
        self.ids = [i for i, _ in items]
        kinds, self.literal, self.kind, self.bounds = Lexicon().templates(["" if t is None else t for _, t in items])
        self.codes = [_codes(k, self.literal) for k in kinds]
        sizes = np.diff(self.bounds)
        self.sizes = sorted({min(window, int(n)) for n in sizes if n >= max(1, min_verbatim_words)})
        self.tables = []
        for size in self.sizes:
            tables = []
            for kind, code, least in zip(kinds, self.codes, (min_words, min_words, min_words, min_verbatim_words), strict=True):
                hashes = window_hashes(code, size)
                item = np.repeat(np.arange(len(items)), sizes)[: len(hashes)]
                at = np.arange(len(hashes))
                literals = np.concatenate([[0], np.cumsum(kind == LITERAL)])
                fine = (at + size <= self.bounds[item + 1]) & (np.minimum(window, sizes[item]) == size) & (sizes[item] >= least) & (2 * (literals[at + size] - literals[at]) >= size)
                at, hashes, item = at[fine], hashes[fine], item[fine]
                order = np.argsort(hashes, kind="stable")
                sieve = np.zeros(1 << 20, bool)
                sieve[(hashes >> np.uint64(44)).astype(np.int64)] = True
                tables.append((hashes[order], at[order].astype(np.int32), item[order].astype(np.int32), sieve))
            self.tables.append((size, tables))

    def matches(self, lexicon: Lexicon, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, words covered, slots changed) for each text and item that contaminates it."""
        kinds, literal, _, bounds = lexicon.templates(texts)
        codes = [_codes(k, literal) for k in kinds]
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        hits: dict[tuple[int, int], set[tuple[int, int, int]]] = {}
        for size, tables in self.tables:
            for code, own_code, (hashes, places, items, sieve) in zip(codes, self.codes, tables, strict=True):
                own = window_hashes(code, size)
                at = np.flatnonzero(sieve[(own >> np.uint64(44)).astype(np.int64)])
                at = at[at + size <= bounds[of[at] + 1]]
                low, high = np.searchsorted(hashes, own[at]), np.searchsorted(hashes, own[at], side="right")
                for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    for k in range(a, b):
                        q = int(places[k])
                        if (code[p : p + size] == own_code[q : q + size]).all():
                            hits.setdefault((int(of[p]), int(items[k])), set()).add((p - q, q, size))
        found = []
        for (text, item), own in hits.items():
            covered, changed = self._consistent(sorted(own), literal)
            if covered >= min(self.min_covered, int(self.bounds[item + 1] - self.bounds[item])):
                found.append((text, item, covered, changed))
        return sorted(found)

    def _consistent(self, hits: list[tuple[int, int, int]], literal: np.ndarray) -> tuple[int, int]:
        """How many of the item's words count at any shift (document place - item place), and how many of them are the same at none. hits are sorted."""
        covered: set[int] = set()
        kept: set[int] = set()
        for shift, windows in groupby(hits, itemgetter(0)):
            alike: set[int] = set()
            other: set[int] = set()
            for _, q, size in windows:
                here = range(q, q + size)
                (alike if (self.literal[q : q + size] == literal[q + shift : q + shift + size]).all() else other).update(here)
            if other:
                pairs = {(int(self.literal[j]), int(literal[j + shift])) for j in alike | other if self.kind[j] != LITERAL}
                if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                    alike |= other
            covered |= alike
            kept |= {j for j in alike if self.literal[j] == literal[j + shift]}
        return len(covered), len(covered - kept)


def _blocks(benchmark: DataFrame, item_id: str, text: str, max_build_words: int, limits: dict[str, int]):
    """Windows of the benchmark's items, a bounded block at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    words = rows.agg(F.sum(F.octet_length("text") / 5 + 1)).first()[0] or 0
    n = max(1, math.ceil(words / max_build_words))
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Windows([(r.item_id, r.text) for r in block.orderBy("item_id", "text").toLocalIterator()], **limits)


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_build_words: int = MAX_BUILD_WORDS, **limits: int) -> DataFrame:
    """doc_id, item_id, covered, item_words, changed_slots: a row for each document and item that contaminates it. limits: those of Windows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = benchmark.schema[item_id].dataType
    counts = ("covered", "item_words", "changed_slots")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", item_type), *(T.StructField(c, T.IntegerType()) for c in counts)])
    kind = to_arrow_type(item_type)
    rows, out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), None
    for windows in _blocks(benchmark, item_id, item_text, max_build_words, limits):

        def work(batches, shared=docs.sparkSession.sparkContext.broadcast(pickle.dumps(windows))):
            own, lexicon = pickle.loads(shared.value), Lexicon()
            for batch in slices(batches, "text", rows=512, max_bytes=4 << 20):
                found = own.matches(lexicon, ["" if t is None else t for t in batch.column("text").to_pylist()])
                if found:
                    at, item, covered, changed = zip(*found, strict=True)
                    words = np.diff(own.bounds)[list(item)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array([own.ids[i] for i in item], kind), *(pa.array(c, pa.int32()) for c in (covered, words, changed))], ["doc_id", "item_id", *counts])

        part = arrow_map(rows, work, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_build_words: int = MAX_BUILD_WORDS, **limits: int) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates. limits: those of Windows."""
    own_schema = docs.schema
    at = docs.columns.index(text)
    for windows in _blocks(benchmark, item_id, item_text, max_build_words, limits):

        def work(batches, shared=docs.sparkSession.sparkContext.broadcast(pickle.dumps(windows))):
            import pyarrow as pa

            own, lexicon = pickle.loads(shared.value), Lexicon()
            for batch in slices(batches, at, rows=512, max_bytes=4 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in own.matches(lexicon, ["" if t is None else t for t in batch.column(at).to_pylist()])]] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, own_schema.names)

        docs = rows_map(docs, work, own_schema)
    return docs
