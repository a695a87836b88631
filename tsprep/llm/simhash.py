"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint is cut into three segments of 23, 23 and 18 bits. The binary Golay code [23,12,7] is perfect, so
each 23-bit word lies within 3 bits of just one codeword, whose 12 message bits are its index. A segment's
keys are the indices of all words within one bit of it (one key, or six). Two segments at two bits or less
have a word within one bit of both, so they share a key. Of 4 differing bits over three segments, at least two
segments have two or less each: fingerprints that link share a key made of two segments' indices. Rows
that share a key are compared by all 64 bits, so the links are exact.

Within a key, only the edges of a spanning forest are kept: a fingerprint that has been reached is compared no
more, which makes dense groups cheap. A full key is split by what its fingerprints must share besides (see `sub_keys`),
so that chance meetings stay few. A key with more fingerprints than `hot_group` streams past without being held:
its fingerprints go through midpoints instead (all words within two bits of each, joined to the least
fingerprint at the same midpoint), which is exact and linear in their number.

Defined results: a null text counts as empty, with fingerprint zero; documents of equal fingerprints link;
rows with a null id take part and get the least non-null id of their group (null if there is none).
Columns other than id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, group_bounds, materialised, partitions, record_batch, slices
from .graph import components

SEED, MAX_BITS = 42, 4
#: Fixed value: the generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: (lowest bit, width) of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of a key beyond which it is split by what its other bits must share, and beyond which it is not held.
FULL_GROUP, HOT_GROUP = 1024, 500_000

_SPREAD = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each run of so many words; of the whole sequence if it has fewer; none if it has none."""
    found = ("" if text is None else text).encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return [digest(joined, SEED)]
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def vote(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of so many hashes: the bits set in over half of them; zero where there are none.

    Each hash's bits are spread over 64 one-byte counters held in eight 64-bit words, 255 hashes at most to a
    block, and the blocks' counters are added up."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    sizes = sizes[some]
    blocks = -(-sizes // 255)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begins = np.append(np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * 255, len(hashes))
    counts = np.empty((len(nth), 64), np.uint8)
    for k in range(0, len(nth), 1024):
        ends = begins[k : k + 1025]
        lanes = _SPREAD[hashes[ends[0] : ends[-1]].view(np.uint8).reshape(-1, 8)]
        counts[k : k + 1024] = np.add.reduceat(lanes, ends[:-1] - ends[0], axis=0).view(np.uint8).reshape(-1, 64)
    totals = np.add.reduceat(counts, np.cumsum(blocks) - blocks, axis=0, dtype=np.int64)
    out[some] = np.packbits(totals * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _hashed(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    found = [np.array(shingle_hashes(t, words), np.uint64) for t in texts]
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.array([len(f) for f in found], np.int64)


def fingerprints(texts: list[str | None], words: int) -> np.ndarray:
    return vote(*_hashed(texts, words))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for each row."""

    def work(batches):
        for batch in slices(batches, "text", rows=512, max_bytes=4 << 20):
            found = fingerprints(batch.column("text").to_pylist(), words)
            yield record_batch(doc_id=batch.column("doc_id"), fp=found.view(np.int64))

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])
    return arrow_map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), work, schema)


class Golay:
    """Syndromes and the nearest codeword's index of 23-bit words, by tables made from the generator."""

    def __init__(self):
        def rest(word: int) -> int:
            for k in range(22, 10, -1):
                if word >> k & 1:
                    word ^= GENERATOR << (k - 11)
            return word

        self.low = np.array([rest(w) for w in range(1 << 12)], np.int64)
        self.high = np.array([rest(w << 12) for w in range(1 << 11)], np.int64)
        self.leader = np.zeros(1 << 11, np.int64)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self.leader[rest(word)] = word

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.leader[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11

    def keys(self, words: np.ndarray, width: int) -> list[np.ndarray]:
        """Columns of indices of the words within one bit; -1 in the place of one that came before."""
        found = np.stack([self.index(words ^ e) for e in [0, *(1 << b for b in range(width))]], 1)
        found.sort(1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found = -np.sort(-found, 1)
        return [found[:, k] for k in range(found.shape[1]) if (found[:, k] >= 0).any()]


def fuzzy_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) rows: for each pair of segments, the product of their indices."""
    words = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    own = [golay.keys(w, width) for w, (_, width) in zip(words, SEGMENTS, strict=True)]
    keys, at = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        for a in own[i]:
            for b in own[j]:
                both = np.flatnonzero((a >= 0) & (b >= 0))
                keys.append((pair << 24) | (a[both] << 12) | b[both])
                at.append(both)
    return np.concatenate(keys), np.concatenate(at)


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what is connected among fps; each is compared only with those not reached yet."""
    rest, edges = fps, []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            here = frontier.pop()
            near = np.bitwise_count(rest ^ here) <= max_bits
            if near.any():
                reached, rest = rest[near], rest[~near]
                edges.append((np.full(len(reached), here), reached))
                frontier.extend(reached)
    return edges


def sub_keys(fps: np.ndarray, key: int, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(sub-key, position) rows that split a full key's fingerprints.

    Of two that link, take the segment that differs most. If it does by two bits at most, they share an index of it; else
    the key's two segments differ by one bit in all, so one of them is the same. Each such pair meets under
    the key of the other two segments."""
    i, j = list(combinations(range(len(SEGMENTS)), 2))[key >> 24]
    words = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    k = 3 - i - j
    indices = golay.keys(words[k], SEGMENTS[k][1])
    keys, at = [words[i] | 1 << 32, words[j] | 2 << 32], [np.arange(len(fps))] * 2
    for column in indices:
        some = np.flatnonzero(column >= 0)
        keys.append(column[some])
        at.append(some)
    return np.concatenate(keys), np.concatenate(at)


def links_by_key(keys: np.ndarray, fps: np.ndarray, max_bits: int, golay: Golay, dense: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Edges between fingerprints with equal keys; keys come sorted."""
    bounds = group_bounds(keys)
    sizes = np.diff(bounds)
    left, right = [], []
    for k in np.flatnonzero(sizes > dense):
        own = np.unique(fps[bounds[k] : bounds[k + 1]])
        parts = [own]
        if len(own) > FULL_GROUP:
            sub, at = sub_keys(own, int(keys[bounds[k]]), golay)
            order = np.argsort(sub, kind="stable")
            ends = group_bounds(sub[order])
            parts = [own[at[order[a:b]]] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) if b - a > 1]
        for part in parts:
            for a, b in forest(part, max_bits):
                left.append(a)
                right.append(b)
    ends = np.repeat(bounds[1:], sizes)
    at = np.flatnonzero(np.repeat(sizes <= dense, sizes))
    for step in range(1, dense):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        left.append(fps[near])
        right.append(fps[near + step])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    edges = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    return edges[:, 0], edges[:, 1]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _keyed(batches):
    """Distinct fingerprints with a row for each fuzzy key."""
    golay = Golay()
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            fps = _column(batch.slice(at, 8192), "fp")
            key, k = fuzzy_keys(fps, golay)
            yield record_batch(key=key, fp=fps[k].view(np.int64))


def _linked(max_bits: int, hot_group: int):
    """Rows sorted by key -> edges; of keys with more rows than hot_group the fingerprints themselves (b null)."""

    def emit(a, b=None):
        b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), b], ["a", "b"])

    def work(batches):
        golay = Golay()
        keys, fps, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k, x = batch.column("key").to_numpy(zero_copy_only=False), _column(batch, "fp")
            if hot is not None:
                n = int(np.searchsorted(k, hot, side="right"))
                if n:
                    yield emit(x[:n])
                k, x = k[n:], x[n:]
                if not len(k):
                    continue
                hot = None
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, x])
            if not len(keys):
                continue
            tail = int(np.searchsorted(keys, keys[-1]))
            if tail:
                yield emit(*links_by_key(keys[:tail], fps[:tail], max_bits, golay))
                keys, fps = keys[tail:], fps[tail:]
            if len(keys) > hot_group:
                yield emit(fps)
                hot, keys, fps = int(keys[-1]), keys[:0], fps[:0]
        if len(keys):
            yield emit(*links_by_key(keys, fps, max_bits, golay))

    return work


def _midpoints(reach: int):
    near = [0, *(sum(1 << b for b in bits) for n in range(1, reach + 1) for bits in combinations(range(64), n))]
    masks = np.array(near, np.uint64)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                fps = batch.column("fp").slice(at, 256).to_numpy(zero_copy_only=False).view(np.uint64)
                yield record_batch(mid=(fps[:, None] ^ masks).ravel().view(np.int64), fp=np.repeat(fps, len(masks)).view(np.int64))

    return work


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot_group: int = HOT_GROUP) -> DataFrame:
    """Edges (a, b) that connect just what the links at max_bits or less connect. fps: distinct, column fp."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"three Golay segments find links of up to {MAX_BITS} bits")
    keyed = arrow_map(fps, _keyed, "key long, fp long")
    found = keyed.repartition(partitions(fps, 4 << 20), "key").sortWithinPartitions("key", "fp")
    found = materialised(arrow_map(found, _linked(max_bits, hot_group), "a long, b long"))
    edges = found.where("b IS NOT NULL")
    hot = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return edges
    mids = arrow_map(materialised(hot), _midpoints(max_bits // 2), "mid long, fp long")
    least = mids.groupBy("mid").agg(F.min("fp").alias("b"))
    return edges.unionByName(mids.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def _with_components(rows: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    roots = components(edges)
    # Written before they are joined with each other, so that a component with very many fingerprints can be split.
    by_fp = materialised(ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = materialised(by_fp.groupBy("root").agg(F.min("least_id").alias("component_id")))
    return rows.join(by_fp.select("fp", "root").join(least, "root").drop("root"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = MAX_BITS, hot_group: int = HOT_GROUP) -> DataFrame:
    """doc_id, fp, component_id (least id of those that links reach) for each row; links are exact."""
    rows = materialised(fingerprint(docs, doc_id, text, words))
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    return _with_components(rows, ids, links(ids.select("fp"), max_bits, hot_group))
