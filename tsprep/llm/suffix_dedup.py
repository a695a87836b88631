"""Removal of repeated byte strings across a corpus by blockwise suffix sorting.

A byte goes if a string of `length` bytes that covers it also starts earlier: in a document of smaller id, or further
to the front of the same one. Sorting the suffixes of all documents at once would hold the corpus many times over; here
they are sorted a bucket at a time, and only those that can have an equal at all:

1. Each start of a string belongs to an anchor, the leftmost place of least hash among the string's runs of KGRAM
   bytes. Equal strings have equal anchors at equal places, so the anchor's run is the bucket of the suffix.
   Successive starts with one anchor make one record (bucket, digest of the bytes they span, document, place). Equal spans
   would lie side by side in the suffix order, so each enters the sort once: records that span the same bytes are
   collapsed to the first, within a task before the shuffle and then within the bucket, and the others' strings
   are repeats. Buckets with a single kind of span are then sorted already.
2. The spans left are fetched and gathered by bucket. Buckets are suffix-sorted a bounded block at a time, with
   ties of the first bytes resolved by the ranks of a difference cover's sample (see suffixes.py). In each run of suffixes
   that agree in `length` bytes all but the earliest are repeats. Buckets with very many spans are split beforehand by
   the bytes that all strings of a few neighbouring starts share.
3. Each document's repeated ranges meet its text.

Hot anchors: a task that holds more than `hot_records` different spans of one key deals these records over all parts by
their digests and leaves a mark at the key's own part, so that no part takes all of a passage's edges. Such a bucket is split
into single strings, of which a task sends equal ones once.

Shuffled arrays travel as one binary value for each task and partition, and the number of partitions follows the input.
Spans are the same where 128 bits of their SHA-256 are; what suffix sorting finds is compared byte by byte.

Defined results: a null text is empty. Rows with a null id come before all others, rows that share an id are documents of
their own in the order of their texts' hashes (rows equal in both: in some order). All columns of the input are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_PARTITIONS, arrow_map, by_part, each_part, materialised, parts_of, whole_row
from .suffixes import PERIOD, CoverSample

LENGTH, KGRAM = 100, 32
#: Bytes of a text that make a piece, bytes of pieces hashed at once (one piece at least), records held by a task before they are
#: sent, bytes of spans sorted at once. Hashing and sorting hold many times these bytes.
PIECE, HASHED, HELD, BLOCK = 1 << 20, 1 << 18, 1 << 19, 1 << 19
#: Spans of a bucket beyond which it is split, and the starts that share a part's key.
HOT_BUCKET, STEP = 4096, 8
#: Different spans of one key in a task's batch of records beyond which they are dealt over all parts.
HOT_RECORDS = 1024
PART_BYTES = 12 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_RECORD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("span", "<u8"), ("span2", "<u8"), ("at", "<u4"), ("before", "u1"), ("after", "u1")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def long_hash(values: np.ndarray) -> np.ndarray:
    """XXH64 of each long with seed 42, as Spark's xxhash64 gives it. The algorithm's five primes."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(len(values), 42 + 8, np.uint64) + p5
    h ^= turn(values.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The leftmost place of the least value in each window of so many."""
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = value[:-step], value[step:]
        place = np.where(left <= right, place[:-step], place[step:])
        value = np.minimum(left, right)
        size += step
    return place


class Hasher:
    """Anchors and spans of pieces of text."""

    def __init__(self, length: int, kgram: int):
        self.length, self.kgram = length, kgram

    def records(self, pieces: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """pieces: (document, place of its first byte, bytes), each at least `length` long."""
        text = np.concatenate([p[2] for p in pieces])
        n, width = len(text), self.length - self.kgram + 1
        h, size, factor = _BYTE[text], 1, _BASE
        while size < self.kgram:
            h = h[: len(h) - size] * factor + h[size:]
            size, factor = 2 * size, np.uint64(int(factor) ** 2 % 2**64)
        h = _mixed(h)
        place = _least(h, width)
        sizes = np.array([len(p[2]) for p in pieces])
        begins = np.cumsum(sizes) - sizes
        marks = np.zeros(n + 1, np.int64)
        np.add.at(marks, begins, 1)
        np.add.at(marks, begins + sizes - self.length + 1, -1)
        fine = np.cumsum(marks[:n]) > 0
        start = np.flatnonzero(fine)
        anchor = place[start]
        first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
        a = start[first]
        b = np.append(start[np.flatnonzero(first)[1:] - 1], start[-1])
        p = anchor[first].astype(np.int64)
        data, digest = text.tobytes(), hashlib.sha256
        spans = b"".join([digest(data[i:j]).digest()[:16] for i, j in zip(a.tolist(), (b + self.length).tolist(), strict=True)])
        piece = np.searchsorted(begins, a, side="right") - 1
        out = np.zeros(len(a), _RECORD)
        out["key"], out["before"], out["after"] = h[p], p - a, p - b
        out["span"], out["span2"] = np.frombuffer(spans, "<u8").reshape(-1, 2).T
        out["doc"] = np.array([q[0] for q in pieces], np.int64)[piece]
        out["at"] = a - begins[piece] + np.array([q[1] for q in pieces], np.int64)[piece]
        return out


def pieces_of(doc: int, text: bytes, length: int) -> list[tuple[int, int, np.ndarray]]:
    """A text as pieces whose starts follow each other; each has the bytes that its last string needs."""
    data = np.frombuffer(text, np.uint8)
    return [(doc, s, data[s : s + PIECE + length - 1]) for s in range(0, len(data) - length + 1, PIECE)]


def collapse(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by key, span, document and place; and which are not the first of their key and span."""
    order = np.lexsort((records["at"], records["doc"], records["span2"], records["span"], records["key"]))
    r = records[order]
    same = np.ones(max(0, len(r) - 1), bool)
    for f in ("key", "span", "span2"):
        same &= r[f][1:] == r[f][:-1]
    return r, np.concatenate([[False], same]) if len(r) else np.zeros(0, bool)


def _ranges(records: np.ndarray, length: int) -> np.ndarray:
    """(document, from, to) of the bytes that the records' strings cover."""
    out = np.zeros(len(records), [("doc", "<i8"), ("from", "<i8"), ("to", "<i8")])
    out["doc"], out["from"] = records["doc"], records["at"]
    out["to"] = records["at"].astype(np.int64) + records["before"] - records["after"] + length
    return merged(out)


def merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges of each document that touch or overlap, as one; sorted."""
    if not len(ranges):
        return ranges
    r = ranges[np.lexsort((ranges["to"], ranges["from"], ranges["doc"]))]
    new = np.ones(len(r), bool)
    group = np.cumsum(np.concatenate([[0], r["doc"][1:] != r["doc"][:-1]]))
    # Within a document the furthest end so far; documents are kept apart by an offset larger than any end.
    wide = int(r["to"].max()) + 1
    if wide * (int(group[-1]) + 1) < 2**62:
        reach = np.maximum.accumulate(r["to"] + group * wide) - group * wide
    else:
        reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(r["to"], np.flatnonzero(np.diff(group)) + 1)])
    new[1:] = (group[1:] != group[:-1]) | (r["from"][1:] > reach[:-1])
    out = r[new]
    out["to"] = reach[np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)]
    return out


def _dealt(array: np.ndarray, part: np.ndarray):
    """(part, rows of array) for each part that has any."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        yield int(part[a]), array[order[a:b]]


def _packed(array: np.ndarray) -> bytes:
    """The fields one after the other, so that like values lie together."""
    return b"".join(np.ascontiguousarray(array[f]).tobytes() for f in array.dtype.names)


def _unpacked(blob, dtype: np.dtype) -> np.ndarray:
    n = len(blob) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for f in dtype.names:
        out[f] = np.frombuffer(blob, dtype[f], n, at)
        at += n * dtype[f].itemsize
    return out


_RANGE = np.dtype([("doc", "<i8"), ("from", "<i8"), ("to", "<i8")])
_LEFT = np.dtype([*[(n, _RECORD[n]) for n in _RECORD.names], ("hot", "u1")])
_SENT = "part int, kind int, blob binary"


def _sent(part, kind, blob):
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], ["part", "kind", "blob"])


def _bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return long_hash(doc) % n


def _texts(batch: pa.RecordBatch):
    """(key, bytes) of each row."""
    for key, text in zip(batch.column("doc_key").to_pylist(), batch.column("text"), strict=True):
        yield key, text.as_buffer().to_pybytes() if text.is_valid else b""


def _anchored(length: int, kgram: int, n: int, hot_records: int):
    """Documents -> their records by part of the key (kind 0), ranges known to be repeats by part of the document (kind 1),
    and for hot keys records by part of the span (kind 4) with a mark at the part of the key (kind 5)."""

    def work(batches):
        hasher, held, count = Hasher(length, kgram), [], 0
        pieces, size = [], 0

        def send():
            found = np.concatenate(held)
            held.clear()
            r, again = collapse(found)
            del found
            ranges = _ranges(r[again], length)
            for part, some in _dealt(ranges, _bucket(ranges["doc"], n)):
                yield _sent(part, 1, _packed(some))
            first = r[~again]
            del r, ranges
            keys, of, counts = np.unique(first["key"], return_inverse=True, return_counts=True)
            hot = counts[of] > hot_records
            part_of = lambda k: (k % np.uint64(n)).astype(np.int64)
            for part, some in _dealt(first[~hot], part_of(first["key"][~hot])):
                yield _sent(part, 0, _packed(some))
            for part, some in _dealt(first[hot], part_of(first["span"][hot])):
                yield _sent(part, 4, _packed(some))
            marks = keys[counts > hot_records]
            for part, some in _dealt(marks, part_of(marks)):
                yield _sent(part, 5, some.tobytes())

        for batch in batches:
            for key, text in _texts(batch):
                for piece in pieces_of(key, text, length):
                    pieces.append(piece)
                    size += len(piece[2])
                    if size >= HASHED:
                        held.append(hasher.records(pieces))
                        count += len(held[-1])
                        pieces, size = [], 0
                        if count >= HELD:
                            yield from send()
                            count = 0
        if pieces:
            held.append(hasher.records(pieces))
        if held:
            yield from send()

    return work


def _bucketed(length: int, n: int, hot_bucket: int):
    """One part's records -> ranges of repeats (kind 1) and the records whose spans must be sorted (kind 2), by part of the document."""

    def work(batches):
        held = {0: [], 4: [], 5: []}
        for batch in batches:
            for k, kind in enumerate(batch.column("kind").to_pylist()):
                blob = batch.column("blob")[k].as_buffer()
                if kind == 1:
                    yield _sent(batch.column("part")[k].as_py(), 1, blob.to_pybytes())
                else:
                    held[kind].append(np.frombuffer(blob, "<u8") if kind == 5 else _unpacked(blob, _RECORD))
        marked = np.unique(np.concatenate(held[5])) if held[5] else np.zeros(0, np.uint64)
        for kind in (0, 4):
            if not held[kind]:
                continue
            r, again = collapse(np.concatenate(held[kind]))
            held[kind].clear()
            ranges = _ranges(r[again], length)
            for part, some in _dealt(ranges, _bucket(ranges["doc"], n)):
                yield _sent(part, 1, _packed(some))
            r = r[~again]
            _, at, counts = np.unique(r["key"], return_inverse=True, return_counts=True)
            left = np.zeros(len(r), _LEFT)
            for f in _RECORD.names:
                left[f] = r[f]
            # 1: split by what neighbouring strings share; 2: into single strings. A key has one and the same everywhere.
            very = np.isin(r["key"], marked) if kind == 0 else np.ones(len(r), bool)
            left["hot"] = np.where(very, 2, counts[at] > hot_bucket)
            left = left[(counts[at] > 1) | very]
            for part, some in _dealt(left, _bucket(left["doc"], n)):
                yield _sent(part, 2, _packed(some))

    return work


def _by_text():
    """Rows of one part with the blobs first -> (rows of blobs sorted by document, batches of texts)."""

    def split(batches, dtype):
        blobs, rest = [], iter(batches)
        for batch in rest:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            n = int((kinds >= 0).sum())
            blobs += [_unpacked(batch.column("blob")[k].as_buffer(), dtype) for k in range(n)]
            if n < batch.num_rows:
                first = batch.slice(n)
                break
        else:
            first = None
        array = np.concatenate(blobs) if blobs else np.zeros(0, dtype)
        array = array[np.argsort(array["doc"], kind="stable")]

        def texts():
            if first is not None:
                yield first
            yield from rest

        return array, texts()

    return split


_SPAN = np.dtype([("route", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("size", "<i4"), ("anchor", "<i4")])


def _parts(before: int, after: int):
    """A hot bucket's starts in groups of STEP by their distance from the anchor: the most and the least, and the group's least.

    All strings of a group hold the bytes from the group's least distance on, which tell its parts apart."""
    for shift in range(after - after % STEP, before + 1, STEP):
        yield min(before, shift + STEP - 1), max(after, shift), shift


def _fetched(length: int, n: int):
    """A part's texts and records -> spans with their bytes, by part of the bucket (kind 3).

    Of equal single strings of hot buckets only the first is sent; the others are ranges of repeats (kind 1)."""
    split = _by_text()

    def work(batches):
        left, texts = split(batches, _LEFT)
        spans: list[tuple[int, int, int, int, int]] = []
        data: list[bytes] = []
        single: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        size = 0

        def send():
            again = []
            for (route, own), places in single.items():
                places.sort()
                spans.append((route, *places[0], length, 0))
                data.append(own)
                again += [(doc, at, at + length) for doc, at in places[1:]]
            ranges = merged(np.array(again, _RANGE))
            for part, some in _dealt(ranges, _bucket(ranges["doc"], n)):
                yield _sent(part, 1, _packed(some))
            array = np.array(spans, _SPAN)
            sizes = array["size"].astype(np.int64)
            joined = np.frombuffer(b"".join(data), np.uint8)
            begins = np.cumsum(sizes) - sizes
            for part, some in _dealt(np.arange(len(array)), (array["route"] % np.uint64(n)).astype(np.int64)):
                head = array[some]
                content = b"".join(joined[begins[k] : begins[k] + sizes[k]].tobytes() for k in some)
                yield _sent(part, 3, len(head).to_bytes(8, "little") + _packed(head) + content)

        for batch in texts:
            for key, text in _texts(batch):
                a, b = np.searchsorted(left["doc"], key), np.searchsorted(left["doc"], key, side="right")
                for route, _, _, _, at, before, after, hot in left[a:b].tolist():
                    anchor = at + before
                    if hot == 2:
                        for shift in range(after, before + 1):
                            start = anchor - shift
                            own = text[start : start + length]
                            single.setdefault((xxhash.xxh64_intdigest(own, route ^ shift), own), []).append((key, start))
                            size += 16
                        size += length
                        continue
                    for more, less, shift in _parts(before, after) if hot else ((before, after, None),):
                        start = anchor - more
                        own = text[start : anchor - less + length]
                        if shift is not None:
                            route_here = xxhash.xxh64_intdigest(text[anchor - shift : anchor - shift - STEP + 1 + length], route ^ shift)
                        else:
                            route_here = route
                        spans.append((route_here, key, start, len(own), more))
                        data.append(own)
                        size += len(own)
                if size >= 8 << 20:
                    yield from send()
                    spans, data, size = [], [], 0
                    single.clear()
        if spans or single:
            yield from send()

    return work


def repeats(spans: np.ndarray, content: np.ndarray, length: int) -> np.ndarray:
    """Ranges of repeats among spans, sorted by route, by suffix sorting all their strings."""
    sizes = spans["size"].astype(np.int64)
    # Each span is laid out so that its anchor falls on a multiple of the cover's period: equal strings then have equal residues.
    room = (sizes + 2 * PERIOD - 2) // PERIOD * PERIOD
    base = np.cumsum(room) - room
    begin = base + (-spans["anchor"].astype(np.int64)) % PERIOD
    text = np.zeros(int(room.sum()), np.uint8)
    source = np.cumsum(sizes) - sizes
    places = np.repeat(begin - source, sizes) + np.arange(len(content))
    text[places] = content
    inside = np.zeros(len(text), bool)
    inside[places] = True
    count = sizes - length + 1
    of = np.repeat(np.arange(len(spans)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    starts = begin[of] + nth
    bucket = np.unique(spans["route"], return_inverse=True)[1]
    order, same = CoverSample(text, length, inside).sort(starts, bucket[of])
    doc, at = spans["doc"][of][order], spans["at"][of][order] + nth[order]
    run = np.cumsum(~same)
    first = np.lexsort((at, doc, run))
    again = np.concatenate([[False], run[first][1:] == run[first][:-1]])
    out = np.zeros(int(again.sum()), _RANGE)
    out["doc"], out["from"] = doc[first][again], at[first][again]
    out["to"] = out["from"] + length
    return merged(out)


def _sorted(length: int, n: int):
    """One part's spans -> ranges of repeats by part of the document, a block of buckets at a time."""

    def work(batches):
        heads, contents = [], []
        for batch in batches:
            for place, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                buffer = memoryview(blob.as_buffer())
                if kind == 1:
                    yield _sent(place, 1, bytes(buffer))
                    continue
                k = int.from_bytes(buffer[:8], "little")
                end = 8 + k * _SPAN.itemsize
                heads.append(_unpacked(buffer[8:end], _SPAN))
                contents.append(np.frombuffer(buffer[end:], np.uint8))
        if not heads:
            return
        spans, content = np.concatenate(heads), np.concatenate(contents)
        sizes = spans["size"].astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(spans["route"], kind="stable")
        route = spans["route"][order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]])), len(route))
        cuts = np.unique(np.concatenate([[0], cuts]))
        total = np.concatenate([[0], np.cumsum(sizes[order])])
        k = 0
        while k < len(cuts) - 1:
            end = max(k + 1, int(np.searchsorted(total[cuts], total[cuts[k]] + BLOCK, side="right")) - 1)
            some = order[cuts[k] : cuts[end]]
            k = end
            own = sizes[some]
            at = np.repeat(begins[some] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            found = repeats(spans[some], content[at], length)
            for part, ranges in _dealt(found, _bucket(found["doc"], n)):
                yield _sent(part, 1, _packed(ranges))

    return work


def _removed(text_at: int):
    """A part's rows and ranges -> rows, the bytes kept, the spans removed."""
    split = _by_text()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        ranges, rows = split(batches, _RANGE)
        ranges = merged(ranges)
        for batch in (b.slice(at, 1024) for b in rows for at in range(0, b.num_rows, 1024)):
            kept, spans = [], []
            for key, text in zip(batch.column("doc_key").to_pylist(), batch.column("row").field(text_at), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                a, b = np.searchsorted(ranges["doc"], key), np.searchsorted(ranges["doc"], key, side="right")
                out, last = [], 0
                own = list(zip(ranges["from"][a:b].tolist(), ranges["to"][a:b].tolist(), strict=True))
                for start, end in own:
                    out.append(data[last:start])
                    last = end
                out.append(data[last:])
                kept.append(b"".join(out))
                spans.append([{"start": s, "end": e} for s, e in own])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), pa.array(spans, spans_type)], ["row", "kept", "spans"])

    return work


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, kgram: int = KGRAM, hot_bucket: int = HOT_BUCKET, hot_records: int = HOT_RECORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """row (the input's columns), kept (bytes), spans (start, end of each removed run) for each row of docs."""
    if kgram & (kgram - 1) or not kgram <= length - 1 or length - kgram > 255:
        raise ValueError("kgram must be a power of two under length and within 255 of it")
    n = parts_of(docs, part_bytes, text)
    row = whole_row(docs).alias("row")
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    kind = dict(docs.dtypes)[doc_id]
    if kind not in ("bigint", "int", "smallint", "tinyint") or not ids.where("doc_id IS NULL").isEmpty() or not ids.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Ids that are no order by themselves: rows are sorted once and numbered in that order.
        keyed = docs.select(row, F.col(doc_id).alias("i"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
        keyed = keyed.repartitionByRange(min(n, MAX_PARTITIONS), F.col("i").asc_nulls_first(), "h").sortWithinPartitions(F.col("i").asc_nulls_first(), "h", "text")
        keyed = materialised(keyed.select(F.monotonically_increasing_id().alias("doc_key"), "text", "row"))
    else:
        keyed = docs.select(F.col(doc_id).cast("long").alias("doc_key"), F.col(text).alias("text"), row)
    part = F.pmod(F.xxhash64("doc_key"), F.lit(n)).cast("int").alias("part")
    texts = keyed.select("doc_key", "text")

    sent = by_part(arrow_map(texts, _anchored(length, kgram, n, hot_records), _SENT), n)
    found = materialised(arrow_map(sent, each_part(_bucketed(length, n, hot_bucket)), _SENT))

    def with_rows(blobs: DataFrame, rows: DataFrame) -> DataFrame:
        both = blobs.unionByName(rows.withColumn("kind", F.lit(-1)).withColumn("part", part), allowMissingColumns=True)
        return by_part(both, n, F.desc("kind"))

    spans = by_part(arrow_map(with_rows(found.where("kind = 2"), texts), each_part(_fetched(length, n)), _SENT), n)
    more = arrow_map(spans, each_part(_sorted(length, n)), _SENT)
    ranges = found.where("kind = 1").unionByName(more)
    row_type = docs.select(row).schema["row"].dataType
    work = _removed(docs.columns.index(text))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out = T.StructType([T.StructField("row", row_type), T.StructField("kept", T.BinaryType()), T.StructField("spans", span)])
    return arrow_map(with_rows(ranges, keyed.select("doc_key", "row")), each_part(work), out)
