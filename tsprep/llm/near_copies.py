"""Near copies by word shingles: SimHash with Golay keys joins most of them, an exact join by shared shingles finds the rest.

Texts are taken as sets of shingles (runs of `words` words, each counted once); texts of equal sets are one node. Every link
is verified by the Jaccard similarity of the sets, and what is joined in the end is just what all links of `similarity` or
more join: nothing unlike is linked, no link is missed.

First, a node has three 64-bit fingerprints: one of its distinct word pairs, which an edited word changes less than it does
long shingles and whose Golay keys (see simhash.py) bring candidates together, and two of its shingles, whose 128 bits
estimate how similar two nodes are. Of the nodes that share a key the least spanning forest of what comes in question becomes
candidate links (in small groups all pairs where these are no more than the nodes), so that their number stays linear in the
nodes, however large a group of near copies is. Their bits only choose what is verified first: each node's nearest and its
least near certain neighbour, then whatever else joins nodes that are not connected yet.

Then the exact join: two sets that similar have in common one of the first shingles of either, so many as `prefix_length` says,
in any order that is the same for all (here: those that a sample finds often come last, so that few nodes share a first one). Nodes
that share one, are of no too unlike sizes and places (see `_cross`), and are not connected yet are verified, of each
two components the nearest by their bits first, then all pairs that are left. Long texts may share hundreds of them and yet be unlike;
a pair counts where it meets first, so it is left out where the rows' EARLIER shingles show that it has met before.

Neither the texts nor the sets of all nodes are shuffled. Pairs are held against short sketches of their sets first (`odd_bits`); the
sets of the nodes in those pairs that the sketches leave are made anew, from texts that a bounded broadcast (`key_bits`) picks out
where they lie. In the same way only rows that may go are joined with those that stay. What the broadcast picks too much, exact joins drop.

Defined results: a null text counts as empty; texts without words are one node. Rows with a null id take part; a component's
row that stays is the one of least id (null ids last), of rows of one id that of least text hash. Columns other
than id and text are ignored by `similar_documents` and kept, whatever their names, by `one_of_each`.
"""

from __future__ import annotations

import math
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, group_bounds, materialised, new_folder, partitions, quoted, record_batch, slices, whole_row
from .graph import AT_ONCE, components
from .simhash import Golay, _column, fuzzy_keys, shingle_hashes, vote

WORDS, SIMILARITY = 5, 0.8
HOT_GROUP, DENSE = 1_000_000, 24
#: Deviations from the expected number of differing bits: certain below the one, in question up to the other.
TIGHT, LOOSE, NEAREST = -1.64, 2.6, 2
#: Texts sampled for frequent shingles, the characters read of each, in how many a shingle is frequent, and how many are broadcast.
SAMPLE_ROWS, SAMPLE_CHARS, OFTEN, MAX_FREQUENT = 4096, 100_000, 4, 1 << 17
#: Nodes that a task remembers to have sent; pairs of two components that a task sends at first.
SEEN, FEW = 1 << 20, 2
#: Rows of a group up to which all its distances are looked at, and pairs of rows that are looked at at once.
MATRIX, CELLS = 2048, 1 << 18
#: Bits of a filter for each key that it holds, and bits at most: beyond some million keys it lets more and more others pass, which cost shuffle only.
KEY_BITS, MAX_KEY_BITS = 64, 1 << 27
MARKS = ("fp", "fp2", "pairs", "node")
#: Columns of a node's parities: odd_bits of this fixed length.
PARITY = tuple(f"odd{k}" for k in range(8))
#: Columns of the shared shingles next before a row's in its node's prefix; the node itself where there is none (no other node's row holds that).
EARLIER = tuple(f"earlier{k}" for k in range(4))
CARRIED = ("fp", "fp2", "node")


def bits_for(similarity: float, deviations: float, bits: int = 64 * 2) -> int:
    """Differing bits that rows of that Jaccard similarity are expected to have, and so many deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def marks(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Of each text two fingerprints of its shingles' hashes, the second mixed anew, one of its word pairs, and its node."""

    def joined(sets):
        return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)

    def voted(hashes, sizes, n):
        turned = ((hashes ^ (hashes >> np.uint64(29 + turn))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * turn) for turn in range(1, n))
        return [vote(hashes, sizes), *(vote(h ^ (h >> np.uint64(32)), sizes) for h in turned)]

    sets = [shingle_set(t, words) for t in texts]
    nodes = np.array([node_of(s) for s in sets], np.uint64)
    return [*voted(*joined(sets), 2), *voted(*joined([shingle_set(t, 2) for t in texts]), 1), nodes]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(doc_id: Column, hashed: Column) -> Column:
    """What tells rows of other id or text apart; null ids too."""
    return F.xxhash64(doc_id, hashed)


def key_bits(keys: DataFrame, n: int, most: int = MAX_KEY_BITS) -> np.ndarray:
    """The filter of some n keys (column key) as bytes: for each key the bit that its last digits name."""
    size = min(most, 1 << max(15, (KEY_BITS * n - 1).bit_length()))
    place = keys.select(F.col("key").bitwiseAND(F.lit(size - 1)).alias("place"))
    pieces = place.groupBy(F.shiftright("place", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
    out = np.zeros((size >> 15, 4096), np.uint8)
    for row in pieces.toLocalIterator():
        out[row.piece] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter's keys may be among these: true for all that are."""
    place = keys & (8 * len(bits) - 1)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def marked(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """doc_id, text_hash and the columns MARKS for each row."""

    def work(batches):
        for batch in slices(batches, "text", rows=512, max_bytes=4 << 20):
            found = marks(batch.column("text").to_pylist(), words)
            yield record_batch(doc_id=batch.column("doc_id"), text_hash=batch.column("text_hash"), **{n: c.view(np.int64) for n, c in zip(MARKS, found, strict=True)})

    longs = [T.StructField(n, T.LongType()) for n in ("text_hash", *MARKS)]
    given = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    return arrow_map(given.withColumn("text_hash", text_hash(F.col("text"))), work, T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *longs]))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[..., :2] ^ b[..., :2]).sum(-1, dtype=np.int64)


def _nearest(rows: np.ndarray, some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the others its nearest of some (places), and the differing bits; a bounded table at a time."""
    bits, near = np.full(len(others), 1 << 20), np.zeros(len(others), np.int64)
    step = max(1, CELLS // len(others))
    for k in range(0, len(some), step):
        part = some[k : k + step]
        table = _apart(rows[part][:, None], rows[others][None])
        at = table.argmin(0)
        own = table[at, np.arange(len(others))]
        nearer = own < bits
        bits[nearer], near[nearer] = own[nearer], part[at[nearer]]
    return bits, near


def least_forest(rows: np.ndarray, tight: int, loose: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links (places) of a group: its least spanning forest by bits, then places.

    Where groups overlap, as those of the many keys of like nodes do, they give mostly the same links."""
    n = len(rows)
    place = np.arange(n)
    none, unlinked = np.int64(1) << 62, 255
    # A byte for each pair, as tables of longs would take hundreds of MB.
    bits, step = np.empty((n, n), np.uint8), max(1, CELLS // n)
    for k in range(0, n, step):
        x, y = rows[k : k + step, :2].T[..., None] ^ rows[:, :2].T[:, None]
        bits[k : k + step] = np.bitwise_count(x) + np.bitwise_count(y)
    bits[bits > loose] = unlinked
    np.fill_diagonal(bits, unlinked)

    def least_leaving(tree):
        table = np.where(tree[:, None] != tree[None], bits, np.uint8(unlinked))
        at = table.argmin(1)  # the first: of equal bits that with the least places
        own = table[place, at].astype(np.int64)
        return np.where(own < unlinked, own * (n * n) + np.minimum(place, at) * n + np.maximum(place, at), none)

    leaving = least_leaving(place)
    near = np.flatnonzero(leaving < none)
    if len(near) < n:
        a, b = least_forest(rows[near], tight, loose) if len(near) else (near, near)
        return near[a], near[b]
    tree = place.copy()
    found = [np.zeros(0, np.int64)]
    # Each tree takes the least link that leaves it, until none does.
    while True:
        least = np.full(n, none)
        np.minimum.at(least, tree, leaving)
        taken = least[least < none]
        if not len(taken):
            break
        found.append(taken)
        ends = np.divmod(taken % (n * n), n)
        while True:
            a, b = tree[ends[0]], tree[ends[1]]
            low = np.minimum(a, b)
            to = place.copy()
            np.minimum.at(to, np.maximum(a, b), low)
            if (to == place).all():
                break
            tree = to[tree]
        leaving = least_leaving(tree)
    return np.divmod(np.unique(np.concatenate(found)) % (n * n), n)


def group_links(rows: np.ndarray, tight: int, loose: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links (places) of a group too large for least_forest, a few for each row, that connect whatever links within loose bits connect.

    Trees of near certain links grow one after the other, a level at a time. What a tree comes near to without reaching it
    remembers the nearest row of it, NEAREST trees at most; beyond these a link is kept where it joins what is not connected yet."""
    n = len(rows)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def link(a, b):
        left.append(a)
        right.append(b)

    best_bits, best = np.full((n, NEAREST), 1 << 20), np.zeros((n, NEAREST), np.int64)
    joined = np.arange(n)  # what is connected so far has one number
    rest = np.arange(n)
    while len(rest):
        level, rest = rest[:1], rest[1:]
        tree = [level]
        near_bits, near = np.full(len(rest), 1 << 20), np.zeros(len(rest), np.int64)
        while len(level) and len(rest):
            bits, of = _nearest(rows, level, rest)
            sure = bits <= tight
            nearer = bits < near_bits
            near_bits[nearer], near[nearer] = bits[nearer], of[nearer]
            level = rest[sure]
            link(of[sure], level)
            tree.append(level)
            rest, near_bits, near = rest[~sure], near_bits[~sure], near[~sure]
        own = np.unique(joined[np.concatenate(tree)])
        joined[np.isin(joined, own)] = number = own[0]
        close = near_bits <= loose
        some, bits, of = rest[close], near_bits[close], near[close]
        if not len(some):
            continue
        for other in np.unique(joined[some]):
            if other != number:
                k = int(np.where(joined[some] == other, bits, 1 << 20).argmin())
                link(of[k : k + 1], some[k : k + 1])
                joined[joined == other] = number
        tables, places = np.column_stack([best_bits[some], bits]), np.column_stack([best[some], of])
        order = np.argsort(tables, axis=1, kind="stable")[:, :NEAREST]
        best_bits[some], best[some] = np.take_along_axis(tables, order, 1), np.take_along_axis(places, order, 1)
    row, k = np.nonzero(best_bits <= loose)
    link(best[row, k], row)
    return np.concatenate(left), np.concatenate(right)


def key_links(keys: np.ndarray, rows: np.ndarray, tight: int, loose: int) -> np.ndarray:
    """Candidate links (node, node, bits) between rows of equal keys; keys come sorted."""
    bounds = group_bounds(keys)
    sizes = np.diff(bounds)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Most keys hold few nodes that have nothing in common: their pairs are looked at side by side.
    group, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(bounds[1:], sizes)
    at = np.flatnonzero(np.repeat(sizes <= DENSE, sizes))
    for step in range(1, DENSE):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        near = at[_apart(rows[at], rows[at + step]) <= loose]
        left.append(near)
        right.append(near + step)
    a, b = np.concatenate(left), np.concatenate(right)
    full = (sizes > DENSE) | (np.bincount(group[a], minlength=len(sizes)) > sizes)
    few = ~full[group[a]] if len(a) else np.zeros(0, bool)
    left, right = [a[few]], [b[few]]
    for k in np.flatnonzero(full):
        # In the order of the nodes, so that the groups of different keys begin alike.
        at = bounds[k] + np.argsort(rows[bounds[k] : bounds[k + 1], -1], kind="stable")
        a, b = least_forest(rows[at], tight, loose) if len(at) <= MATRIX else group_links(rows[at], tight, loose)
        left.append(at[a])
        right.append(at[b])
    a, b = np.concatenate(left), np.concatenate(right)
    nodes = np.sort(np.column_stack([rows[a, -1], rows[b, -1]]).view(np.int64), axis=1)
    found = np.column_stack([nodes, _apart(rows[a], rows[b])])
    return np.unique(found[found[:, 0] != found[:, 1]], axis=0)


class Earlier:
    """The blocks of a hot key's rows that came so far, in a file that goes with this object."""

    def __init__(self, words: int):
        self.file, self.words, self.sizes = tempfile.TemporaryFile(), words, []

    def __iter__(self):
        self.file.seek(0)
        for n in self.sizes:
            yield np.frombuffer(self.file.read(n * self.words * 8), np.uint64).reshape(n, self.words)

    def add(self, fps: np.ndarray) -> None:
        self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(fps).tobytes())
        self.sizes.append(len(fps))


def _candidates(tight: int, loose: int, hot_group: int):
    """Rows sorted by key -> candidate links. A key with more rows than hot_group is linked in blocks, each within itself
    and with every earlier one, two held at a time."""

    def emit(links):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in links.T], ["a", "b", "bits"])

    def settled(earlier, rows):
        one_key = lambda x: key_links(np.zeros(len(x), np.int64), x, tight, loose)
        for block in earlier:
            yield emit(one_key(np.concatenate([block, rows])))
        yield emit(one_key(rows))
        earlier.add(rows)

    def work(batches):
        keys, rows, hot, earlier = np.zeros(0, np.int64), np.zeros((0, len(CARRIED)), np.uint64), None, None
        for batch in chain(batches, (None,)):
            if batch is not None:
                keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
                rows = np.concatenate([rows, np.stack([_column(batch, n) for n in CARRIED], 1)])
            if hot is not None:
                n = int(np.searchsorted(keys, hot, side="right"))
                over = batch is None or n < len(keys)
                if not over and n <= hot_group:
                    continue
                if n:
                    yield from settled(earlier, rows[:n])
                keys, rows = keys[n:], rows[n:]
                hot, earlier = (None, None) if over else (hot, earlier)
            if not len(keys):
                continue
            tail = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
            if tail:
                yield emit(key_links(keys[:tail], rows[:tail], tight, loose))
                keys, rows = keys[tail:], rows[tail:]
            if len(keys) > hot_group:
                hot, earlier = int(keys[-1]), Earlier(len(CARRIED))
                yield from settled(earlier, rows)
                keys, rows = keys[:0], rows[:0]

    return work


def _keyed(batches):
    golay = Golay()
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            some = batch.slice(at, 2048)
            key, k = fuzzy_keys(_column(some, "pairs"), golay)
            yield record_batch(key=key, **{n: _column(some, n)[k].view(np.int64) for n in CARRIED})


def candidate_links(nodes: DataFrame, similarity: float, hot_group: int = HOT_GROUP) -> DataFrame:
    """a, b, bits: the pairs of nodes (columns MARKS) that are worth verifying first, each once."""
    keyed = arrow_map(nodes.select(*MARKS), _keyed, "key long, " + ", ".join(f"{n} long" for n in CARRIED))
    # Keys that agree in their first index lie together: like nodes share several of them, and their links become one in a batch.
    found = keyed.repartition(partitions(nodes, 4 << 20), F.shiftright("key", 12)).sortWithinPartitions("key")
    links = arrow_map(found, _candidates(bits_for(similarity, TIGHT), bits_for(similarity, LOOSE), hot_group), "a long, b long, bits long")
    return materialised(links.groupBy("a", "b").agg(F.min("bits").alias("bits")))


def odd_bits(shingles: np.ndarray, n: int | None = None) -> bytes:
    """Two to four bits for each shingle, each the parity of the shingles whose last digits name it; with half as many
    bits it is the two halves' exclusive or. Two sets differ in as many shingles at least as these differ in bits."""
    n = n or 64 << max(0, (len(shingles) // 32 - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1 == 1, bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """In how many shingles at least the sets differ that have these odd_bits."""
    if len(x) < len(y):
        x, y = y, x
    large, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        large = large >> bits ^ large & (1 << bits) - 1
    return (large ^ int.from_bytes(y, "little")).bit_count()


def _sets(words: int, bits, whole: bool):
    """Rows whose key the filter may hold -> their nodes with the sets, or with the sets' sizes and odd_bits.

    Rows of one key go out once for a task (once for SEEN keys)."""

    def work(batches):
        seen: set[int] = set()
        for batch in batches:
            held = may_hold(bits.value, batch.column("key").to_numpy(zero_copy_only=False))
            for some in slices([batch.filter(pa.array(held))], "text", rows=256, max_bytes=2 << 20):
                keys, found = [], []
                for key, text in zip(some.column("key").to_pylist(), some.column("text").to_pylist(), strict=True):
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        keys.append(key)
                        found.append(shingle_set(text, words))
                if not keys:
                    continue
                sizes = np.array([len(f) for f in found], np.int64)
                columns = {"node": np.array([node_of(f) for f in found], np.uint64).view(np.int64), "key": np.array(keys, np.int64)}
                if whole:
                    columns["shingles"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(found).view(np.int64))
                else:
                    columns |= {"size": sizes, "odd": pa.array([odd_bits(f) for f in found], pa.binary())}
                    parity = np.frombuffer(b"".join(odd_bits(f, 64 * len(PARITY)) for f in found), np.int64).reshape(-1, len(PARITY))
                    columns |= {name: np.ascontiguousarray(parity[:, k]) for k, name in enumerate(PARITY)}
                yield record_batch(**columns)

    return work


class Texts:
    """The rows of docs, where the sets of some nodes are made when they are asked for."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, words: int):
        hashed = text_hash(F.col(quoted(text)))
        self.rows, self.words = docs.select(row_key(F.col(quoted(doc_id)), hashed).alias("key"), F.col(quoted(text)).alias("text")), words

    def _found(self, keys: DataFrame, n: int, whole: bool) -> DataFrame:
        bits = self.rows.sparkSession.sparkContext.broadcast(key_bits(keys, n))
        return arrow_map(self.rows, _sets(self.words, bits, whole), "node long, key long, " + ("shingles array<long>" if whole else "size long, odd binary, " + ", ".join(f"{n} long" for n in PARITY)))

    def sketches(self, wanted: DataFrame) -> DataFrame:
        """node, key, size, odd and the columns PARITY of the wanted nodes (node, and key of one of its rows)."""
        found = self._found(wanted, wanted.count(), False).drop("key")
        return materialised(wanted.join(found.dropDuplicates(["node"]), "node"))

    def sets(self, links: DataFrame) -> DataFrame:
        """node, key, shingles of the links' ends, each once; some others with them."""
        keys = links.select(F.explode(F.array("a_key", "b_key")).alias("key"))
        found = materialised(self._found(keys, 2 * links.count(), True))
        if not found.groupBy("node", "key").count().where("count > 1").isEmpty():
            found = materialised(found.dropDuplicates(["node", "key"]))
        return found


def _possible(similarity: float):
    """Rows (a, b, a_key, b_key, sizes, x, y) -> the pairs with their keys that their odd_bits do not show to be less similar."""

    def work(batches):
        for batch in batches:
            most = batch.column("sizes").to_numpy(zero_copy_only=False) * ((1 - similarity) / (1 + similarity)) + 1e-6
            fit = [least_apart(x, y) <= m for x, y, m in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most.tolist(), strict=True)]
            yield batch.select(["a", "b", "a_key", "b_key"]).filter(pa.array(fit, pa.bool_()))

    return work


def verified(links: DataFrame, sketches: DataFrame, texts: Texts, similarity: float) -> DataFrame:
    """The links (a, b) whose shingle sets are that similar. Sets are made and sent for those only that their odd_bits leave."""
    x, y = (sketches.select(F.col("node").alias(end), F.col("key").alias(f"{end}_key"), F.col("size").alias(f"{end}_size"), F.col("odd").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    both = links.join(x, "a").join(y, "b").select("a", "b", "a_key", "b_key", (F.col("a_size") + F.col("b_size")).alias("sizes"), "x", "y")
    links = materialised(arrow_map(both, _possible(similarity), "a long, b long, a_key long, b_key long"))
    if links.isEmpty():
        return links.select("a", "b")
    sets = texts.sets(links)
    x, y = (sets.select(F.col("node").alias(end), F.col("key").alias(f"{end}_key"), F.col("shingles").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    both = links.join(x, ["a", "a_key"]).join(y, ["b", "b_key"]).select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    return materialised(both.where(F.col("common") >= similarity * (F.col("sizes") - F.col("common"))).select("a", "b"))


def node_links(links: DataFrame, sketches: DataFrame, texts: Texts, similarity: float) -> DataFrame:
    """Verified links that connect whatever the candidates that hold connect."""
    ends = links.select(F.col("a").alias("v"), F.col("b").alias("u"), "bits").unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("u"), "bits"))
    sure = (F.col("bits") <= bits_for(similarity, TIGHT)) & (F.col("u") < F.col("v"))
    first = ends.groupBy("v").agg(F.min_by("u", F.struct("bits", "u")).alias("nearest"), F.min(F.when(sure, F.col("u"))).alias("least"))
    first = first.select("v", F.explode(F.array("nearest", "least")).alias("u")).where("u IS NOT NULL")
    first = materialised(first.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct())
    held = verified(first, sketches, texts, similarity)
    roots = components(held, at_once=AT_ONCE)
    rest = links.select("a", "b").join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        rest = rest.join(own, end, "left").withColumn(f"{end}_root", F.coalesce(f"{end}_root", end))
    return held.unionByName(verified(rest.where("a_root <> b_root").select("a", "b"), sketches, texts, similarity))


def prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of n suffice: a set that similar has at least similarity * n of them, so it can't lack all these."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def frequent_shingles(docs: DataFrame, text: str, n_rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and in how many; they order the prefixes, no result depends on them."""

    def work(batches):
        sets = [shingle_set(t, words) for b in slices(batches, "text", rows=256, max_bytes=2 << 20) for t in b.column("text").to_pylist()]
        found, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        often = np.flatnonzero(n >= OFTEN)
        often = np.sort(often[np.argsort(-n[often], kind="stable")[:MAX_FREQUENT]])
        yield record_batch(shingle=found[often].view(np.int64), n=n[often])

    some = docs.select(F.substring(F.col(quoted(text)), 1, SAMPLE_CHARS).alias("text")).sample(False, min(1.0, SAMPLE_ROWS / max(n_rows, 1)), 7)
    found = arrow_map(some.repartition(1), work, "shingle long, n long").toArrow()
    shingles = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found.column("n").to_numpy()[order]


def first_shingles(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """A set's prefix, in the order that holds for all sets: by the sample's counts, then by hashes. Sets come sorted."""
    known, counts = frequent
    often = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        often = np.where(known[at] == shingles, counts[at], 0)
    return shingles[np.argsort(often, kind="stable")[: prefix_length(len(shingles), similarity)]]


def _prefixes(words: int, similarity: float, frequent):
    """Texts -> a row for each shingle of a node's prefix; place: the set's size and the shingle's place in the prefix.

    A node goes out once for a task (once for SEEN nodes), however many copies of its text there are."""

    def work(batches):
        seen: set[int] = set()
        for batch in slices(batches, "text", rows=512, max_bytes=4 << 20):
            keys, nodes, places = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, words)
                node = node_of(own)
                if not len(own) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                first = first_shingles(own, frequent.value, similarity)
                keys.append(first)
                nodes.append(np.full(len(first), node, np.uint64))
                places.append((len(own) << 32) + np.arange(len(first)))
            if keys:
                yield record_batch(key=np.concatenate(keys).view(np.int64), node=np.concatenate(nodes).view(np.int64), place=np.concatenate(places))

    return work


def _whole_groups(batches, names: list[str]):
    """Columns of rows sorted by their first one, a piece at a time; no piece ends within a group."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if not batch.num_rows:
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut or held and held[-1][0][-1] != columns[0][0]:
            yield [np.concatenate(c) for c in zip(*held, [x[:cut] for x in columns], strict=True)]
            held = []
        held.append([x[cut:] for x in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _meetings(bounds: np.ndarray, holds):
    """Places (x, y) of rows of one group, x before y, for which holds(x, y); a bounded number is looked at at a time."""
    sizes = np.diff(bounds)
    ends = np.repeat(bounds[1:], sizes)
    at = np.flatnonzero(np.repeat(sizes <= DENSE, sizes))
    for step in range(1, DENSE):
        at = at[at + step < ends[at]]
        if not len(at):
            break
        fit = holds(at, at + step)
        yield at[fit], at[fit] + step
    for k in np.flatnonzero(sizes > DENSE):
        start, end = int(bounds[k]), int(bounds[k + 1])
        step = max(1, CELLS // (end - start))
        for a in range(start, end, step):
            x, y = np.arange(a, min(a + step, end))[:, None], np.arange(a + 1, end)[None]
            i, j = np.nonzero(holds(x, y) & (x < y))
            yield x[i, 0], y[0, j]


def _likely(place: np.ndarray, similarity: float):
    """Whether rows of one key may be that similar, if the key is the first shingle they share: from there on either must have left
    what they need in common, similarity / (1 + similarity) of both sizes."""
    size, left = place >> 32, (place >> 32) - (place & 0xFFFFFFFF)
    share = similarity / (1 + similarity)
    return lambda x, y: np.minimum(left[x], left[y]) >= share * (size[x] + size[y]) - 1e-6


def _shared(similarity: float):
    """Rows sorted by key and node -> each once, those that may be similar to another one of their key."""

    def work(batches):
        for key, node, place in _whole_groups(batches, ["key", "node", "place"]):
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node, place = key[once], node[once], place[once]
            met = np.zeros(len(key), bool)
            for x, y in _meetings(group_bounds(key), _likely(place, similarity)):
                met[x] = met[y] = True
            yield record_batch(key=key[met], node=node[met], place=place[met])

    return work


def _nearest_of(found: np.ndarray, few: int) -> np.ndarray:
    """Of rows (root, root, bits, a, b) the few of least bits of each two roots, each pair once."""
    found = np.unique(found, axis=0)
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    start = np.flatnonzero(new)
    return found[np.arange(len(found)) - start[np.cumsum(new) - 1] < few]


def _within(odd: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the parities of these places leave it open that they are that similar."""
    most = (size[x] + size[y]) * ((1 - similarity) / (1 + similarity)) + 1e-6
    fit = np.zeros(len(x), bool)
    for k in range(0, len(x), 1 << 15):
        some = slice(k, k + (1 << 15))
        fit[some] = np.bitwise_count(odd[x[some]] ^ odd[y[some]]).sum(1, dtype=np.int64) <= most[some]
    return fit


def _met_before(earlier: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the rows at these places share one of their earlier shingles."""
    met = np.zeros(len(x), bool)
    for k in range(earlier.shape[1]):
        met |= (earlier[x, k, None] == earlier[y]).any(1)
    return met


def _cross(similarity: float, few: int | None, parity: tuple[str, ...] = (), earlier: tuple[str, ...] = ()):
    """Rows sorted by key -> pairs of unconnected nodes that may be similar: all, or of each two components the few of least bits in a batch.

    parity names columns of the nodes' parities, which rule out most pairs here; earlier those of EARLIER, which leave out most that have met before."""

    def emit(pairs):
        pairs = np.unique(pairs, axis=0)
        return record_batch(a=np.ascontiguousarray(pairs[:, 0]), b=np.ascontiguousarray(pairs[:, 1]))

    def work(batches):
        best = np.zeros((0, 5), np.int64)
        for key, node, place, root, fp, fp2, *more in _whole_groups(batches, ["key", "node", "place", "root", "fp", "fp2", *parity, *earlier]):
            bounds = group_bounds(key)
            split = np.repeat(np.minimum.reduceat(root, bounds[:-1]) != np.maximum.reduceat(root, bounds[:-1]), np.diff(bounds))
            key, node, place, root, fps = key[split], node[split], place[split], root[split], np.stack([fp, fp2], 1)[split]
            odd = np.stack(more[: len(parity)], 1)[split].view(np.uint64) if parity else None
            known = np.stack(more[len(parity) :], 1)[split] if earlier else None
            likely = _likely(place, similarity)
            for x, y in _meetings(group_bounds(key), lambda x, y, root=root, likely=likely: (root[x] != root[y]) & likely(x, y)):
                if parity:
                    fit = _within(odd, place >> 32, x, y, similarity)
                    x, y = x[fit], y[fit]
                if earlier:
                    new = ~_met_before(known, x, y)
                    x, y = x[new], y[new]
                pairs = np.sort(np.stack([node[x], node[y]], 1), axis=1)
                if few is None:
                    yield emit(pairs)
                    continue
                ends = np.sort(np.stack([root[x], root[y]], 1), axis=1)
                best = _nearest_of(np.concatenate([best, np.column_stack([ends, _apart(fps[x], fps[y]), pairs])]), few)
                if len(best) > 1 << 20:
                    yield emit(best[:, 3:])
                    best = best[:0]
        yield emit(best[:, 3:])

    return work


def shared_shingles(docs: DataFrame, text: str, n_rows: int, words: int, similarity: float) -> DataFrame:
    """key, node, place: every two nodes that similar have rows of one key here."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, n_rows, words))
    first = arrow_map(docs.select(F.col(quoted(text)).alias("text")), _prefixes(words, similarity, frequent), "key long, node long, place long")
    grouped = first.repartition(partitions(docs, 4 << 20), "key").sortWithinPartitions("key", "node")
    return materialised(arrow_map(grouped, _shared(similarity), "key long, node long, place long"))


def with_earlier(shared: DataFrame) -> DataFrame:
    """shared with the columns EARLIER."""
    order = Window.partitionBy("node").orderBy("place")
    return shared.select("*", *(F.coalesce(F.lag("key", k + 1).over(order), "node").alias(name) for k, name in enumerate(EARLIER)))


def _written(df: DataFrame) -> DataFrame:
    """df from a file, whose size the optimizer reads: the estimates of checkpoints multiply from join to join until planning stalls."""
    folder = new_folder(df.sparkSession, "links")
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def joined_roots(shared: DataFrame, roots: DataFrame, sketches: DataFrame, texts: Texts, similarity: float, n_parts: int) -> DataFrame:
    """node, root for every node, where roots are joined that verified links of their nodes connect; no such link is left out."""
    for few in (FEW, None):
        nodes = roots.join(sketches.select("node", *PARITY), "node")
        rows = shared.join(nodes, "node").repartition(n_parts, "key").sortWithinPartitions("key")
        pairs = materialised(arrow_map(rows, _cross(similarity, few, PARITY, EARLIER), "a long, b long").distinct())
        held = verified(pairs, sketches, texts, similarity)
        for end in ("a", "b"):
            held = held.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        more = components(_written(held.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()), at_once=AT_ONCE)
        more = more.select(F.col("node").alias("root"), F.col("root").alias("joined"))
        roots = _written(roots.join(more, "root", "left").select("node", F.coalesce("joined", "root").alias("root")))
    return roots


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, hot_group: int = HOT_GROUP) -> DataFrame:
    """doc_id, text_hash, node, component_id and stays for each row, where documents link whose shingle sets are that similar.

    component_id is the component's least id; stays marks the row that is kept of each (and rows equal to it in id and text)."""
    rows = materialised(marked(docs, doc_id, text, words))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = materialised(rows.groupBy("node").agg(F.min(least).alias("least"), F.min(F.struct(*MARKS[:-1])).alias("marks")))
    links = candidate_links(nodes.select("node", "marks.*"), similarity, hot_group)
    shared = shared_shingles(docs, text, rows.count(), words, similarity).join(nodes.select("node", "marks.fp", "marks.fp2"), "node")
    shared = materialised(with_earlier(shared))
    wanted = links.select(F.explode(F.array("a", "b")).alias("node")).unionByName(shared.select("node")).distinct()
    wanted = materialised(nodes.join(wanted, "node").select("node", row_key(F.col("least.doc_id"), F.col("least.text_hash")).alias("key")))
    texts = Texts(docs, doc_id, text, words)
    sketches = texts.sketches(wanted)
    roots = components(node_links(links, sketches, texts, similarity), at_once=AT_ONCE)
    roots = _written(nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    roots = joined_roots(shared, roots, sketches, texts, similarity, partitions(docs, 4 << 20))
    # Written before they are joined with each other, so that a component with very many nodes can be split.
    by_node = materialised(nodes.select("node", "least").join(roots, "node"))
    least = materialised(by_node.groupBy("root").agg(F.min("least").alias("kept")))
    found = rows.select("doc_id", "text_hash", "node").join(by_node.select("node", "root").join(least, "root").drop("root"), "node")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    return found.select("doc_id", "text_hash", "node", F.col("kept.doc_id").alias("component_id"), stays.alias("stays"))


def one_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of docs the one row of each component that stays, all its columns; of rows equal in id and text one."""
    each = materialised(found.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n")))
    doubtful = each.where("NOT stays OR n > 1").select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key"))
    bits = docs.sparkSession.sparkContext.broadcast(key_bits(doubtful, doubtful.count()))

    @F.arrow_udf(T.BooleanType())
    def in_doubt(key: pa.Array) -> pa.Array:
        return pa.array(may_hold(bits.value, key.to_numpy(zero_copy_only=False)))

    rows = docs.select(whole_row(docs).alias("row"), F.col(quoted(doc_id)).alias("i"), text_hash(F.col(quoted(text))).alias("h"))
    rows = rows.withColumn("doubt", in_doubt(row_key(F.col("i"), F.col("h"))))
    rest = rows.where("doubt").join(each.where("stays").select("doc_id", "text_hash"), F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left_semi")
    if not each.where("stays AND n > 1").isEmpty():
        rest = rest.dropDuplicates(["i", "h"])
    return rows.where("NOT doubt").select("row.*").union(rest.select("row.*"))
