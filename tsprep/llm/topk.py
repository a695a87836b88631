"""Exact top-k by inner product, with ball trees and branch and bound.

Vectors become integers floor(scale * x). They are dealt into cells by a tree of hyperplanes made from a bounded sample
(`PIVOTS` vectors of least hash; it only decides what lies together), and within a cell into shards of bounded size that are cut
by distance, each with a ball tree. A shard is written once. What goes to the queries is only each shard's ball, centre
and radius; queries then go to shards, in two rounds:

1. Each query goes to the FIRST shards whose balls promise most. Their answers give it a kth score.
2. With that score it goes to those other shards alone whose bound, q.centre + |q| radius, is not below it.

In a tree, a node is entered only by queries whose bound on it is not below their kth score, which rises as leaves are scored, and
of two children the one with the higher bound comes first. All answers meet in a window by query. So what is shuffled is
the vectors once, and a query for each shard that can serve it; a shard that very many queries ask has copies, one for
`ASKED` queries. Balls are sent out in packs of bounded size, a pass over the queries for each.

Defined results: a null vector, or one with null or non-finite components, takes no part; nor does a row with a null
id. Rows that share an id count as one vector, the least of them; it is never its own candidate. Vectors
of different lengths are not compared. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_PARTITIONS, arrow_map, materialised, new_folder, partitions, record_batch

SCALE, K = 64, 20
SHARD, LEAF, GROUP = 4096, 128, 1 << 17
#: Vectors that cells are made from, cells at most, vectors that a cell is made for at least; shards of the first round.
PIVOTS, CELLS, CELL, FIRST = 8192, 512, 8192, 2
#: Bytes of balls sent out at once, queries of a block, queries that one copy of a shard answers.
PACK_BYTES, QUERY_BLOCK, ASKED = 64 << 20, 4096, 1 << 16
#: Products under this are exact in float64.
EXACT = 2**53


class BallTree:
    """Nodes in depth-first order: centre, radius, rows from start to end, the second child (the first is next)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.centre, self.radius, self.span, self.second = [], [], [], []
        stack: list[tuple[int, int, int]] = [(0, len(ids), -1)]
        while stack:
            a, b, parent = stack.pop()
            node = len(self.span)
            if parent >= 0:
                self.second[parent] = node
            x = vectors[order[a:b]]
            centre = x.mean(0)
            away = ((x - centre) ** 2).sum(1)
            self.centre.append(centre)
            self.radius.append(math.sqrt(float(away.max())))
            self.span.append((a, b))
            self.second.append(-1)
            if b - a > leaf:
                far = x[int(away.argmax())]
                other = x[int(((x - far) ** 2).sum(1).argmax())]
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argsort(x @ (other - far), kind="stable")]
                stack.append((a + middle, b, node))
                stack.append((a, a + middle, -1))
        self.ids, self.vectors = ids[order], vectors[order]
        self.centre, self.radius, self.second = np.array(self.centre), np.array(self.radius), np.array(self.second)


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.query_ids, self.queries, self.k = ids, vectors, k
        self.norms = np.sqrt((vectors**2).sum(1))
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.held = np.zeros(len(ids), np.int64)
        self.kth = np.full(len(ids), -np.inf) if kth is None else kth.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates ids with their scores for the queries rows; only queries that one of them may serve are touched."""
        r, c = np.nonzero(scores >= self.kth[rows][:, None])
        own = ids[c] != self.query_ids[rows[r]]
        r, c = r[own], c[own]
        if not len(r):
            return
        touched, r_new = np.unique(r, return_inverse=True)
        at, k = rows[touched], self.k
        row = np.concatenate([np.repeat(np.arange(len(at)), k), r_new])
        score = np.concatenate([self.score[at].ravel(), scores[r, c].astype(np.int64)])
        vec = np.concatenate([self.id[at].ravel(), ids[c]])
        order = np.lexsort((vec, -np.maximum(score, -(2**63) + 1), row))
        sizes = k + np.bincount(r_new, minlength=len(at))
        pick = order[(np.cumsum(sizes) - sizes)[:, None] + np.arange(k)]
        self.score[at], self.id[at] = score[pick], vec[pick]
        self.held[at] = np.minimum(k, self.held[at] + sizes - k)
        full = self.held[at] == k
        self.kth[at[full]] = self.score[at[full], -1]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidates' ids, scores."""
        some = np.arange(self.k) < self.held[:, None]
        return np.repeat(self.query_ids, self.held), self.id[some], self.score[some]

    def search(self, tree: BallTree) -> int:
        """Goes through the tree; how many leaves were scored (each counted once for every set of queries)."""
        bound = self.queries @ tree.centre.T + self.norms[:, None] * tree.radius
        bound += 1e-9 * np.abs(bound) + 1e-6
        scored = 0
        stack = [(0, np.arange(len(self.query_ids)))]
        while stack:
            node, rows = stack.pop()
            rows = rows[bound[rows, node] >= self.kth[rows]]
            if not len(rows):
                continue
            second = tree.second[node]
            if second < 0:
                a, b = tree.span[node]
                self.add(rows, _products(self.queries[rows], tree.vectors[a:b]), tree.ids[a:b])
                scored += 1
                continue
            first_better = bound[rows, node + 1] >= bound[rows, second]
            # What is pushed last is gone through first.
            stack += [(node + 1, rows[~first_better]), (second, rows[~first_better]), (second, rows[first_better]), (node + 1, rows[first_better])]
        return scored


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what float64 holds exactly they are made with whole numbers, held to a long."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return q @ x.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object)
    exact = whole(q) @ whole(x).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def scaled(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) as doubles; null where a component is null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & fine, F.transform(embedding, lambda x: x.cast("double") * scale))


class Cells:
    """A tree of hyperplanes: the largest cell of a sample is halved until there are so many."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.direction, self.cut, self.child = [], [], []
        leaves, self.share = [(np.arange(len(sample)), None)], []
        done = []
        while leaves and len(leaves) + len(done) < cells:
            rows, parent = leaves.pop(max(range(len(leaves)), key=lambda k: len(leaves[k][0])))
            x = sample[rows]
            far = x[int(((x - x.mean(0)) ** 2).sum(1).argmax())]
            other = x[int(((x - far) ** 2).sum(1).argmax())]
            along = x @ (other - far)
            cut = float(np.median(along))
            if len(rows) < 16 or not (along > cut).any():
                done.append((rows, parent))
                continue
            node = len(self.cut)
            self.direction.append(other - far)
            self.cut.append(cut)
            self.child.append([0, 0])
            if parent:
                self.child[parent[0]][parent[1]] = node
            leaves += [(rows[along <= cut], (node, 0)), (rows[along > cut], (node, 1))]
        for cell, (rows, parent) in enumerate(leaves + done):
            if parent:
                self.child[parent[0]][parent[1]] = -1 - cell
            self.share.append(len(rows) / max(1, len(sample)))
        self.direction, self.cut, self.child = np.array(self.direction), np.array(self.cut), np.array(self.child, np.int64)

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.cut) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]):
                rows = inner[at[inner] == node]
                at[rows] = self.child[node, (x[rows] @ self.direction[node] > self.cut[node]).astype(np.int64)]
        return -1 - at


class Parts:
    """Cells of each vector length, and in how many parts of about GROUP vectors each is dealt by a hash of the ids."""

    def __init__(self, sample: dict[int, np.ndarray], n: int):
        total, self.cells, self.first, self.salts, parts = sum(map(len, sample.values())), {}, {}, {}, 0
        for dim, x in sorted(sample.items()):
            own = n * len(x) / total
            self.cells[dim] = Cells(x, max(1, min(CELLS, math.ceil(own / CELL))))
            self.salts[dim] = np.array([max(1, math.ceil(share * own / GROUP)) for share in self.cells[dim].share], np.int64)
            self.first[dim] = parts + np.cumsum(self.salts[dim]) - self.salts[dim]
            parts += int(self.salts[dim].sum())
        # Lengths that the sample lacks have a part each row's hash picks among a few.
        self.rest, self.n = parts, parts + 16

    def of(self, dim: int, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        if dim not in self.cells:
            return self.rest + (mixed % np.uint64(16)).astype(np.int64)
        cell = self.cells[dim].of(x)
        return self.first[dim][cell] + (mixed % self.salts[dim][cell].astype(np.uint64)).astype(np.int64)


def _by_dim(batch: pa.RecordBatch):
    """(length, rows, their vectors) for each length of vectors in a batch."""
    values = batch.column("v")
    flat = np.floor(values.flatten().to_numpy(zero_copy_only=False))
    sizes = batch.column("dim").to_numpy(zero_copy_only=False)
    begins = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, flat[begins[rows][:, None] + np.arange(dim)]


def _dealt(shared):
    def work(batches):
        parts = pickle.loads(shared.value)
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.zeros(len(ids), np.int64)
            for dim, rows, x in _by_dim(batch):
                part[rows] = parts.of(dim, ids[rows], x)
            yield record_batch(part=part, vec_id=ids, dim=batch.column("dim"), v=batch.column("v"))

    return work


def _shards(batches):
    """Rows sorted by part, dim, id -> shards: their balls and their trees, of at most GROUP rows at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key, count, nth = None, 0, 0

    def flush():
        nonlocal held, count, nth
        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        held, count = [], 0
        whole = BallTree(ids, x, SHARD)
        for (a, b), second in zip(whole.span, whole.second.tolist(), strict=True):
            if second < 0:
                tree = BallTree(whole.ids[a:b], whole.vectors[a:b])
                ball = np.append(tree.centre[0], tree.radius[0]).tobytes()
                yield record_batch(shard=[key[0] << 24 | nth], dim=[key[1]], ball=[ball], tree=[pickle.dumps(tree, protocol=5)])
                nth += 1

    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        for dim, rows, x in _by_dim(batch):
            own = parts[rows]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key != (int(own[a]), dim):
                    if held:
                        yield from flush()
                    nth = nth if key and key[0] == int(own[a]) else 0
                    key = (int(own[a]), dim)
                for at in range(a, b, GROUP):
                    held.append((ids[rows[at : min(b, at + GROUP)]], x[at : min(b, at + GROUP)]))
                    count += len(held[-1][0])
                    if count >= GROUP:
                        yield from flush()
    if held:
        yield from flush()


def _packs(balls: DataFrame):
    """The balls by length of vectors, a bounded pack at a time: shards, centres, radii."""
    held, size = {}, 0

    def pack():
        return {dim: (np.array([s for s, _ in own]), *np.split(np.stack([b for _, b in own]), [-1], axis=1)) for dim, own in held.items()}

    for row in balls.toLocalIterator():
        held.setdefault(row.dim, []).append((row.shard, np.frombuffer(row.ball)))
        size += len(row.ball)
        if size >= PACK_BYTES:
            yield pack()
            held, size = {}, 0
    if held:
        yield pack()


def _routed(shared, first: bool):
    """Queries -> (shard, n, blob of their ids, vectors and kth scores): the first shards of each, or all others that its kth score admits."""

    def work(batches):
        pack = pickle.loads(shared.value)
        waiting: dict[int, list] = {}
        count = 0

        def flush():
            for shard, own in waiting.items():
                ids, x, kth = (np.concatenate([o[k] for o in own]) for k in range(3))
                yield record_batch(shard=[shard], n=[len(ids)], blob=[pickle.dumps((ids, x, kth), protocol=5)])
            waiting.clear()

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            kth = np.array([-np.inf if v is None else v for v in batch.column("kth").to_pylist()]) if not first else np.full(len(ids), -np.inf)
            seen = batch.column("seen").to_pylist() if not first else None
            for dim, rows, x in _by_dim(batch):
                if dim not in pack:
                    continue
                shards, centres, radii = pack[dim]
                place = {int(s): k for k, s in enumerate(shards)}
                step = max(1, (32 << 20) // (8 * len(shards)))
                for at in range(0, len(rows), step):
                    some, q = rows[at : at + step], x[at : at + step]
                    bound = q @ centres.T + np.sqrt((q**2).sum(1))[:, None] * radii.T
                    bound += 1e-9 * np.abs(bound) + 1e-6
                    if first:
                        ask = np.zeros(bound.shape, bool)
                        most = min(FIRST, len(shards))
                        np.put_along_axis(ask, np.argpartition(-bound, most - 1, axis=1)[:, :most], True, axis=1)
                    else:
                        ask = bound >= kth[some][:, None]
                        for k, r in enumerate(some.tolist()):
                            ask[k, [place[s] for s in seen[r] or () if s in place]] = False
                    for k in np.flatnonzero(ask.any(0)).tolist():
                        own = ask[:, k]
                        waiting.setdefault(int(shards[k]), []).append((ids[some[own]], q[own], kth[some[own]]))
                    count += int(ask.sum())
                    if count >= QUERY_BLOCK * 16:
                        yield from flush()
                        count = 0
        yield from flush()

    return work


def _answers(k: int):
    """Rows sorted by shard, copy, kind: a shard's tree, then its queries."""

    def work(batches):
        tree = shard = None
        for batch in batches:
            for n, (number, kind) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                found = pickle.loads(batch.column("blob")[n].as_buffer())
                if kind == 0:
                    tree, shard = found, number
                    continue
                ids, x, kth = found
                for at in range(0, len(ids), QUERY_BLOCK):
                    some = slice(at, at + QUERY_BLOCK)
                    best = Best(ids[some], x[some], k, kth[some])
                    best.search(tree)
                    query, vec, score = best.result()
                    if len(query):
                        yield record_batch(query_id=query, vec_id=vec, score=score, shard=np.full(len(query), shard))

    return work


def answered(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Trees and queries brought together: query_id, vec_id, score, shard."""
    hot = asked.groupBy("shard").agg(F.ceil(F.sum("n") / ASKED).cast("int").alias("copies")).where("copies > 1")
    trees, asking = shards.select("shard", F.col("tree").alias("blob")), asked.select("shard", "blob")
    if hot.isEmpty():
        trees, asking = (t.withColumn("copy", F.lit(0)) for t in (trees, asking))
    else:
        trees = trees.join(hot, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        asking = asking.join(hot, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("blob"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    both = trees.withColumn("kind", F.lit(0)).unionByName(asking.withColumn("kind", F.lit(1)))
    both = both.repartition(partitions(shards, 8 << 20), "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return arrow_map(both, _answers(k), "query_id long, vec_id long, score long, shard long")


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, its k best among all the others."""
    spark = vectors.sparkSession
    kept = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), scale).alias("v"), is_query.alias("is_query"))
    kept = kept.where(F.col("v").isNotNull()).withColumn("dim", F.size("v").cast("long"))
    if not kept.groupBy("dim", "vec_id").count().where("count > 1").isEmpty():
        kept = kept.groupBy("dim", "vec_id").agg(F.min("v").alias("v"), F.bool_or("is_query").alias("is_query"))
    n = kept.select("vec_id").count()
    sample: dict[int, list] = {}
    for row in kept.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toLocalIterator():
        sample.setdefault(len(row.v), []).append(row.v)
    parts = Parts({dim: np.floor(np.array(rows, np.float64).reshape(len(rows), dim)) for dim, rows in sample.items()}, n)

    dealt = arrow_map(kept.select("vec_id", "dim", "v"), _dealt(spark.sparkContext.broadcast(pickle.dumps(parts))), "part long, vec_id long, dim long, v array<double>")
    dealt = dealt.repartition(max(1, min(parts.n, MAX_PARTITIONS)), "part").sortWithinPartitions("part", "dim", "vec_id")
    folder = new_folder(spark, "trees")
    arrow_map(dealt, _shards, "shard long, dim long, ball binary, tree binary").write.parquet(folder)
    shards = spark.read.parquet(folder)

    def routed(queries: DataFrame, first: bool) -> DataFrame:
        asked = []
        for pack in _packs(shards.select("shard", "dim", "ball")):
            shared = spark.sparkContext.broadcast(pickle.dumps(pack))
            asked.append(materialised(arrow_map(queries, _routed(shared, first), "shard long, n long, blob binary")))
            shared.unpersist()
        return reduce(DataFrame.unionByName, asked) if asked else arrow_map(queries.limit(0), lambda batches: iter(()), "shard long, n long, blob binary")

    queries = kept.where("is_query").select("vec_id", "dim", "v")
    found = materialised(answered(shards.select("shard", "tree"), routed(queries, True), k))
    # At most FIRST * k scores of a query for each pack.
    kth = found.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1)).cast("double").alias("kth"), F.collect_set("shard").alias("seen"))
    again = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    more = answered(shards.select("shard", "tree"), routed(again, False), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = found.unionByName(more).select("query_id", "vec_id", "score")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
