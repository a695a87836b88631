"""Connected components of an edge table, by alternating stars, all in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialised, record_batch

#: For at_once: edges that a task contracts in some tens of MB.
AT_ONCE = 1 << 18


def _contracted(batches):
    """Each batch's edges as stars: every node with the least node it is connected to within the batch."""
    for batch in batches:
        a = batch.column("a").to_numpy(zero_copy_only=False)
        b = batch.column("b").to_numpy(zero_copy_only=False)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        left, right = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[left], root[right])
            new = root.copy()
            np.minimum.at(new, root[left], low)
            np.minimum.at(new, root[right], low)
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        inner = root != np.arange(len(nodes))
        yield record_batch(a=nodes[inner], b=nodes[root[inner]])


def _all_contracted(batches):
    """node, root of all batches' edges together."""
    edges = pa.Table.from_batches(list(batches), pa.schema([("a", pa.int64()), ("b", pa.int64())])).combine_chunks()
    for stars in _contracted(edges.to_batches()):
        node, root = (stars.column(n).to_numpy(zero_copy_only=False) for n in ("a", "b"))
        roots = np.unique(root)
        yield record_batch(node=np.concatenate([node, roots]), root=np.concatenate([root, roots]))


def components(edges: DataFrame, max_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b), both long.

    Stars are drawn in turn to the least larger-side and smaller-side neighbour until nothing changes; each
    round is written to the shared folder. Minima are aggregated before the shuffle. As soon as at_once edges or fewer are left, one
    task contracts them instead, with the same result: rounds over few edges cost many tasks and files."""
    rows = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    rows = arrow_map(rows, _contracted, "a long, b long").distinct()
    rows, before = materialised(rows), None
    for _ in range(max_rounds):
        state = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == before or not state.n:
            break
        if state.n <= at_once:
            return materialised(arrow_map(rows.coalesce(1), _all_contracted, "node long, root long"))
        before = (state.n, state.h)
        both = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Written first, so that the join meets plain rows on either side and a node with very many edges can be split.
        least = materialised(least)
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        rows = materialised(small.distinct())
    else:
        raise RuntimeError("components did not settle")
    stars = rows.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
