"""Shuffled shards by a two-pass external shuffle.

Pass one scatters the rows into buckets by a seeded hash, as many buckets as keep each within memory. Pass two
puts a bucket into the order of its hashes, which does not depend on how rows arrived, gives it a Fisher-Yates
shuffle seeded by the bucket, and writes it. Buckets follow each other in the whole order, whose places are
dealt to the shards in turn: shard = place mod shards, slot = place div shards. So counts of shards are at most
one apart (the law `rows`) and slots have no gaps.

Defined results: a null text has no bytes; ids and texts scatter rows together, so rows of one id lie apart and null ids are no
exception; rows repeated with one id and one
text land in one bucket, in an order that does not matter, as they are equal. An empty table gives no rows. The law says nothing about
rows of equal texts: each is a row like any other.
All columns of the input are written, whatever their names; shard and slot are put in a struct `place` beside
the input's columns in a struct `row`, so that no name clashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_PARTITIONS, arrow_map, by_part, new_folder, parts_of, plan_bytes, quoted, whole_row

#: Bytes of a bucket as the optimizer sees the input (Parquet's); in memory it is several times that.
BUCKET_BYTES = 16 << 20


def _fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform order of n places: for i from the last down, swap i with a random place up to i."""
    order = np.arange(n)
    if n > 1:
        picks = np.random.default_rng(seed).integers(0, np.arange(n, 1, -1))
        values = order.tolist()
        for i, j in zip(range(n - 1, 0, -1), picks.tolist(), strict=True):
            values[i], values[j] = values[j], values[i]
        order = np.array(values)
    return order


def _shuffled(seed: int, offsets, n_shards: int):
    """Rows by bucket and hash -> each bucket's rows in their new order with their places."""

    def finish(parts: list[pa.RecordBatch], bucket: int):
        table = pa.Table.from_batches(parts)
        order = _fisher_yates(table.num_rows, (seed << 32) ^ bucket)
        place = np.arange(table.num_rows) + int(offsets.value[bucket])
        rows = table.column("row").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        for at in range(0, len(order), 1024):
            some = order[at : at + 1024]
            p = place[at : at + 1024]
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(some)), pa.StructArray.from_arrays([pa.array((p % n_shards).astype(np.int32)), pa.array(p // n_shards)], ["shard", "slot"])], ["row", "place"])

    def work(batches):
        held, now = [], None
        for batch in batches:
            buckets = batch.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if now is not None and buckets[a] != now:
                    yield from finish(held, now)
                    held = []
                now = int(buckets[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from finish(held, now)

    return work


def external_shuffle(rows: DataFrame, n_shards: int, seed: int = 7, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """Writes the shards and returns them as written: row (the input's columns), place (shard, slot)."""
    if n_shards < 1:
        raise ValueError("at least one shard")
    spark = rows.sparkSession
    n = parts_of(rows, bucket_bytes, text)
    h = F.xxhash64(F.col(quoted(doc_id)), F.lit(seed), F.col(quoted(text)))
    bucket = F.pmod(h, F.lit(n)).cast("int")
    # One count for each bucket, 12 bytes in an Arrow column; their number is the input's size by the bucket's.
    counts = np.zeros(n + 1, np.int64)
    found = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).toArrow()
    counts[found.column("b").to_numpy() + 1] = found.column("k").to_numpy()
    offsets = spark.sparkContext.broadcast(np.cumsum(counts)[:-1])
    keyed = rows.select(whole_row(rows).alias("row"), bucket.alias("part"), h.alias("h"))
    keyed = by_part(keyed, n, "h", F.col(f"row.{quoted(text)}")).select("part", "row")
    place = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    # A file holds several buckets where the session asks for ones far smaller than bucket_bytes: each file costs helper processes.
    files = max(math.ceil(4 * (plan_bytes(rows) or 0) / bucket_bytes) or n, 2 * spark.sparkContext.defaultParallelism)
    keyed = keyed.coalesce(min(files, n, MAX_PARTITIONS))
    placed = arrow_map(keyed, _shuffled(seed, offsets, n_shards), T.StructType([T.StructField("row", keyed.schema["row"].dataType), T.StructField("place", place)]))
    folder = folder or new_folder(spark, "shards")
    placed.write.parquet(folder)
    return spark.read.parquet(folder)


def save_shards(shards: DataFrame, folder: str) -> None:
    """Each shard's rows (column row) in a folder of its own, in the order of their slots within each file."""
    shards.repartition("place.shard").sortWithinPartitions("place.shard", "place.slot").select(F.col("place.shard").alias("shard"), "row").write.partitionBy("shard").parquet(folder)
