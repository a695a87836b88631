"""What the corpus operators share: sizing, the shared folder, Arrow plumbing."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tsprep-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's size of df; None where it has no idea, as of checkpoints, or only a product of what a join reads."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


#: Partitions of a shuffle at most; beyond it, several parts of the data follow each other in one partition.
MAX_PARTITIONS = 20_000


def parts_of(df: DataFrame, bytes_each: int, text: str | None = None) -> int:
    """In how many parts to work on df: the session's shuffle partitions, more if the input's size asks for it.

    Where the optimizer does not know the size, the bytes of the column text are counted (as half as many on disk)."""
    size = plan_bytes(df)
    if size is None and text is not None:
        size = (df.agg(F.sum(F.octet_length(quoted(text)))).first()[0] or 0) // 2
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / bytes_each))


def partitions(df: DataFrame, bytes_each: int) -> int:
    return min(parts_of(df, bytes_each), MAX_PARTITIONS)


def by_part(df: DataFrame, n: int, *then) -> DataFrame:
    """Rows with a column part (0 to n-1) in partitions that hold a part each, or several in a row; sorted by part and then."""
    spread = df.repartitionById(n, F.col("part")) if n <= MAX_PARTITIONS else df.repartition(MAX_PARTITIONS, "part")
    return spread.sortWithinPartitions("part", *then)


def each_part(work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work on the batches of each part by itself; rows come sorted by part."""

    def pieces(batches):
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield int(part[a]), batch.slice(a, b - a)

    def run(batches):
        source = pieces(batches)
        head = next(source, None)
        while head is not None:
            now = head[0]

            def own(now=now):
                nonlocal head
                while head is not None and head[0] == now:
                    batch = head[1]
                    head = next(source, None)
                    yield batch

            group = own()
            yield from work(group)
            for _ in group:
                pass

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def give_back() -> None:
    """Returns freed memory to the system: a worker is used again and would hold the most that any of its tasks took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow; a task gives freed memory back when it ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def rows_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """arrow_map over all columns, which may have any names, as work finds them by their places."""
    return arrow_map(df.toDF(*(f"c{k}" for k in range(len(df.columns)))), work, schema)


def quoted(name: str) -> str:
    """A column's name as an expression sees it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front of it until df has no column like it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one struct, where no name can clash with another."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def slices(batches: Iterable[pa.RecordBatch], column: str | int, rows: int = 1024, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has few rows and, unless a single value is larger, few bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        values = batch.column(column)
        offsets = np.frombuffer(values.buffers()[1], np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32)[values.offset : values.offset + len(values) + 1]
        sizes = np.diff(offsets.astype(np.int64))
        total, at = np.concatenate([[0], np.cumsum(sizes)]), 0
        while at < batch.num_rows:
            end = int(np.searchsorted(total, total[at] + max_bytes, side="right")) - 1
            end = min(max(end, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def group_bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def crc32_text(value: Column) -> Column:
    return F.crc32(value.cast("binary"))
