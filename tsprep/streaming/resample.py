"""Time buckets of a stream: an extension of the batch resample, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.series import number


def stream_resample(events: DataFrame, ts: str, y: str, width: str, late: str, how: str = "sum", series_id: str | None = None) -> DataFrame:
    """series_id, ts (a bucket's start), y from a streaming frame; rows later than `late` are left out.

    In append mode a bucket comes out once, when the watermark has passed its end. Bucket widths are fixed: hours, minutes, days."""
    key = F.lit("all") if series_id is None else F.col(series_id).cast("string")
    rows = events.select(F.col(ts).cast("timestamp").alias("ts"), key.alias("series_id"), number(F.col(y)).alias("y")).withWatermark("ts", late)
    value = F.avg("y") if how == "mean" else F.sum("y")
    out = rows.groupBy(F.window("ts", width), "series_id").agg(value.alias("y"))
    return out.where("y IS NOT NULL").select("series_id", F.col("window.start").cast("timestamp_ntz").alias("ts"), "y")
