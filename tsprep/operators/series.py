"""The canonical frame (series_id, ts, y) and what is done to its time axis: buckets, duplicates, spines, joins.

All windows are partitioned by series_id. A single series too long for one task goes through `ranged_positions`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar

def by_time():
    return Window.partitionBy("series_id").orderBy("ts")

def whole_series():
    return Window.partitionBy("series_id")


POLICIES = ("sum", "mean", "first", "last")


def number(value: Column) -> Column:
    """As a double, with NaN as null: aggregates skip it then."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def canonical(df: DataFrame, ts: str, y: str, series_id: str | Column | None = None) -> DataFrame:
    key = F.lit("all") if series_id is None else (F.col(series_id) if isinstance(series_id, str) else series_id).cast("string")
    return df.select(key.alias("series_id"), F.col(ts).cast("timestamp_ntz").alias("ts"), number(F.col(y)).alias("y"))


def from_values(spark, values, series_id: str = "all") -> DataFrame:
    """A list of numbers, or of (time, number) pairs, as a series; plain numbers lie a day apart from 1970 on."""
    if not isinstance(values, list | tuple) and not hasattr(values, "tolist"):
        raise TypeError("a series is a list, a tuple or an array")
    values = values.tolist() if hasattr(values, "tolist") else list(values)
    pairs = bool(values) and isinstance(values[0], list | tuple)
    rows = [(k, *(v if pairs else (None, v))) for k, v in enumerate(values)]
    rows = [(k, t, None if v is None else float(v)) for k, t, v in rows]
    df = spark.createDataFrame(rows, "k int, t timestamp_ntz, v double")
    ts = F.coalesce("t", calendar.ntz(F.date_from_unix_date("k")))
    return df.select(F.lit(series_id).alias("series_id"), ts.alias("ts"), number(F.col("v")).alias("y"))


def with_position(series: DataFrame) -> DataFrame:
    """pos: the row's place in its series, from 0."""
    return series.withColumn("pos", F.row_number().over(by_time()).cast("long") - 1)


def present(series: DataFrame) -> DataFrame:
    return series.where("y IS NOT NULL")


MAX_RANGES = 512


def in_ranges(df: DataFrame, order: Column, n_ranges: int | None = None) -> DataFrame:
    """df with __range: which of n stretches of the order (whole numbers) a row lies in; the ends are approximate quantiles.

    A row's place is looked up by halving, a step for each doubling of n: with a comparison for each end the work would grow with
    rows times ranges, and the code beyond what the JVM compiles. Nulls are in the first."""
    n = min(MAX_RANGES, n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ends = df.agg(F.percentile_approx(order, [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    ends = sorted({int(e) for e in ends})
    table = F.array(*[F.lit(e).cast("long") for e in ends])
    placed = df.withColumn("__range", F.lit(0))
    for step in (1 << k for k in reversed(range(len(ends).bit_length()))):
        # Beyond the last end there is a null, which is not passed. A column of its own for each step: nested, they would double.
        passed = F.get(table, F.col("__range") + (step - 1)) <= order
        placed = placed.withColumn("__range", F.col("__range") + F.when(passed, step).otherwise(0))
    return placed


def ranged_positions(series: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """Places in long series without gathering them: rows are placed within ranges of time, and the counts of the ranges before are added.

    The counts are one row for each range and series. Ties of ts stay in some order."""
    ranged = in_ranges(series, calendar.micros(F.col("ts")), n_ranges)
    counts = ranged.groupBy("series_id", "__range").count()
    before = Window.partitionBy("series_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))).drop("count")
    inside = Window.partitionBy("series_id", "__range").orderBy("ts")
    local = ranged.withColumn("__local", F.row_number().over(inside).cast("long") - 1)
    return local.join(counts, ["series_id", "__range"]).withColumn("pos", F.col("__before") + F.col("__local")).drop("__range", "__before", "__local")


def with_previous(df: DataFrame, keys: list[str], order: str, value: str | list[str], n_ranges: int | None = None) -> DataFrame:
    """df with `before`, the value of the row before by order (a whole number) within the keys, without gathering a key's rows; of several values, a struct.

    Within a range it is a window's lag; the first row of a range gets the last value of the range before."""
    values = [value] if isinstance(value, str) else value
    row = F.struct(*values)
    ranged = in_ranges(df, F.col(order).cast("long"), n_ranges)
    local = ranged.withColumn("__lag", F.lag(row).over(Window.partitionBy(*keys, "__range").orderBy(order)))
    # Each value by itself, as an aggregate that holds a struct would have all rows sorted.
    lasts = ranged.groupBy(*keys, "__range").agg(*[F.max_by(v, order).alias(v) for v in values])
    across = Window.partitionBy(*keys).orderBy("__range") if keys else Window.partitionBy(F.lit(0)).orderBy("__range")
    lasts = lasts.select(*keys, "__range", F.lag(row).over(across).alias("__last"))
    before = F.coalesce("__lag", "__last")
    joined = local.join(lasts, [*keys, "__range"])
    return joined.withColumn("before", before[value] if isinstance(value, str) else before).drop("__range", "__lag", "__last")


def ranged_rolling(series: DataFrame, window: int, block: int = 100_000, n_ranges: int | None = None) -> DataFrame:
    """rolling_mean and rolling_var of long series, a block of rows at a time; each block sees the rows that its first windows need."""
    if block < window:
        raise ValueError("a block holds a window at least")
    placed = ranged_positions(series, n_ranges).withColumn("__block", F.call_function("div", F.col("pos"), F.lit(block)))
    early = (F.col("pos") % block) >= block - (window - 1)
    both = F.when(early, F.array(F.col("__block"), F.col("__block") + 1)).otherwise(F.array(F.col("__block")))
    spread = placed.withColumn("__in", F.explode(both))
    w = Window.partitionBy("series_id", "__in").orderBy("pos").rowsBetween(-(window - 1), 0)
    enough = F.count("y").over(w) >= max(2, window // 3)
    done = spread.withColumn("rolling_mean", F.when(enough, F.avg("y").over(w))).withColumn("rolling_var", F.when(enough, F.var_samp("y").over(w)))
    return done.where(F.col("__in") == F.col("__block")).select("series_id", "ts", "rolling_mean", "rolling_var", F.lit(window).alias("window"))


def resample(series: DataFrame, rule: str, how: str = "sum") -> DataFrame:
    """One value for each bucket that has any; everything but "mean" sums. Buckets without values are left out."""
    f = calendar.frequency(rule)
    if f.micros and f.count > 1:
        origin = series.groupBy("series_id").agg(calendar.ntz(F.min("ts").cast("date")).alias("__origin"))
        series = series.join(origin, "series_id")
        label = calendar.bucket_label(F.col("ts"), rule, F.col("__origin"))
    else:
        label = calendar.bucket_label(F.col("ts"), rule)
    value = F.avg("y") if how == "mean" else F.sum("y")
    return series.groupBy("series_id", label.alias("ts")).agg(value.alias("y")).where("y IS NOT NULL")


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def deduplicate(df: DataFrame, keys: list[str], policy: str = "sum", order: str | Column = "__rid") -> DataFrame:
    """One row for each key: sums or means of numbers with the first value of everything else, or the first or last row.

    A sum over nulls only is 0. Columns come as keys, numbers, others."""
    if policy not in POLICIES:
        raise ValueError(f"unknown duplicate policy: {policy}")
    order = F.col(order) if isinstance(order, str) else order
    if policy in ("first", "last"):
        w = Window.partitionBy(*keys).orderBy(order.asc() if policy == "first" else order.desc())
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    rest = [f for f in df.schema if f.name not in keys]
    numbers = [f.name for f in rest if is_number(f.dataType) and f.name != "__rid"]
    others = [f.name for f in rest if f.name not in numbers]
    total = (lambda c: F.coalesce(F.sum(c), F.lit(0))) if policy == "sum" else F.avg
    return df.groupBy(*keys).agg(*[total(F.col(f"`{c}`")).alias(c) for c in numbers], *[F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), order)).alias(c) for c in others])


def bounds(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))


#: Points of a calendar that one row makes.
SPINE_STEP = 10_000


def between(ends: DataFrame, freq: str, step: int = SPINE_STEP) -> DataFrame:
    """All points of the calendar from start to end for each row (series_id, start, end).

    Of frequencies of fixed length, of which there can be very many points, stretches of `step` are made first, dealt over tasks, and filled there."""
    every = calendar.frequency(freq).micros
    if not every:
        return ends.select("series_id", F.explode(calendar.spine_array(F.col("start"), F.col("end"), freq)).alias("ts"))
    last = F.call_function("div", calendar.micros(F.col("end")) - calendar.micros(F.col("start")), F.lit(every))
    parts = ends.where("start IS NOT NULL").select("series_id", "start", last.alias("last"))
    parts = parts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(step).cast("long")))).repartition("series_id", "first")
    points = parts.select("series_id", "start", F.explode(F.sequence("first", F.least(F.col("first") + step - 1, F.col("last")))).alias("k"))
    return points.select("series_id", calendar.plus_micros(F.col("start"), F.col("k") * every).alias("ts"))


def spine(series: DataFrame, freq: str) -> DataFrame:
    """All points of the calendar between each series' ends."""
    return between(bounds(series), freq)


def missing_dates(series: DataFrame, freq: str) -> DataFrame:
    return spine(series, freq).join(series.select("series_id", "ts").distinct(), ["series_id", "ts"], "left_anti")


def reindex(series: DataFrame, freq: str) -> DataFrame:
    """The series on the calendar: rows for all its points, none for others."""
    return spine(series, freq).join(series, ["series_id", "ts"], "left")


def align(y: DataFrame, exog: DataFrame | None) -> DataFrame | None:
    """exog on y's times, null where it has none."""
    return None if exog is None else y.select("series_id", "ts").join(exog, ["series_id", "ts"], "left")


def deltas(series: DataFrame) -> DataFrame:
    """Microseconds from each time to the next."""
    at = calendar.micros(F.col("ts"))
    return series.select("series_id", "ts", (at - F.lag(at).over(by_time())).alias("delta_us")).where("delta_us IS NOT NULL")


def dominant_delta(series: DataFrame) -> DataFrame:
    """The most frequent gap of each series (of equals the one seen first), its count and its share."""
    at = calendar.micros(F.col("ts"))
    gaps = series.select("series_id", (at - F.lag(at).over(by_time())).alias("delta_us"), F.row_number().over(by_time()).alias("n")).where("delta_us IS NOT NULL")
    counted = gaps.groupBy("series_id", "delta_us").agg(F.count("*").alias("count"), F.min("n").alias("first"))
    best = F.max_by("delta_us", F.struct("count", -F.col("first")))
    return counted.groupBy("series_id").agg(best.alias("delta_us"), F.max("count").alias("count"), (F.max("count") / F.sum("count")).alias("share"))
