"""From a raw table to a clean series: parse, drop, sort, de-duplicate, infer the frequency, find or fill the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar, dates, frequency
from ..model import SchemaMetadata, TimeSeriesMeta
from .roles import INDEX, ORDER, first_text, is_time
from .series import POLICIES, between, deduplicate

MISSING = ("report", "reindex")


class TimeSeriesCleaner:
    """duplicates: sum, mean, first or last; missing: report or reindex; freq overrides what is inferred."""

    def __init__(self, df: DataFrame, schema: SchemaMetadata, freq: str | None = None, duplicates: str = "sum", missing: str = "report", date_format: str | None = None, index_col: str | None = None, calendar_fallback: bool = False):
        if missing not in MISSING:
            raise ValueError(f"unknown policy for missing dates: {missing}")
        if freq:
            calendar.frequency(freq)
        self.df, self.schema, self.freq, self.duplicates, self.missing = df, schema, freq, duplicates, missing
        self.date_format, self.index_col, self.calendar_fallback = date_format, index_col, calendar_fallback
        self.notes: list[str] = []

    def clean(self) -> tuple[DataFrame, TimeSeriesMeta]:
        """The clean frame, its time in the column `ts`, and what was found. Rows of a time lie together, not necessarily in order.

        All that is found out comes from the axis (each time with its count), which one pass over the rows makes."""
        rows = self._parsed()
        axis = rows.groupBy("ts").agg(F.count("*").alias("rows")).persist()
        try:
            return self._cleaned(rows, axis)
        finally:
            axis.unpersist()

    def _cleaned(self, rows: DataFrame, axis: DataFrame) -> tuple[DataFrame, TimeSeriesMeta]:
        good = F.col("ts").isNotNull()
        found = axis.agg(F.sum("rows").alias("n"), F.sum(F.when(good, F.col("rows"))).alias("good"), F.max(F.when(good, F.col("rows"))).alias("most"), F.count("ts").alias("times"), F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        if not found.good:
            raise ValueError(f"no value of '{self._column}' parses as a date")
        if found.n > found.good:
            self.notes.append(f"Dropped {found.n - found.good} rows whose date does not parse.")
            rows = rows.where(good)
        if found.most > 1:
            rows = self._unique(rows)
        keyed = axis.where(good).select(F.lit("all").alias("series_id"), "ts")
        freq, regular = self._frequency(keyed)
        start, end, n, n_missing = found.a, found.b, found.times, 0
        if freq is not None and freq != "bh" and not freq.startswith("WOM"):
            rows, (start, end, n), n_missing = self._gaps(rows, keyed, freq, found)
        if not n:
            raise ValueError("nothing is left after cleaning")
        return rows, TimeSeriesMeta(self.schema.date_col, self.schema.target_col, list(self.schema.exog_cols), start, end, freq, n, n_missing > 0, n_missing, found.most > 1, list(self.notes), regular)

    @property
    def _column(self) -> str | None:
        return self.index_col if self.schema.date_col == INDEX else self.schema.date_col

    def _parsed(self) -> DataFrame:
        column = self._column
        if column is None:
            raise ValueError("a series needs a date column")
        kind = self.df.schema[column].dataType
        if is_time(kind):
            ts = F.col(f"`{column}`").cast("timestamp_ntz")
        else:
            form = dates.spark_format(self.date_format) if self.date_format else dates.guess_format(first_text(self.df, column))
            ts = dates.parse(dates.text_of(F.col(f"`{column}`"), kind.simpleString()), form)
        rows = self.df.withColumn("__ts", ts)
        rows = rows.drop(column).withColumnRenamed("__ts", "ts")
        floats = [f.name for f in rows.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
        return rows.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else rows

    def _unique(self, rows: DataFrame) -> DataFrame:
        self.notes.append(f"Duplicate dates were resolved by '{self.duplicates}'.")
        if self.duplicates not in POLICIES:
            raise ValueError(f"unknown duplicate policy: {self.duplicates}")
        return deduplicate(rows if ORDER in rows.columns else rows.withColumn(ORDER, F.monotonically_increasing_id()), ["ts"], self.duplicates).drop(ORDER)

    def _frequency(self, keyed: DataFrame) -> tuple[str | None, bool]:
        if self.freq:
            return self.freq, True
        f = frequency.axis_facts(keyed, long=True).first().asDict()
        if f["rows"] < 3:
            self.notes.append("Too few dates to infer a frequency.")
            return None, False
        name = frequency.infer(f)
        if name:
            return name, True
        self.notes.append("The dates are irregular; the most frequent gap decides if nearly all are like it.")
        name = frequency.fallback(f)
        if name is None and self.calendar_fallback and f["cs"]:
            name = "MS"
        return name, False

    def _gaps(self, rows: DataFrame, keyed: DataFrame, freq: str, found) -> tuple[DataFrame, tuple, int]:
        """The rows, on the calendar where that is asked for; their ends and number; how many dates are missing."""
        ends = self.df.sparkSession.createDataFrame([("all", found.a, found.b)], "series_id string, start timestamp_ntz, end timestamp_ntz")
        points = between(ends, freq)
        both = points.withColumn("point", F.lit(1)).join(keyed.withColumn("time", F.lit(1)), ["series_id", "ts"], "full")
        on = F.col("point").isNotNull()
        count = both.agg(F.count("point").alias("points"), F.count_if(on & F.col("time").isNull()).alias("missing"), F.count_if(~on).alias("lost"), F.min(F.when(on, F.col("ts"))).alias("a"), F.max(F.when(on, F.col("ts"))).alias("b")).first()
        if count.missing:
            self.notes.append(f"{count.missing} dates are missing.")
        if self.missing != "reindex" or not (count.missing or count.lost):
            return rows, (found.a, found.b, found.times), count.missing
        if count.lost:
            self.notes.append(f"{count.lost} rows lie off the calendar and are dropped by reindexing.")
        return points.select("ts").join(rows, "ts", "left"), (count.a, count.b, count.points), count.missing
