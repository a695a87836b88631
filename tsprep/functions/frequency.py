"""The frequency of a time axis, from one row of aggregates for each series.

The aggregates hold the distinct gaps' ends and number, and whether all times share a place in the calendar. Whether that
makes a frequency is decided by rules on that one row. Series that are many are looked at in a window each; an axis that may be too long
for one task goes by ranges of time, of which only each one's last row meets the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendar
from .calendar import FIXED, MONTHS, WEEKDAYS

DAY, HOUR = FIXED["D"], FIXED["h"]
DOMINANT = 0.95


def _kinds(small: Column) -> Column:
    """How many values a small whole number takes, as bits of one number: no distinct aggregate, which would multiply the rows."""
    return F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), small.cast("int")))).cast("int")


def axis_facts(series: DataFrame, long: bool = False) -> DataFrame:
    """One row for each series: what `infer` and `fallback` decide by. long: no series is put into one task."""
    at = calendar.micros(F.col("ts"))
    if long:
        from ..operators.series import with_previous

        timed = with_previous(series.where("ts IS NOT NULL").select("series_id", "ts", at.alias("at")), ["series_id"], "at", "at")
        timed = timed.withColumn("before", calendar.from_micros(F.col("before")))
    else:
        timed = series.where("ts IS NOT NULL").select("series_id", "ts", at.alias("at"), F.lag("ts").over(Window.partitionBy("series_id").orderBy("ts")).alias("before"))
    month, day, weekday = calendar.month_number(F.col("ts")), F.dayofmonth("ts"), F.weekday("ts")
    last = F.dayofmonth(F.last_day(F.col("ts").cast("date")))
    rows = timed.select(
        "series_id", "ts", "at", (F.col("at") - calendar.micros(F.col("before"))).alias("gap"), (month - calendar.month_number(F.col("before"))).alias("months"), F.weekday("before").alias("was"),
        month.alias("month"), day.alias("day"), weekday.alias("weekday"), last.alias("last"), F.call_function("div", day - 1, F.lit(7)).alias("nth"),
    )
    business_gap = (F.col("gap") == F.when((F.col("was") == 4), 3 * DAY).otherwise(DAY)) & (F.col("weekday") < 5)
    gaps = rows.where("gap IS NOT NULL").groupBy("series_id", "gap").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    by_gap = gaps.groupBy("series_id").agg(
        F.count("*").alias("gaps"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.sum("gap").alias("gap_sum"), F.max_by("gap", F.struct("c", -F.col("first"))).alias("gap_top"), (F.max("c") / F.sum("c")).alias("share")
    )
    facts = rows.groupBy("series_id").agg(
        F.count("*").alias("rows"), F.min("months").alias("months_min"), F.max("months").alias("months_max"), F.min("ts").alias("start"),
        _kinds(F.month("ts")).alias("month_names"), F.bool_and(F.col("day") == 1).alias("cs"), F.bool_and(F.col("day") == F.col("last")).alias("ce"),
        F.bool_and((F.col("day") == 1) | (F.col("day") <= 3) & (F.col("weekday") == 0)).alias("bs"), F.bool_and((F.col("day") == F.col("last")) | (F.col("last") - F.col("day") < 3) & (F.col("weekday") == 4)).alias("be"),
        _kinds(F.col("weekday")).alias("weekdays"), _kinds(F.col("nth")).alias("nths"), F.min("nth").alias("nth"), F.bool_and(business_gap | F.col("gap").isNull()).alias("business"), F.min("weekday").alias("weekday_min"),
        F.min_by("weekday", "ts").alias("weekday_first"), F.min_by("month", "ts").alias("month_first"),
    )
    return facts.join(by_gap, "series_id", "left")


def _counted(name: str, n: int) -> str:
    return name if n == 1 else f"{n}{name}"


def fixed_name(micros: int) -> str | None:
    for unit, size in FIXED.items():
        if micros >= size and micros % size == 0:
            return _counted(unit, micros // size)
    return None


def infer(f: dict) -> str | None:
    """The frequency of an axis without exceptions, or None: years, quarters and months before fixed gaps, then weekdays."""
    if f["rows"] < 3 or not f["gap_min"] or f["gap_min"] <= 0:
        return None
    one_gap = f["gaps"] == 1
    if f["gap_min"] % DAY:
        ends = sorted({f["gap_min"] // HOUR, f["gap_max"] // HOUR} | ({(f["gap_sum"] - f["gap_min"] - f["gap_max"]) // HOUR} if f["gaps"] == 3 else set()))
        if f["gaps"] <= 3 and f["gap_min"] == HOUR and ends in ([1, 17], [1, 65], [1, 17, 65]):
            return "bh"
        return fixed_name(f["gap_min"]) if one_gap else None
    place = next((p for p, has in (("S", f["cs"]), ("BS", f["bs"]), ("E", f["ce"]), ("BE", f["be"])) if has), None)
    if place and f["months_min"] == f["months_max"] and f["months_min"] > 0:
        step, (front, back) = int(f["months_min"]), (("B", place[1]) if place[0] == "B" else ("", place))
        month = int(f["month_first"]) % 12 + 1
        if step % 12 == 0 and f["month_names"] == 1:
            return _counted(f"{front}Y{back}-{MONTHS[month - 1]}", step // 12)
        if step % 3 == 0:
            return _counted(f"{front}Q{back}-{MONTHS[{0: 12, 2: 11, 1: 10}[month % 3] - 1]}", step // 3)
        return _counted(f"{front}M{back}", step)
    if one_gap:
        days = f["gap_min"] // DAY
        return _counted(f"W-{WEEKDAYS[f['weekday_first']]}", days // 7) if days % 7 == 0 else _counted("D", days)
    if f["gaps"] == 2 and f["gap_min"] == DAY and f["gap_max"] == 3 * DAY and f["business"]:
        return "B"
    if f["weekdays"] == 1 and f["nths"] == 1 and f["nth"] < 4:
        return f"WOM-{f['nth'] + 1}{WEEKDAYS[f['weekday_first']]}"
    return None


def fallback(f: dict) -> str | None:
    """The dominant gap's name where nearly all gaps are like it."""
    if f["rows"] < 3 or f["share"] is None or f["share"] < DOMINANT or not f["gap_top"] or f["gap_top"] <= 0:
        return None
    return fixed_name(f["gap_top"])


def infer_frequency(series: DataFrame) -> DataFrame:
    """series_id, freq, is_regular, share for each series."""

    def work(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for f in frame.drop(columns=["start"]).astype(object).where(frame.drop(columns=["start"]).notna(), None).to_dict("records"):
                # A series without gaps makes the others' whole numbers floats.
                f = {k: int(v) if isinstance(v, float) and k != "share" else v for k, v in f.items()}
                name = infer(f)
                rows.append((f["series_id"], name or fallback(f), name is not None, f["share"]))
            yield pd.DataFrame(rows, columns=["series_id", "freq", "is_regular", "share"])

    return axis_facts(series).mapInPandas(work, "series_id string, freq string, is_regular boolean, share double")
