"""Time buckets, calendar spines and the parts of frequency names, as column expressions on TIMESTAMP_NTZ.

Everything is done on dates and day-time intervals, so that the session's time zone plays no part."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
#: Microseconds of the units of fixed length.
FIXED = {"D": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}
#: Older spellings and the one that is used now.
ALIASES = {"H": "h", "T": "min", "S": "s", "L": "ms", "U": "us", "d": "D", "M": "ME", "Q": "QE", "Y": "YE", "A": "YE", "AS": "YS", "BM": "BME", "BQ": "BQE", "BY": "BYE", "BA": "BYE", "BAS": "BYS"}
ANCHORED = {"W", "MS", "ME", "QS", "QE", "YS", "YE", "B", "BMS", "BME", "BQS", "BQE", "BYS", "BYE"}


@dataclass(frozen=True)
class Frequency:
    """A multiple of a unit, with the weekday or month that it is anchored to."""

    unit: str
    count: int = 1
    anchor: str | None = None

    @property
    def micros(self) -> int | None:
        return FIXED[self.unit] * self.count if self.unit in FIXED else None


def frequency(name: str) -> Frequency:
    found = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Z]{3}))?", name.strip())
    unit = found and (ALIASES.get(found[2], found[2]))
    if not found or unit not in FIXED and unit not in ANCHORED:
        raise ValueError(f"unknown frequency: {name!r}")
    anchor = found[3]
    if anchor and anchor not in (WEEKDAYS if unit == "W" else MONTHS if unit[-2:] in ("QS", "QE", "YS", "YE") else ()):
        raise ValueError(f"unknown anchor in frequency: {name!r}")
    count = int(found[1] or 1)
    if count < 1:
        raise ValueError(f"a frequency's multiple is at least 1: {name!r}")
    return Frequency(unit, count, anchor)


def ntz(value: Column) -> Column:
    return value.cast("timestamp_ntz")


def day(ts: Column) -> Column:
    return ts.cast("date")


def micros_of_day(ts: Column) -> Column:
    return (F.hour(ts).cast("long") * 3600 + F.minute(ts) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_date(day(ts)).cast("long") * FIXED["D"] + micros_of_day(ts)


def from_micros(us: Column) -> Column:
    whole = F.call_function("div", us - F.pmod(us, F.lit(FIXED["D"])), F.lit(FIXED["D"]))
    return plus_micros(ntz(F.date_from_unix_date(whole.cast("int"))), F.pmod(us, F.lit(FIXED["D"])))


def plus_micros(ts: Column, us: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def month_number(value: Column) -> Column:
    """Months since year 0."""
    return F.year(value) * 12 + F.month(value) - 1


def month_start(number: Column) -> Column:
    return F.make_date(F.call_function("div", number, F.lit(12)).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))


def bucket_label(ts: Column, rule: str, origin: Column | None = None) -> Column:
    """The label of the bucket that ts falls into; origin: midnight of the series' first day, for multiples of fixed units.

    Weeks and month, quarter and year ends are labelled by their last day, everything else by its start."""
    f = frequency(rule)
    if f.micros:
        if f.count == 1:
            start = micros(ts)
            return from_micros(start - F.pmod(start, F.lit(f.micros)))
        if origin is None:
            raise ValueError("multiples of a unit need the series' origin")
        past = micros(ts) - micros(origin)
        return from_micros(micros(origin) + past - F.pmod(past, F.lit(f.micros)))
    if f.count != 1 or f.unit.startswith("B"):
        raise ValueError(f"no buckets of {rule!r}")
    if f.unit == "W":
        end = WEEKDAYS.index(f.anchor or "SUN")
        return ntz(F.date_add(day(ts), F.pmod(F.lit(end) - F.weekday(ts), F.lit(7)).cast("int")))
    if f.unit == "MS":
        return ntz(month_start(month_number(ts)))
    if f.unit == "ME":
        return ntz(F.last_day(day(ts)))
    size = 3 if f.unit[0] == "Q" else 12
    if f.unit[1] == "S":
        first = MONTHS.index(f.anchor or "JAN") % size
    else:
        first = (MONTHS.index(f.anchor or "DEC") + 1) % size
    n = month_number(ts) - first
    start = n - F.pmod(n, F.lit(size)) + first
    return ntz(month_start(start)) if f.unit[1] == "S" else ntz(F.last_day(month_start(start + size - 1)))


def _business_start(first: Column) -> Column:
    """The first weekday of the month that begins on that date."""
    return F.date_add(first, F.when(F.weekday(first) >= 5, 7 - F.weekday(first)).otherwise(0).cast("int"))


def _business_end(first: Column) -> Column:
    last = F.last_day(first)
    return F.date_sub(last, F.when(F.weekday(last) >= 5, F.weekday(last) - 4).otherwise(0).cast("int"))


def spine_array(start: Column, end: Column, name: str) -> Column:
    """All points of the frequency from start on, up to end; anchored ones keep start's time of day."""
    f = frequency(name)
    if f.micros:
        # Ends before they start only where there is nothing.
        n = F.call_function("div", micros(end) - micros(start), F.lit(f.micros))
        return F.when(start.isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), n), lambda k: plus_micros(start, k * f.micros)))
    tod = micros_of_day(start)
    if f.unit == "W":
        first = F.date_add(day(start), F.pmod(F.lit(WEEKDAYS.index(f.anchor or "SUN")) - F.weekday(start), F.lit(7)).cast("int"))
        days = F.when(first <= day(end), F.sequence(first, F.greatest(first, day(end)), F.expr(f"interval {7 * f.count} days")))
    elif f.unit == "B":
        days = F.filter(F.sequence(day(start), day(end), F.expr("interval 1 day")), lambda d: F.weekday(d) < 5)
        if f.count > 1:
            days = F.filter(days, lambda _, k: k % f.count == 0)
    else:
        size = {"M": 1, "Q": 3, "Y": 12}[f.unit.removeprefix("B")[0]]
        starts = f.unit.endswith("S")
        if size == 1:
            residue = 0
        elif starts:
            residue = MONTHS.index(f.anchor or "JAN") % size
        else:
            residue = MONTHS.index(f.anchor or "DEC") % size
        point = {(True, False): lambda d: d, (False, False): F.last_day, (True, True): _business_start, (False, True): _business_end}[(starts, f.unit.startswith("B"))]
        months = F.filter(F.sequence(month_number(start), month_number(end) + 1), lambda n: F.pmod(n, F.lit(size)) == residue)
        days = F.filter(F.transform(months, lambda n: point(month_start(n))), lambda d: (d >= day(start)) & (d <= day(end)))
        if f.count > 1:
            days = F.filter(days, lambda _, k: k % f.count == 0)
    return F.filter(F.transform(days, lambda d: plus_micros(ntz(d), tod)), lambda t: (t >= start) & (t <= end))


def season_key(ts: Column, freq_hint: str | None) -> tuple[str, Column]:
    """The name and the key of the season that a frequency suggests: letters are looked for in the order H, D, W, M.

    Weekly series are called weekofyear but grouped by month."""
    hint = (freq_hint or "").upper()
    if "H" in hint:
        return "hour", F.hour(ts)
    if "D" in hint:
        return "dayofweek", F.weekday(ts)
    if "W" in hint:
        return "weekofyear", F.month(ts)
    return "month", F.month(ts)
