"""Parsing of dates: a format is guessed from the first value, and what does not match it is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (pattern of the text, Spark's format), tried in order on the first value.
GUESSES = (
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}", "yyyy-MM-dd HH:mm"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,9}", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,9}Z?", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]['Z']"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"),
    (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
    (r"\d{4}", "yyyy"),
)
#: strftime's directives in Spark's letters.
DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "I": "hh", "p": "a", "f": "SSSSSS", "j": "DDD", "a": "EEE", "A": "EEEE", "z": "xx", "%": "%"}
FIRST_YEAR, LAST_YEAR = 1678, 2261


def spark_format(strftime: str) -> str:
    """A strftime format as Spark writes it."""
    out = []
    for found in re.finditer(r"%(.)|([A-Za-z]+)|([^%A-Za-z]+)", strftime):
        if found[1]:
            if found[1] not in DIRECTIVES:
                raise ValueError(f"unknown directive %{found[1]}")
            out.append(DIRECTIVES[found[1]])
        else:
            out.append(f"'{found[2]}'" if found[2] else found[3].replace("'", "''"))
    return "".join(out)


def guess_format(value: str | None) -> str | None:
    """The format of a text; None where it looks like no date (numbers such as 10 or 202101 do not)."""
    for pattern, form in GUESSES:
        if value is not None and re.fullmatch(pattern, value):
            return form
    return None


def parse(value: Column, form: str | None) -> Column:
    """value (text) as a TIMESTAMP_NTZ; null where it does not match or lies outside the years that nanoseconds reach."""
    if form is None:
        return F.lit(None).cast("timestamp_ntz")
    found = F.try_to_timestamp(value, F.lit(form)).cast("timestamp_ntz")
    return F.when(F.year(found).between(FIRST_YEAR, LAST_YEAR), found)


def text_of(value: Column, kind: str) -> Column:
    """A column's values as text; whole numbers without a point."""
    return value.cast("string") if kind not in ("double", "float") else F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
