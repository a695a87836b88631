"""Reading CSV, Excel and Parquet from paths, bytes and file-like objects, with what was found out on the way.

CSV is read as text and typed afterwards, so that missing-value words keep a column numeric and dates stay text until
roles are detected. A path is read by Spark; only a bounded sample of it comes to the driver, and one pass over its lines tells
whether bytes past the sample are in the encoding found and whether quoted line ends keep the file from being read in pieces. Bytes
are in the driver already."""

from __future__ import annotations

import csv
import io
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IngestionMetadata
from ..operators.roles import ORDER, is_time, numeric_columns
from . import encodings, xlsx

ENCODING_SAMPLE, DELIMITER_SAMPLE = 2_000_000, 4096
#: With max_rows up to this the first rows alone are read.
HEAD_ROWS = 100_000
#: The words that stand for a missing value.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
KINDS = {".csv": "csv", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet"}


def mangled(names: list[str]) -> list[str]:
    """Names with .1, .2 after those that come again."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for name in names:
        own, k = name, seen.get(name, 0)
        while own in seen:
            k += 1
            own = f"{name}.{k}"
        seen[name] = k
        seen.setdefault(own, 0)
        out.append(own)
    return out


def typed(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as whole numbers, numbers or truth values where all that is there is one; one pass finds which."""
    cleaned = raw.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING_WORDS), F.col(f"`{c}`")) for c in columns}) if columns else raw
    if not columns:
        return cleaned
    fails = []
    for k, c in enumerate(columns):
        v = F.trim(F.col(f"`{c}`"))
        fails += [F.count(v).alias(f"n{k}"), F.count_if(v.isNull()).alias(f"z{k}"), F.count_if(v.isNotNull() & ~v.rlike(r"^[-+]?\d{1,18}$")).alias(f"i{k}")]
        fails += [F.count_if(v.isNotNull() & (v.try_cast("double").isNull() | v.rlike("[dDfF]$"))).alias(f"d{k}"), F.count_if(v.isNotNull() & ~F.lower(v).isin("true", "false")).alias(f"b{k}")]
    found = cleaned.agg(*fails).first()
    casts = {}
    for k, c in enumerate(columns):
        v = F.trim(F.col(f"`{c}`"))
        if not found[f"n{k}"] or not found[f"d{k}"]:
            casts[c] = v.cast("long") if found[f"n{k}"] and not found[f"i{k}"] and not found[f"z{k}"] else v.cast("double")
        elif not found[f"b{k}"] and not found[f"z{k}"]:
            casts[c] = F.lower(v) == "true"
    return cleaned.withColumns(casts) if casts else cleaned


class DataIngestor:
    """source: a path, bytes or a file-like object. load() gives the rows with their place in the file in `__rid`."""

    def __init__(self, spark: SparkSession, source: str | Path | bytes | bytearray | BinaryIO, file_type: str | None = None, encoding: str | None = None, delimiter: str | None = None, max_rows: int | None = None, filename: str | None = None):
        self.spark, self.source = spark, source
        self.file_type, self.encoding, self.delimiter, self.max_rows, self.filename = file_type, encoding, delimiter, max_rows, filename
        self.warnings: list[str] = []
        self._df: DataFrame | None = None

    def load(self) -> DataFrame:
        if self._df is None:
            self.file_type = self.file_type or self._kind()
            readers = {"csv": self._csv, "excel": self._excel, "parquet": self._parquet}
            if self.file_type not in readers:
                raise ValueError(f"unknown file type: {self.file_type}")
            df = readers[self.file_type]()
            self._df = df.orderBy(ORDER).limit(self.max_rows) if self.max_rows is not None else df
            self.validate()
        return self._df

    def preview(self, n: int = 5) -> DataFrame:
        return self.load().orderBy(ORDER).limit(n).drop(ORDER)

    def get_metadata(self) -> IngestionMetadata:
        df = self.load()
        columns = [c for c in df.columns if c != ORDER]
        kinds = dict(df.dtypes)
        return IngestionMetadata(df.count(), len(columns), columns, {c: kinds[c] for c in columns}, self.file_type, self.encoding, self.delimiter, list(self.warnings), False)

    def validate(self) -> list[str]:
        """Raises for an empty table; warns of few rows, of names that come twice and of tables without numbers and dates. Warnings are not doubled."""
        df = self.load()
        n = df.limit(10).count()
        if not n or len(df.columns) < 2:
            raise ValueError("the table is empty")
        if n < 10:
            self._warn("Fewer than 10 rows.")
        if not numeric_columns(df) and not any(is_time(f.dataType) for f in df.schema):
            self._warn("No numeric and no datetime column.")
        return list(self.warnings)

    def _warn(self, what: str) -> None:
        if what not in self.warnings:
            self.warnings.append(what)

    def _kind(self) -> str:
        name = str(self.source) if isinstance(self.source, str | Path) else self.filename or getattr(self.source, "filename", None)
        if not name:
            raise ValueError("the file type is not known; give file_type or filename")
        suffix = Path(name).suffix.lower()
        if suffix not in KINDS:
            raise ValueError(f"unknown file suffix: {suffix!r}")
        return KINDS[suffix]

    @property
    def _path(self) -> str | None:
        return str(self.source) if isinstance(self.source, str | Path) else None

    def _sample(self, n: int) -> bytes:
        """The first bytes of the source, which is left as it was."""
        if isinstance(self.source, bytes | bytearray):
            return bytes(self.source[:n])
        if self._path is None:
            at = self.source.tell() if hasattr(self.source, "tell") else 0
            data = self.source.read(n)
            self.source.seek(at)
            return data
        stream = None
        try:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(self._path)
            fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.getFileStatus(where).isDirectory():
                files = sorted(str(s.getPath()) for s in fs.listStatus(where) if not s.getPath().getName().startswith(("_", ".")))
                where = jvm.org.apache.hadoop.fs.Path(files[0])
            stream = fs.open(where)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
        finally:
            if stream is not None:
                stream.close()

    def _all(self) -> bytes:
        if isinstance(self.source, bytes | bytearray):
            return bytes(self.source)
        if self._path is not None:
            return bytes(self.spark.read.format("binaryFile").load(self._path).first().content)
        if hasattr(self.source, "seek"):
            self.source.seek(0)
        data = self.source.read()
        return data.encode() if isinstance(data, str) else data

    def _detect_encoding(self, sample: bytes) -> str:
        if self.encoding:
            return self.encoding
        name, noticed = encodings.detect(sample)
        if noticed:
            self._warn(noticed)
        return name

    def _detect_delimiter(self, sample: bytes, encoding: str) -> str:
        if self.delimiter:
            return self.delimiter
        try:
            return csv.Sniffer().sniff(sample[:DELIMITER_SAMPLE].decode(encoding, "replace")).delimiter
        except csv.Error:
            return ","

    def _csv(self) -> DataFrame:
        sample = self._sample(ENCODING_SAMPLE)
        self.encoding = self._detect_encoding(sample)
        self.delimiter = self._detect_delimiter(sample, self.encoding)
        return self._csv_path(sample) if self._path is not None else self._csv_bytes()

    def _names(self, header: list[str]) -> list[str]:
        names = [h.strip("﻿") if k == 0 else h for k, h in enumerate(header)]
        names = [n if n else f"Unnamed: {k}" for k, n in enumerate(names)]
        if len(set(names)) < len(names):
            self._warn("Column names come more than once; numbers are added.")
        return mangled(names)

    def _facts(self, sample: bytes) -> tuple[bool, bool]:
        """Whether there are lines that are not utf-8, and lines that end within quotes, in all that is read of a path."""
        if encodings.wide(self.encoding):
            return False, True
        if self.max_rows is not None and len(lines := sample.splitlines()) > self.max_rows + 1:
            lines = lines[: self.max_rows + 1]
            return False, any(line.count(b'"') % 2 for line in lines)
        lines = self.spark.read.text(self._path)
        quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
        found = lines.agg(F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False)).alias("bad"), F.coalesce(F.bool_or(quotes % 2 == 1), F.lit(False)).alias("torn")).first()
        return found.bad, found.torn

    def _csv_path(self, sample: bytes) -> DataFrame:
        bad, torn = self._facts(sample)
        if bad and encodings.SPARK_CHARSETS.get(encodings.canonical(self.encoding)) == "UTF-8":
            self._warn(f"Bytes further down are not {self.encoding}; read again with the fallback encoding latin-1.")
            self.encoding = "latin-1"
        header = next(csv.reader(io.StringIO(sample.decode(self.encoding, "replace")), delimiter=self.delimiter), [])
        names = self._names(header)
        known = encodings.SPARK_CHARSETS.get(encodings.canonical(self.encoding))
        options = {"sep": self.delimiter, "encoding": known or "ISO-8859-1", "multiLine": torn, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "header": True, "enforceSchema": True}
        # One field more than there should be tells rows that are too long; they are dropped, short ones are filled with nulls.
        safe = [f"c{k}" for k in range(len(names))]
        raw = self.spark.read.options(**options).schema(", ".join(f"{s} string" for s in [*safe, "__more"])).csv(self._path)
        rows = raw.withColumn(ORDER, F.monotonically_increasing_id())
        if self.max_rows is not None and self.max_rows <= HEAD_ROWS:
            # The first rows, from as many pieces of the file as they need.
            rows = self.spark.createDataFrame(rows.take(self.max_rows), rows.schema)
        elif self.max_rows is not None:
            rows = rows.orderBy(ORDER).limit(self.max_rows)
        if not known:
            rows = rows.withColumns({c: encodings.decoded(F.col(c), self.encoding) for c in safe})
        if not rows.where(F.col("__more").isNotNull()).isEmpty():
            self._warn("Rows with too many fields were skipped.")
        rows = rows.where(F.col("__more").isNull()).drop("__more")
        return typed(rows, safe).toDF(*names, ORDER)

    def _csv_bytes(self) -> DataFrame:
        lines = list(csv.reader(io.StringIO(self._all().decode(self.encoding, "replace"), newline=""), delimiter=self.delimiter))
        names = self._names(lines[0] if lines else [])
        body = [x for x in lines[1:] if x][: self.max_rows]
        if any(len(x) > len(names) for x in body):
            self._warn("Rows with too many fields were skipped.")
        return self._frame(names, [x for x in body if len(x) <= len(names)])

    def _frame(self, names: list[str], body: list[list[str]]) -> DataFrame:
        safe = [f"c{k}" for k in range(len(names))]
        rows = [(*x, *[None] * (len(names) - len(x)), k) for k, x in enumerate(body)]
        df = self.spark.createDataFrame(rows, ", ".join([*(f"{s} string" for s in safe), f"{ORDER} long"]))
        return typed(df, safe).toDF(*names, ORDER)

    def _excel(self) -> DataFrame:
        lines = xlsx.first_sheet(self._all(), self.max_rows)
        return self._frame(self._names(lines[0] if lines else []), [x[: len(lines[0])] for x in lines[1:]])

    def _parquet(self) -> DataFrame:
        if self._path is None:
            raise ValueError("Parquet is read from a path")
        return self.spark.read.parquet(self._path).withColumn(ORDER, F.monotonically_increasing_id())
