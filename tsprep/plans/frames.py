"""Frames ready to be drawn, and the viewer that gathers them for a finished run."""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PreModelState
from ..operators import diagnostics
from ..operators.series import from_values
from ..operators.transforms import values_of

#: Fixed value: the half width of the constant band, in standard errors.
BAND = 1.96
TABLE_COLUMNS = ("D", "d", "m", "n", "adf_pvalue", "kpss_pvalue", "acf1", "pass_stationarity")


def to_series(spark: SparkSession, y) -> DataFrame:
    """A frame with ts and y as it is, else a list, tuple or array."""
    if isinstance(y, DataFrame):
        return y if "series_id" in y.columns else y.select(F.lit("all").alias("series_id"), "ts", "y")
    return from_values(spark, y)


def time_series(y: DataFrame) -> DataFrame:
    return y.select("series_id", "ts", "y").orderBy("series_id", "ts")


def period_resemblance(y: DataFrame, periods: list[int], max_candidates: int = 5, use_first_n: int | None = None) -> DataFrame:
    """series_id, m, ts, y, proto: the first values beside the mean of their phase, for each period."""
    some = values_of(y)
    if use_first_n is not None:
        some = some.where(F.col("pos") < use_first_n)
    parts = [diagnostics.seasonal_prototype(some.drop("pos"), m) for m in periods[:max_candidates]]
    if not parts:
        raise ValueError("no periods to show")
    return reduce(DataFrame.unionByName, parts).select("series_id", "m", "ts", "y", "proto")


def rolling_mean_var(raw: dict) -> DataFrame:
    from pyspark.sql import Window

    return raw["rolling"].withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("ts")) - 1)


def chosen_stationarity(state: PreModelState) -> list[dict]:
    """The rows of the table for the plan's D, d and m."""
    p = state.plan
    return [r for r in state.diagnostics.stationarity_table if (r["D"], r["d"]) == (p.D, p.d) and r["m"] in (p.seasonal_period_m, None)]


def stationarity_table(rows: list[dict], max_rows: int = 50) -> list[dict]:
    return [{k: r[k] for k in TABLE_COLUMNS if k in r} | {k: v for k, v in r.items() if k not in TABLE_COLUMNS} for r in rows[:max_rows]]


def stems(table: DataFrame, band_mode: str = "constant", skip_lag0: bool = True) -> DataFrame:
    """kind, lag, value, band_lo, band_hi of an ACF and PACF table; the bands are 1.96/sqrt(n) or each lag's own."""
    if band_mode not in ("constant", "per_lag"):
        raise ValueError(f"unknown band mode: {band_mode}")
    flat = F.lit(BAND) / F.sqrt(F.max("n").over(_whole()))
    parts = []
    for kind in ("acf", "pacf"):
        lo, hi = (-flat, flat) if band_mode == "constant" else (F.col(f"{kind}_lo"), F.col(f"{kind}_hi"))
        parts.append(table.select("series_id", F.lit(kind).alias("kind"), "lag", F.col(kind).alias("value"), lo.alias("band_lo"), hi.alias("band_hi")))
    out = parts[0].unionByName(parts[1])
    return out.where("lag > 0") if skip_lag0 else out


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy("series_id")


def stem_limit(values: list[float], n: int) -> float:
    """How far the axis of a stem plot reaches."""
    return max(0.2, 1.1 * max([abs(v) for v in values if v is not None] + [BAND / sqrt(max(n, 1))]))


class PreModelViewer:
    """The frames of a run by name."""

    def __init__(self, max_candidates: int = 5, use_first_n: int | None = None, band_mode: str = "constant", skip_lag0: bool = True):
        self.max_candidates, self.use_first_n, self.band_mode, self.skip_lag0 = max_candidates, use_first_n, band_mode, skip_lag0

    def render_from_state(self, state: PreModelState) -> dict:
        y, d = state.bundle.y, state.diagnostics
        out = {"time_series": time_series(y), "rolling": rolling_mean_var(d.raw), "stationarity_table": stationarity_table(d.stationarity_table), "chosen_stationarity": chosen_stationarity(state), "notes": list(d.notes)}
        periods = [c["m"] for c in d.period_candidates.get("candidates", [])]
        if periods:
            out["period_resemblance"] = period_resemblance(y, periods, self.max_candidates, self.use_first_n)
        if "rows" in d.acf_pacf:
            table = y.sparkSession.createDataFrame(d.acf_pacf["rows"], "series_id string, lag int, acf double, acf_lo double, acf_hi double, n long, pacf double, pacf_lo double, pacf_hi double")
            out["acf_pacf"] = stems(table, self.band_mode, self.skip_lag0)
        if d.stl is not None:
            out["stl"] = d.stl
        return out

    def render_from_report(self, report: dict, y: DataFrame | None = None) -> dict:
        """The same of a report: a dict with any of rolling, periods, stationarity_table, acf_pacf (a frame); y must be given."""
        if y is None:
            raise ValueError("a report is shown with its series: y is missing")
        out = {"time_series": time_series(y), "stationarity_table": stationarity_table(report.get("stationarity_table", []))}
        if report.get("rolling") is not None:
            out["rolling"] = rolling_mean_var(report)
        if report.get("periods"):
            out["period_resemblance"] = period_resemblance(y, report["periods"], self.max_candidates, self.use_first_n)
        if report.get("acf_pacf") is not None:
            out["acf_pacf"] = stems(report["acf_pacf"], self.band_mode, self.skip_lag0)
        return out
