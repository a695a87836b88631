"""Choosing how often to difference: which candidates count as stationary, and the least of them."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import StationarityPolicy, TransformedSeries

SEVERITY = {"none": 0, "soft": 1, "hard": 2}
FLAGS = ("soft", "hard")
#: Fixed values: (D, d) of the sweep, in order.
GRID = ((0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2))


def number_or_none(value: Any) -> float | None:
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def passes(row: dict, policy: StationarityPolicy) -> bool:
    """What the row says of itself; else ADF rejects a unit root and KPSS does not reject stationarity; a missing test fails."""
    if "pass_stationarity" in row:
        return bool(row["pass_stationarity"])
    a, k = number_or_none(row.get("adf_pvalue")), number_or_none(row.get("kpss_pvalue"))
    return a is not None and k is not None and a <= policy.alpha_adf and k >= policy.alpha_kpss


def passes_column(policy: StationarityPolicy, stated: bool = False) -> Column:
    """stated: the table has a column pass_stationarity, which decides."""
    if stated:
        return F.coalesce(F.col("pass_stationarity").cast("boolean"), F.lit(False))
    return F.coalesce((F.col("adf_pvalue") <= policy.alpha_adf) & (F.col("kpss_pvalue") >= policy.alpha_kpss), F.lit(False))


def overdiff_class(row: dict, policy: StationarityPolicy) -> str:
    """How much the first autocorrelation speaks of over-differencing; a flag in the row comes first."""
    flag = row.get("overdiff_flag")
    if flag in FLAGS:
        return flag
    r = number_or_none(row.get("acf1"))
    if r is None:
        return "none"
    return "hard" if r <= policy.acf1_hard else "soft" if r <= policy.acf1_soft else "none"


def overdiff_column(policy: StationarityPolicy, stated: bool = False) -> Column:
    """stated: the table has a column overdiff_flag, which comes first."""
    r = F.col("acf1")
    known = F.when(F.col("overdiff_flag").isin(*FLAGS), F.col("overdiff_flag")) if stated else F
    return known.when(r <= policy.acf1_hard, "hard").when(r <= policy.acf1_soft, "soft").otherwise("none")


def complexity(candidate: TransformedSeries, row: dict, policy: StationarityPolicy) -> tuple:
    D, d = candidate.plan.D, candidate.plan.d
    return (SEVERITY[overdiff_class(row, policy)], D + d, -D, d)


def candidate_grid(m: int | None, max_d: int, max_D: int) -> list[tuple[int, int]]:
    return [(D, d) for D, d in GRID if d <= max_d and D <= max_D and (not D or (m or 0) > 1)]


def row_for(candidate: TransformedSeries, rows: list[dict]) -> dict:
    """The row of a candidate's (D, d, m), or else the one without m; a candidate without a row is one whose tests are missing."""
    by = {(int(r.get("D") or 0), int(r.get("d") or 0), r.get("m")): r for r in rows}
    p = candidate.plan
    return by.get((p.D, p.d, p.seasonal_period_m)) or by.get((p.D, p.d, None)) or {}


def select_stationary_candidate(candidates: list[TransformedSeries], rows: list[dict], policy: StationarityPolicy | None = None) -> tuple[TransformedSeries | None, dict]:
    """The least candidate of those that pass; else of those not clearly over-differenced; else of all. And how it came about."""
    policy = policy or StationarityPolicy()
    meta: dict[str, Any] = {"policy": vars(policy).copy(), "any_candidates": False, "any_passed": False, "passed": None, "selected": None, "reason": "no candidates within the limits"}
    known = [(c, row_for(c, rows)) for c in candidates if c.plan.d <= policy.max_d and c.plan.D <= policy.max_D]
    if not known:
        return None, meta
    meta["any_candidates"] = True
    good = [x for x in known if passes(x[1], policy)]
    meta["any_passed"] = bool(good)
    if good:
        pool, meta["reason"] = good, "least complex candidate that passes both tests"
    else:
        pool = [x for x in known if overdiff_class(x[1], policy) != "hard"]
        meta["reason"] = "no candidate passes; least complex that is not over-differenced" if pool else "no candidate passes and all are over-differenced; least complex"
        pool = pool or known
    best, row = min(pool, key=lambda x: complexity(*x, policy))
    meta["passed"] = passes(row, policy)
    meta["selected"] = {"D": best.plan.D, "d": best.plan.d, "m": best.plan.seasonal_period_m, "overdiff": overdiff_class(row, policy)}
    return best, meta


def selected_by_series(table, policy: StationarityPolicy | None = None):
    """The same choice for every series of a table of tests (series_id, D_, d, ...), as one aggregate.

    Columns pass_stationarity and overdiff_flag, where the table has them, count before the tests."""
    policy = policy or StationarityPolicy()
    passed, overdiff = passes_column(policy, "pass_stationarity" in table.columns), overdiff_column(policy, "overdiff_flag" in table.columns)
    rank = F.when(overdiff == "hard", 2).when(overdiff == "soft", 1).otherwise(0)
    tier = F.when(passed, 0).when(rank < 2, 1).otherwise(2)
    rows = table.where((F.col("d") <= policy.max_d) & (F.col("D_") <= policy.max_D))
    key = F.struct(tier.alias("tier"), rank.alias("rank"), (F.col("D_") + F.col("d")).alias("total"), (-F.col("D_")).alias("minus"), F.col("d").alias("d1"))
    best = F.min_by(F.struct("D_", "d", passed.alias("passed"), overdiff.alias("overdiff")), key)
    return rows.groupBy("series_id").agg(best.alias("best"), F.max(passed).alias("any_passed")).select("series_id", "best.*", "any_passed")
