"""Transforms of a series: log and its inverse, detrending, differences; and the views that plans ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SeriesBundle, SeriesView, TransformedSeries, TransformPlan, TransformStepRecord
from .series import align, by_time, present, whole_series, with_position


def lowest(series: DataFrame) -> float | None:
    return series.agg(F.min("y")).first()[0]


def log_transform(series: DataFrame, offset: float = 0.0) -> DataFrame:
    """ln(y + offset); nulls stay. A value that is not above zero is an error, as ln would turn it into a null."""
    least = lowest(series)
    if least is not None and least + offset <= 0:
        raise ValueError(f"log needs y + offset > 0; the least is {least + offset}")
    return series.withColumn("y", F.ln(F.col("y") + F.lit(float(offset))))


def log_inverse(y: Column, offset: float = 0.0) -> Column:
    return F.exp(y) - F.lit(float(offset))


def linear_trend(series: DataFrame) -> DataFrame:
    """Slope and intercept of y on the row's place, nulls left out, for each series."""
    return with_position(series).groupBy("series_id").agg(F.regr_slope("y", F.col("pos").cast("double")).alias("slope"), F.regr_intercept("y", F.col("pos").cast("double")).alias("intercept"), F.count("y").alias("n_present"))


def detrend_linear(series: DataFrame, check: bool = True) -> DataFrame:
    """y less its linear trend over all rows' places; a series with under three values is an error.

    The trend is fitted over the window that gives the places, so that a series is shuffled once."""
    if check and not series.groupBy("series_id").agg(F.count("y").alias("n")).where("n < 3").isEmpty():
        raise ValueError("a linear trend needs three values")
    placed = with_position(series).withColumn("pos", F.col("pos").cast("double"))
    slope, intercept = F.regr_slope("y", "pos").over(whole_series()), F.regr_intercept("y", "pos").over(whole_series())
    fitted = placed.withColumn("slope", slope).withColumn("intercept", intercept)
    return fitted.select("series_id", "ts", (F.col("y") - (F.col("slope") * F.col("pos") + F.col("intercept"))).alias("y"))


def difference(series: DataFrame, lag: int = 1, order: int = 1) -> DataFrame:
    """y less the value `lag` rows before, `order` times; rows without a value go after each time."""
    for _ in range(order):
        series = series.withColumn("y", F.col("y") - F.lag("y", lag).over(by_time())).where("y IS NOT NULL")
    return series


def seasonal_difference(series: DataFrame, m: int | None, order: int = 1) -> DataFrame:
    if order and (m is None or m <= 1):
        raise ValueError("seasonal differencing needs a period above 1")
    return difference(series, int(m or 1), order)


def detrend(series: DataFrame, how: str) -> DataFrame:
    if how == "none":
        return series
    if how == "linear":
        return detrend_linear(series)
    if how == "diff1":
        return difference(series)
    raise ValueError(f"unknown detrend: {how}")


class TransformEngine:
    """Views of a bundle under a plan. A log that has been checked and taken is not checked again."""

    def __init__(self):
        self._logs: list[tuple[DataFrame, float, DataFrame]] = []

    def variance(self, series: DataFrame, plan: TransformPlan) -> tuple[DataFrame, list[TransformStepRecord]]:
        plan.checked()
        if plan.variance_transform != "log":
            return series, []
        taken = next((out for of, offset, out in self._logs if of is series and offset == plan.boxcox_offset), None)
        if taken is None:
            taken = log_transform(series, plan.boxcox_offset).persist()
            self._logs.append((series, plan.boxcox_offset, taken))
        return taken, [TransformStepRecord("log", {"offset": plan.boxcox_offset}, True)]

    def release(self) -> None:
        for _, _, taken in self._logs:
            taken.unpersist()
        self._logs.clear()

    def raw(self, bundle: SeriesBundle) -> SeriesView:
        return SeriesView("raw", bundle.y, bundle.exog, [])

    def var_stable(self, bundle: SeriesBundle, plan: TransformPlan) -> SeriesView:
        y, steps = self.variance(bundle.y, plan)
        return SeriesView("var_stable", y, align(y, bundle.exog), steps)

    def for_periodogram(self, bundle: SeriesBundle, plan: TransformPlan) -> SeriesView:
        y, steps = self.variance(bundle.y, plan)
        y = detrend(y, plan.detrend_for_periodogram)
        return SeriesView("for_periodogram", y, align(y, bundle.exog), [*steps, TransformStepRecord(f"detrend_{plan.detrend_for_periodogram}")])

    def stl_interpretation(self, bundle: SeriesBundle, plan: TransformPlan) -> SeriesView:
        y, steps = self.variance(bundle.y, plan)
        return SeriesView("stl_interpretation", y, align(y, bundle.exog), steps)

    def stationary(self, bundle: SeriesBundle, plan: TransformPlan) -> TransformedSeries:
        """Variance transform, then seasonal, then regular differences; the inverse undoes the first only."""
        y, steps = self.variance(bundle.y, plan)
        if plan.D:
            y = seasonal_difference(y, plan.seasonal_period_m, plan.D)
            steps.append(TransformStepRecord("seasonal_diff", {"m": plan.seasonal_period_m, "D": plan.D}))
        if plan.d:
            y = difference(y, 1, plan.d)
            steps.append(TransformStepRecord("diff", {"d": plan.d}))
        log = plan.variance_transform == "log"
        inverse = (lambda c: log_inverse(c, plan.boxcox_offset)) if log else (lambda c: c)
        return TransformedSeries(y, align(y, bundle.exog), plan, steps, inverse)


def values_of(series: DataFrame) -> DataFrame:
    """The values present, with their places among themselves."""
    return with_position(present(series))
