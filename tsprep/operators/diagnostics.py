"""Diagnostics of a series, each keyed by series_id so that many series are done at once.

Counts, moments, windows and fits are aggregates and window functions; what is iterated (tests, spectra, STL) runs as
a kernel on one series at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, kernels
from ..model import SeriesView
from .series import by_time, whole_series, with_position
from .transforms import values_of

N_WINDOWS, TOP_K, MAX_LAGS, OUTLIER_Z = 12, 5, 60, 4.0


def rolling_window(n: Column | int):
    """A tenth of the rows, half to even, within 5 and 52."""
    if isinstance(n, int):
        return int(max(5, min(52, round(n * 0.10))))
    return F.greatest(F.lit(5), F.least(F.lit(52), F.bround(n.cast("double") * 0.10).cast("int")))


def summary(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.count("*").alias("n"), F.count("y").alias("n_nonmissing"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))


def missingness(series: DataFrame) -> DataFrame:
    gone = F.col("y").isNull()
    return series.groupBy("series_id").agg(F.count_if(gone).alias("missing_count"), F.avg(gone.cast("int")).alias("missing_pct"))


def missing_blocks(series: DataFrame) -> DataFrame:
    """Runs of rows without a value: first and last time, length."""
    marked = with_position(series).withColumn("gone", F.col("y").isNull())
    nth = F.row_number().over(by_time())
    runs = marked.where("gone").withColumn("run", F.col("pos") - nth)
    return runs.groupBy("series_id", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("length")).drop("run")


def rolling(series: DataFrame, window: int) -> DataFrame:
    """Mean and variance over the last `window` rows, where a third of them (two at least) have values."""
    w = by_time().rowsBetween(-(window - 1), 0)
    enough = F.count("y").over(w) >= max(2, window // 3)
    return series.select("series_id", "ts", F.when(enough, F.avg("y").over(w)).alias("rolling_mean"), F.when(enough, F.var_samp("y").over(w)).alias("rolling_var"), F.lit(window).alias("window"))


def rolling_ratio(series: DataFrame, window: int) -> DataFrame:
    """Standard deviation over mean in the same windows; null where the mean is 0."""
    w = by_time().rowsBetween(-(window - 1), 0)
    enough = F.count("y").over(w) >= max(2, window // 3)
    return series.select("series_id", "ts", F.when(enough, F.try_divide(F.stddev_samp("y").over(w), F.avg("y").over(w))).alias("ratio_std_over_mean"), F.lit(window).alias("window"))


def window_mean_variance(series: DataFrame, n_windows: int = N_WINDOWS) -> DataFrame:
    """Mean and variance of equal stretches of the values present; series of under 10 values have none."""
    # The count shares the places' window, and the groups its partitioning: one shuffle in all.
    placed = values_of(series).withColumn("n", F.count("*").over(whole_series()))
    bucket = F.call_function("div", F.lit(n_windows) * (F.col("pos") + 1) - 1, F.col("n")).cast("int")
    parts = placed.where("n >= 10").groupBy("series_id", bucket.alias("window")).agg(F.count("*").alias("len"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"))
    return parts.where("len >= 3 AND mean > 0 AND var > 0").drop("len")


def loglog_fit(points: DataFrame) -> DataFrame:
    """Slope and R2 of log variance on log mean; null for under four windows."""
    x, y = F.ln("mean"), F.ln("var")
    fit = points.groupBy("series_id").agg(F.count("*").alias("n_windows"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    few = F.col("n_windows") < 4
    return fit.select("series_id", "n_windows", F.when(~few, F.col("slope")).alias("slope_loglog"), F.when(~few, F.col("r2")).alias("r2_loglog"))


def cv_by_season(series: DataFrame, freq_hint: str | None) -> DataFrame:
    """Mean, deviation, count and their ratio for each season; series of under 10 values have none.

    A series' size is added up from its seasons, after they have been aggregated."""
    name, key = calendar.season_key(F.col("ts"), freq_hint)
    parts = series.where("y IS NOT NULL").groupBy("series_id", key.alias("g")).agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.count("*").alias("count"))
    parts = parts.withColumn("n", F.sum("count").over(whole_series())).where("n >= 10")
    return parts.select("series_id", F.lit(name).alias("group"), "g", "mean", "std", "count", F.try_divide("std", "mean").alias("cv"))


def cv_std(seasons: DataFrame) -> DataFrame:
    """The spread (over all seasons) of the seasons' ratios, where there are two."""
    return seasons.groupBy("series_id").agg(F.when(F.count("cv") >= 2, F.stddev_pop("cv")).alias("cv_std"))


def distribution(series: DataFrame) -> DataFrame:
    """Skew and excess kurtosis with the deviation of n-1, and the share of zeros; null for under five values."""
    n = F.col("n").cast("double")
    some = series.where("y IS NOT NULL").groupBy("series_id").agg(F.count("*").alias("n"), F.stddev_samp("y").alias("sd"), F.skewness("y").alias("s"), F.kurtosis("y").alias("k"), F.avg((F.col("y") == 0).cast("int")).alias("z"))
    shrink = F.try_divide(n - 1, n)
    flat = F.coalesce(F.col("sd"), F.lit(0.0)) == 0
    fine = F.col("n") >= 5
    return some.select(
        "series_id",
        F.when(fine, F.when(flat, 0.0).otherwise(F.col("s") * F.pow(shrink, F.lit(1.5)))).alias("skew"),
        F.when(fine, F.when(flat, 0.0).otherwise((F.col("k") + 3) * shrink * shrink - 3)).alias("kurtosis"),
        F.when(fine, F.col("z")).alias("zero_pct"),
    )


def mad_scores(series: DataFrame) -> DataFrame:
    """Every value present with its robust z; series of under 10 values have none. Both medians are taken where the series is."""
    w = whole_series()
    some = series.where("y IS NOT NULL").withColumn("n", F.count("*").over(w)).where("n >= 10")
    away = some.withColumn("off", F.col("y") - F.median("y").over(w))
    spread = away.withColumn("mad", F.median(F.abs("off")).over(w) + 1e-9)
    return spread.select("series_id", "ts", "y", (F.lit(0.6745) * F.col("off") / F.col("mad")).alias("z"))


def mad_outliers(series: DataFrame, threshold: float = OUTLIER_Z) -> DataFrame:
    return mad_scores(series).where(F.abs("z") > threshold)


def recommended_offset(series: DataFrame) -> DataFrame:
    low = F.min("y")
    return series.groupBy("series_id").agg(F.when(low <= 0, -low + 1e-6).otherwise(0.0).alias("recommended_offset"))


def _kernel(series: DataFrame, keys: list[str], work: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """work over each group's values in the order of time; a group is one series, held in one worker."""
    fields = [x.split()[0] for x in schema.split(", ")]
    kinds = dict(series.dtypes)
    key_schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable")
        rows = work(frame["y"].dropna().to_numpy(float))
        out = pd.DataFrame(rows, columns=fields, dtype=object if not rows else None)
        for k, v in zip(reversed(keys), reversed(key), strict=True):
            out.insert(0, k, v)
        return out

    return series.select(*keys, "ts", "y").groupBy(*keys).applyInPandas(each, f"{key_schema}, {schema}")


def boxcox_mle(series: DataFrame, offset: float | None = None) -> DataFrame:
    """lambda of greatest likelihood after the recommended offset (or the one given)."""

    def work(y):
        low = float(y.min()) if len(y) else 1.0
        own = offset if offset is not None else (-low + 1e-6 if low <= 0 else 0.0)
        lam, llf = kernels.boxcox_mle(y, own)
        return [{"boxcox_lambda_mle": lam, "boxcox_llf": llf}]

    return _kernel(series, ["series_id"], work, "boxcox_lambda_mle double, boxcox_llf double")


def boxcox_grid(series: DataFrame, lambdas: list[float], offset: float = 0.0) -> DataFrame:
    """The log-likelihood of each lambda, in one pass over the values: each row meets the short list of lambdas."""
    rows = series.where("y IS NOT NULL").select("series_id", (F.col("y") + offset).alias("x"), F.explode(F.array(*map(F.lit, lambdas))).alias("lambda"))
    z = F.when(F.col("lambda") == 0, F.ln("x")).otherwise(F.try_divide(F.pow("x", "lambda") - 1, F.col("lambda")))
    sums = rows.groupBy("series_id", "lambda").agg(F.sum(F.ln("x")).alias("logs"), F.var_pop(z).alias("v"), F.count("*").alias("n"))
    return sums.select("series_id", "lambda", ((F.col("lambda") - 1) * F.col("logs") - F.col("n") / 2 * F.ln("v")).alias("llf"))


def periodogram(series: DataFrame) -> DataFrame:
    """k, freq, power of the values present; series of under 16 have none."""

    def work(y):
        if len(y) < 16:
            return []
        freq, power = kernels.periodogram(y)
        return [{"k": k + 1, "freq": f, "power": p} for k, (f, p) in enumerate(zip(freq.tolist(), power.tolist(), strict=True))]

    return _kernel(series, ["series_id"], work, "k int, freq double, power double")


def spectral_peaks(spectrum: DataFrame) -> DataFrame:
    """Periods of the strict inner maxima of a periodogram: m, the greatest power that rounds to it."""
    w = Window.partitionBy("series_id").orderBy("k")
    size = F.bround(F.max(F.col("k") / F.col("freq")).over(whole_series()), 0).cast("int")
    marked = spectrum.withColumn("before", F.lag("power").over(w)).withColumn("after", F.lead("power").over(w)).withColumn("n", size)
    top = marked.where("power > before AND power > after").withColumn("m", F.bround(F.lit(1.0) / F.col("freq"), 0).cast("int"))
    kept = top.where("m >= 2 AND m <= n div 2")
    return kept.groupBy("series_id", "m").agg(F.max("power").alias("power"))


def period_candidates(series: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """rank, m, power, acf_at_m, verify_score: the strongest periods, each checked by its lag's correlation."""

    def work(y):
        return [{"rank": r, "m": m, "power": p, "acf_at_m": c, "verify_score": v} for r, (m, p, c, v) in enumerate(kernels.period_candidates(y, top_k), 1)]

    return _kernel(series, ["series_id"], work, "rank int, m int, power double, acf_at_m double, verify_score double")


def chosen_period(candidates: DataFrame) -> DataFrame:
    """The candidate of the best verified score, of equals the stronger."""
    return candidates.groupBy("series_id").agg(F.max_by("m", F.struct("verify_score", -F.col("rank"))).alias("chosen_m"))


def lag_correlation(series: DataFrame, k: int = 1) -> DataFrame:
    """Pearson correlation of the values present with those k places on; null where one side is constant."""
    pairs = series.where("y IS NOT NULL").select("series_id", "y", F.lag("y", k).over(by_time()).alias("x")).where("x IS NOT NULL")
    sums = pairs.groupBy("series_id").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("a"), F.stddev_pop("y").alias("b"), F.count("*").alias("n"))
    return sums.select("series_id", F.when(F.col("n") >= 3, F.try_divide(F.col("c"), F.col("a") * F.col("b"))).alias("corr"))


def acf(series: DataFrame, max_lags: int = MAX_LAGS) -> DataFrame:
    """lag, acf, acf_lo, acf_hi, n: biased autocorrelations with Bartlett's bounds, up to half the values; none for under 12.

    All lags come from one window over the series, added up in one aggregate."""
    some = series.where("y IS NOT NULL").withColumn("n", F.count("*").over(whole_series())).where("n >= 12")
    e = some.withColumn("e", F.col("y") - F.avg("y").over(whole_series()))
    shifted = e.select("series_id", "n", "e", *[F.lag("e", k).over(by_time()).alias(f"l{k}") for k in range(1, max_lags + 1)])
    sums = shifted.groupBy("series_id", "n").agg(F.sum(F.col("e") * F.col("e")).alias("g0"), F.array(F.sum(F.col("e") * F.col("e")), *[F.sum(F.col("e") * F.col(f"l{k}")) for k in range(1, max_lags + 1)]).alias("g"))
    nlags = F.least(F.lit(max_lags), F.call_function("div", F.col("n"), F.lit(2)).cast("int"))
    r = F.transform(F.slice("g", F.lit(1), nlags + 1), lambda x: F.try_divide(x, F.col("g0")))
    rows = sums.select("series_id", "n", r.alias("r")).select("series_id", "n", "r", F.posexplode("r").alias("lag", "acf"))
    before = F.aggregate(F.slice("r", F.lit(2), F.greatest(F.col("lag") - 1, F.lit(0))), F.lit(0.0), lambda t, x: t + x * x)
    error = F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1 + 2 * before) / F.col("n")))
    return rows.select("series_id", "lag", "acf", (F.col("acf") - kernels.Z975 * error).alias("acf_lo"), (F.col("acf") + kernels.Z975 * error).alias("acf_hi"), "n")


def pacf(series: DataFrame, max_lags: int = MAX_LAGS) -> DataFrame:
    """lag, pacf, pacf_lo, pacf_hi: Levinson-Durbin on adjusted autocovariances; none for under 12 values."""

    def work(y):
        n = len(y)
        if n < 12:
            return []
        found = kernels.pacf(y, min(max_lags, n // 2))
        wide = kernels.Z975 / n**0.5
        return [{"lag": k, "pacf": v, "pacf_lo": v - wide * (k > 0), "pacf_hi": v + wide * (k > 0)} for k, v in enumerate(found.tolist())]

    return _kernel(series, ["series_id"], work, "lag int, pacf double, pacf_lo double, pacf_hi double")


def acf_pacf(series: DataFrame, max_lags: int = MAX_LAGS) -> DataFrame:
    return acf(series, max_lags).join(pacf(series, max_lags), ["series_id", "lag"], "left")


def seasonal_lags(correlations: DataFrame, m: int) -> DataFrame:
    """The lags m, 2m, 3m that there are, and whether their bounds leave zero out."""
    some = correlations.where(F.col("lag").isin(m, 2 * m, 3 * m))
    return some.select("series_id", "lag", "acf", F.col("acf_lo").alias("ci_low"), F.col("acf_hi").alias("ci_high"), ((F.col("acf_lo") > 0) | (F.col("acf_hi") < 0)).alias("significant"))


def stationarity_tests(candidates: DataFrame) -> DataFrame:
    """adf_pvalue, kpss_pvalue, acf1, n for each (series_id, D_, d) of stacked candidates, D_ being the seasonal order; only n for under 12 values.

    If either test fails, both p-values are null."""

    def work(y):
        row = {"n": len(y), "adf_pvalue": None, "kpss_pvalue": None, "acf1": None}
        if len(y) >= 12:
            a, b = kernels.adf(y), kernels.kpss(y)
            if a is not None and b is not None:
                row |= {"adf_pvalue": a, "kpss_pvalue": b}
            row["acf1"] = kernels.pearson_at_lag(y, 1)
        return [row]

    return _kernel(candidates, ["series_id", "D_", "d"], work, "n int, adf_pvalue double, kpss_pvalue double, acf1 double")


def stl(series: DataFrame, m: int, robust: bool = True) -> DataFrame:
    """ts, observed, trend, seasonal, resid; series too short for two periods have none."""

    def each(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.dropna(subset=["y"]).sort_values("ts", kind="stable")
        y = frame["y"].to_numpy(float)
        if len(y) < max(10, 2 * m):
            nothing = frame.iloc[:0]
            return nothing.assign(observed=nothing["y"], trend=nothing["y"], seasonal=nothing["y"], resid=nothing["y"]).drop(columns="y")
        trend, season, rest = kernels.stl(y, m, robust)
        return pd.DataFrame({"series_id": key[0], "ts": frame["ts"].to_numpy(), "observed": y, "trend": trend, "seasonal": season, "resid": rest})

    return series.select("series_id", "ts", "y").groupBy("series_id").applyInPandas(each, "series_id string, ts timestamp_ntz, observed double, trend double, seasonal double, resid double")


def seasonal_prototype(series: DataFrame, m: int) -> DataFrame:
    """Each row with the mean of its phase; null where m is under 2 or the series is shorter."""
    placed = values_of(series)
    phase = Window.partitionBy("series_id", F.pmod("pos", F.lit(max(m, 1))))
    proto = F.when((F.lit(m) > 1) & (F.count("*").over(whole_series()) >= m), F.avg("y").over(phase))
    return placed.select("series_id", "ts", "y", F.lit(m).alias("m"), proto.alias("proto"))


class DiagnosticsEngine:
    """The diagnostics that steps run, gathered for one bundle."""

    def raw(self, view: SeriesView, freq_hint: str | None) -> dict:
        """Frames by name, and flags by series: one row each, null-safe."""
        y = view.y
        n = y.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
        window = rolling_window(int(n))
        points = window_mean_variance(y)
        seasons = cv_by_season(y, freq_hint)
        fit, spread = loglog_fit(points), cv_std(seasons)
        scales = F.coalesce((F.col("slope_loglog") > 0.7) & (F.col("r2_loglog") > 0.4), F.lit(False))
        flags = y.select("series_id").distinct().join(fit, "series_id", "left").join(spread, "series_id", "left").select(
            "series_id", "slope_loglog", "r2_loglog", "cv_std", scales.alias("variance_scales_with_level"), (scales & F.coalesce(F.col("cv_std") < 0.25, F.lit(False))).alias("likely_multiplicative")
        )
        return {
            "summary": summary(y), "missingness": missingness(y), "missing_blocks": missing_blocks(y), "rolling": rolling(y, window), "ratio": rolling_ratio(y, window), "window": window,
            "mean_variance": points, "loglog": fit, "cv_by_season": seasons, "distribution": distribution(y), "outliers": mad_outliers(y), "flags": flags,
        }

    def variance(self, view: SeriesView, flags: DataFrame) -> DataFrame:
        """The flags that raw has made, with needs_stabilization, suggested_transform, the offset and Box-Cox's lambda."""
        needs = F.col("variance_scales_with_level") | F.coalesce(F.col("cv_std") < 0.25, F.lit(False))
        joined = flags.join(recommended_offset(view.y), "series_id", "left").join(boxcox_mle(view.y), "series_id", "left")
        return joined.select(*[F.col(c) for c in flags.columns], needs.alias("needs_stabilization"), F.when(needs, "log").otherwise("none").alias("suggested_transform"), F.coalesce("recommended_offset", F.lit(0.0)).alias("recommended_offset"), "boxcox_lambda_mle", "boxcox_llf")

    def periods(self, view: SeriesView, top_k: int = TOP_K) -> DataFrame:
        return period_candidates(view.y, top_k)

    def stationarity(self, candidates: DataFrame) -> DataFrame:
        return stationarity_tests(candidates)

    def acf_pacf(self, view: SeriesView) -> DataFrame:
        return acf_pacf(view.y)

    def stl(self, view: SeriesView, m: int) -> DataFrame:
        return stl(view.y, m)
