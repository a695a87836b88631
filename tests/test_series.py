from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tsprep.functions import calendar, dates, frequency
from tsprep.model import SchemaMetadata
from tsprep.operators import diagnostics as dg
from tsprep.operators import series as sr
from tsprep.operators import transforms as tr
from tsprep.operators.cleaner import TimeSeriesCleaner

START = datetime(2021, 1, 1)


def make(spark, values, step=timedelta(days=1), start=START):
    return sr.from_values(spark, [(start + k * step, v) for k, v in enumerate(values)])


def pulled(df, *order):
    return df.orderBy(*(order or ("ts",))).toPandas()


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(1)
    y = (50 + 0.7 * np.arange(137) + 10 * np.sin(2 * np.pi * np.arange(137) / 7) + rng.normal(size=137)).tolist()
    for k in (5, 6, 40, 136):
        y[k] = None
    return y, make(spark, y)


def test_from_values(spark):
    assert sr.from_values(spark, [1, None, 3.5]).count() == 3
    with pytest.raises(TypeError):
        sr.from_values(spark, "text")


@pytest.mark.parametrize("rule", ["D", "W", "W-WED", "MS", "ME", "QS", "QE", "YS", "YE", "QS-FEB", "6h", "90min", "2D", "h"])
@pytest.mark.parametrize("how", ["sum", "mean"])
def test_resample_like_pandas(spark, rule, how):
    rng = np.random.default_rng(3)
    times = [START + timedelta(minutes=int(m)) for m in np.sort(rng.integers(0, 60 * 24 * 200, 300))]
    values = rng.normal(size=300).tolist()
    got = pulled(sr.resample(sr.from_values(spark, list(zip(times, values, strict=True))), rule, how))
    s = pd.Series(values, index=pd.DatetimeIndex(times)).resample(rule)
    want = (s.sum(min_count=1) if how == "sum" else s.mean()).dropna()
    assert got.ts.tolist() == want.index.tolist()
    assert np.allclose(got.y, want.to_numpy())


@pytest.mark.parametrize("freq", ["D", "3D", "h", "36h", "90min", "W-SUN", "2W-MON", "MS", "2MS", "ME", "QS-OCT", "QE-DEC", "QS-FEB", "YS-JAN", "YE-MAR", "B", "BMS", "BME"])
def test_spine_like_pandas(spark, freq):
    a, b = datetime(2021, 1, 15, 10), datetime(2022, 8, 17, 12)
    got = pulled(sr.spine(sr.from_values(spark, [(a, 1), (b, 2)]), freq)).ts.tolist()
    assert got == pd.date_range(a, b, freq=freq).tolist()


@pytest.mark.parametrize("freq", ["D", "3D", "h", "36h", "90min", "10s", "W-SUN", "2W-MON", "MS", "2MS", "ME", "QS-OCT", "QE-DEC", "YS-JAN", "YE-MAR", "B", "BMS", "BME", "WOM-2TUE"])
def test_frequency_like_pandas(spark, freq):
    index = pd.date_range("2021-01-01", periods=30, freq=freq)
    got = frequency.infer_frequency(sr.from_values(spark, [(t.to_pydatetime(), 1) for t in index])).first()
    assert got.freq == pd.infer_freq(index) and got.is_regular


def test_frequency_of_irregular_axes(spark):
    days = [START + timedelta(days=k) for k in range(100) if k != 50]
    got = frequency.infer_frequency(sr.from_values(spark, [(t, 1) for t in days])).first()
    assert (got.freq, got.is_regular) == ("D", False)
    months = [t.to_pydatetime() for k, t in enumerate(pd.date_range("2021-01-01", periods=12, freq="MS")) if k != 5]
    assert frequency.infer_frequency(sr.from_values(spark, [(t, 1) for t in months])).first().freq is None
    assert frequency.infer_frequency(sr.from_values(spark, [(START, 1), (START + timedelta(1), 1)])).first().freq is None
    fifteenths = [datetime(2021, m, 15) for m in range(1, 13)]
    assert frequency.infer_frequency(sr.from_values(spark, [(t, 1) for t in fifteenths])).first().freq is None


def test_frequencies_beside_a_series_of_one(spark):
    one = sr.from_values(spark, [(START, 1)], "one")
    two = sr.from_values(spark, [(START + timedelta(days=3 * k), k) for k in range(9)], "two")
    got = {r.series_id: r.freq for r in frequency.infer_frequency(one.unionByName(two)).collect()}
    assert got == {"one": None, "two": "3D"}


def test_unknown_frequencies():
    for name in ("X", "0D", "W-FEB", "QS-SUN", ""):
        with pytest.raises(ValueError):
            calendar.frequency(name)


def test_duplicates(spark):
    rows = [(START, None, "b", 0), (START, None, None, 1), (START + timedelta(1), 2.0, None, 2), (START + timedelta(1), 3.0, "z", 3)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double, s string, __rid long")
    get = lambda p: [tuple(x) for x in pulled(sr.deduplicate(df, ["ts"], p))[["v", "s"]].astype(object).where(lambda x: x.notna(), None).to_numpy()]
    assert get("sum") == [(0.0, "b"), (5.0, "z")] and get("mean") == [(None, "b"), (2.5, "z")]
    assert get("first") == [(None, "b"), (2.0, None)] and get("last") == [(None, None), (3.0, "z")]
    with pytest.raises(ValueError):
        sr.deduplicate(df, ["ts"], "median")


def test_gaps_and_reindex(spark):
    s = sr.from_values(spark, [(START + timedelta(days=k), k) for k in (0, 1, 4, 5)])
    assert [t.day for t in pulled(sr.missing_dates(s, "D")).ts] == [3, 4]
    assert pulled(sr.reindex(s, "D")).y.isna().sum() == 2
    assert pulled(dg.missing_blocks(sr.reindex(s, "D")), "start")["length"].tolist() == [2]
    exog = s.limit(2).withColumnRenamed("y", "x")
    assert sr.align(s, exog).count() == 4 and sr.align(s, None) is None


def test_ranged_positions(spark, gappy):
    _, s = gappy
    both = s.unionByName(s.withColumn("series_id", sr.F.lit("b")))
    got = pulled(sr.ranged_positions(both, 5), "series_id", "ts")
    assert got.pos.tolist() == list(range(137)) * 2


def test_long_series_in_ranges(spark, gappy):
    y, s = gappy
    both = s.unionByName(s.withColumn("series_id", sr.F.lit("b")))
    for block in (14, 50, 1000):
        got = pulled(sr.ranged_rolling(both, 14, block, 5).where("series_id = 'b'"))
        want = pd.Series(y, dtype=float).rolling(14, min_periods=4)
        assert np.allclose(got.rolling_mean, want.mean(), equal_nan=True) and np.allclose(got.rolling_var, want.var(), equal_nan=True)
    rows = [(g, k, None if k % 5 == 0 else k * k) for g in ("a", "b") for k in range(60)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(3)
    for n in (1, 2, 7, 60):
        got = {(r.g, r.o): r.before for r in sr.with_previous(df, ["g"], "o", "v", n).collect()}
        assert got == {(g, k): None if k == 0 or (k - 1) % 5 == 0 else (k - 1) ** 2 for g, k, _ in rows}
    assert sr.with_previous(df.where("g = 'a'"), [], "o", "v", 4).where("before IS NULL").count() == 13
    with pytest.raises(ValueError):
        sr.ranged_rolling(s, 14, 5)


def test_many_ranges_take_few_comparisons(spark):
    """Each row was held against the end of every range: rows times ranges, as the ranges grow with the input."""
    df = spark.range(6000).select(sr.F.when(sr.F.col("id") > 9, sr.F.col("id") * sr.F.col("id") - 3000).alias("o"))
    for n in (1, 2, 3, 64, 500):
        ranged = sr.in_ranges(df, sr.F.col("o"), n)
        got = ranged.groupBy("__range").agg(sr.F.min("o").alias("least"), sr.F.max("o").alias("most"), sr.F.count("*").alias("rows")).orderBy("__range").collect()
        assert [r["__range"] for r in got] == list(range(max(n, 2))) and all(a.most < b.least for a, b in zip(got, got[1:], strict=False))
        assert max(r.rows for r in got) <= 6000 / max(n, 2) + 20 and ranged.where("o IS NULL").select("__range").distinct().collect() == [(0,)]
    plan = ranged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(">=") + plan.count("<=") <= 9
    # Rows of one time stay together, however many they are.
    assert sr.in_ranges(spark.range(900).select((sr.F.col("id") % 3).alias("o")), sr.F.col("o"), 100).select("o", "__range").distinct().count() == 3


def test_previous_of_several_values(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 1 else k, -k) for k in range(40)], "o long, a long, b long").repartition(3)
    for n in (1, 7, 40):
        got = {r.o: r.before for r in sr.with_previous(df, [], "o", ["a", "b"], n).collect()}
        assert got == {k: None if k == 0 else (None if (k - 1) % 4 == 1 else k - 1, 1 - k) for k in range(40)}


def test_rolling_like_pandas(spark, gappy):
    y, s = gappy
    want = pd.Series(y, dtype=float).rolling(14, min_periods=4)
    got = pulled(dg.rolling(s, 14))
    assert np.allclose(got.rolling_mean, want.mean(), equal_nan=True) and np.allclose(got.rolling_var, want.var(), equal_nan=True)
    ratio = pulled(dg.rolling_ratio(s, 14)).ratio_std_over_mean
    assert np.allclose(ratio, want.std() / want.mean(), equal_nan=True)
    assert [dg.rolling_window(n) for n in (0, 45, 55, 137, 9999)] == [5, 5, 6, 14, 52]


def test_mean_variance_windows(spark, gappy):
    y, s = gappy
    v = np.array([x for x in y if x is not None])
    edges = np.linspace(0, len(v), 13).astype(int)
    parts = [v[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    got = pulled(dg.window_mean_variance(s), "window")
    assert np.allclose(got["mean"], [p.mean() for p in parts]) and np.allclose(got["var"], [p.var(ddof=1) for p in parts])
    slope, r2 = np.polyfit(np.log(got["mean"]), np.log(got["var"]), 1)[0], np.corrcoef(np.log(got["mean"]), np.log(got["var"]))[0, 1] ** 2
    fit = dg.loglog_fit(dg.window_mean_variance(s)).first()
    assert np.isclose(fit.slope_loglog, slope) and np.isclose(fit.r2_loglog, r2)
    assert dg.window_mean_variance(make(spark, [1.0] * 9)).count() == 0


def test_distribution_and_outliers(spark, gappy):
    y, s = gappy
    v = np.array([x for x in y if x is not None])
    z = (v - v.mean()) / v.std(ddof=1)
    got = dg.distribution(s).first()
    assert np.isclose(got.skew, (z**3).mean()) and np.isclose(got.kurtosis, (z**4).mean() - 3) and got.zero_pct == 0
    flat = dg.distribution(make(spark, [0.0] * 6)).first()
    assert (flat.skew, flat.kurtosis, flat.zero_pct) == (0.0, 0.0, 1.0)
    assert dg.distribution(make(spark, [1.0, 2.0])).first().skew is None
    assert pulled(dg.mad_outliers(make(spark, [1.0, 2.0] * 10 + [500.0]))).y.tolist() == [500.0]
    assert dg.mad_outliers(make(spark, [1.0, 900.0])).count() == 0


def test_seasons(spark, gappy):
    y, s = gappy
    got = pulled(dg.cv_by_season(s, "D"), "g")
    p = pd.Series(y, index=pd.date_range(START, periods=137), dtype=float).dropna()
    want = p.groupby(p.index.dayofweek).agg(["mean", "std", "count"])
    assert got["group"].unique().tolist() == ["dayofweek"] and np.allclose(got[["mean", "std", "count"]], want)
    assert np.isclose(dg.cv_std(dg.cv_by_season(s, "D")).first().cv_std, (want["std"] / want["mean"]).std(ddof=0))
    names = {h: calendar.season_key(sr.F.col("ts"), h)[0] for h in ("W-THU", "W-WED", "W-SUN", "MS", None, "min", "h")}
    assert names == {"W-THU": "hour", "W-WED": "dayofweek", "W-SUN": "weekofyear", "MS": "month", None: "month", "min": "month", "h": "hour"}


def test_log_and_inverse(spark):
    s = make(spark, [1.0, None, 5.0])
    back = pulled(tr.log_transform(s, 2.0).withColumn("y", tr.log_inverse(sr.F.col("y"), 2.0))).y
    assert np.allclose(back, [1.0, np.nan, 5.0], equal_nan=True)
    with pytest.raises(ValueError, match="the least is -3"):
        tr.log_transform(make(spark, [-3.0, 1.0]))
    assert np.isclose(dg.recommended_offset(make(spark, [-3.0, 0.0])).first().recommended_offset, 3.000001)
    assert dg.recommended_offset(make(spark, [None, None])).first().recommended_offset == 0


def test_detrend_and_differences(spark, gappy):
    y, s = gappy
    v = np.array([np.nan if x is None else x for x in y])
    fine = np.isfinite(v)
    a, b = np.polyfit(np.arange(137)[fine], v[fine], 1)
    assert np.allclose(pulled(tr.detrend(s, "linear")).y, v - (a * np.arange(137) + b), equal_nan=True)
    p = pd.Series(v)
    assert np.allclose(pulled(tr.difference(s)).y, p.diff().dropna())
    assert np.allclose(pulled(tr.difference(tr.seasonal_difference(s, 7))).y, p.diff(7).dropna().diff().dropna())
    for bad in (lambda: tr.detrend(s, "cubic"), lambda: tr.seasonal_difference(s, 1), lambda: tr.detrend_linear(make(spark, [1.0, 2.0]))):
        with pytest.raises(ValueError):
            bad()


def test_lag_correlation(spark, gappy):
    y, s = gappy
    v = np.array([x for x in y if x is not None])
    assert np.isclose(dg.lag_correlation(s, 7).first()["corr"], np.corrcoef(v[:-7], v[7:])[0, 1])
    assert dg.lag_correlation(make(spark, [3.0] * 20)).first()["corr"] is None


def test_date_formats(spark):
    texts = {"2021-01-05": "2021-01-05 00:00:00", "20210105": "2021-01-05 00:00:00", "01/02/2021": "2021-01-02 00:00:00", "2021": "2021-01-01 00:00:00", "2021-01-05T03:04:05Z": "2021-01-05 03:04:05", "2021-01-05 03:04:05.25": "2021-01-05 03:04:05.25", "2500": None, "10": None, "202101": None, "x": None}
    for text, want in texts.items():
        got = spark.createDataFrame([(text,)], "v string").select(dates.parse(sr.F.col("v"), dates.guess_format(text)).cast("string").alias("t")).first().t
        assert got == want, text
    assert dates.spark_format("%d.%m.%Y %H:%M") == "dd.MM.yyyy HH:mm"
    with pytest.raises(ValueError):
        dates.spark_format("%Q")


def cleaned(spark, rows, **options):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "date string, v double, __rid long")
    return TimeSeriesCleaner(df, SchemaMetadata("date", "v", [], ["v"], ["date"], []), **options).clean()


def test_cleaner(spark):
    rows = [("2021-01-02", 2.0), ("2021-01-01", 1.0), ("oops", 9.0), ("2021-01-01", float("nan")), ("2021-01-05", 5.0)]
    df, meta = cleaned(spark, rows, freq="D", missing="reindex")
    assert (meta.n_obs, meta.n_missing_dates, meta.has_missing_dates, meta.has_duplicates, meta.freq) == (5, 2, True, True, "D")
    assert pulled(df).v.fillna(-1).tolist() == [1.0, 2.0, -1, -1, 5.0]
    assert any("does not parse" in n for n in meta.notes)
    with pytest.raises(ValueError):
        cleaned(spark, [("x", 1.0)])
    with pytest.raises(ValueError):
        cleaned(spark, rows, duplicates="median")
    df, meta = cleaned(spark, [(f"2021-01-{k:02d}", float(k)) for k in range(1, 15)])
    assert (meta.freq, meta.is_regular, meta.n_missing_dates) == ("D", True, 0)
