"""What the plans of the time-series queries look like, and that the registry keeps its contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tsprep.plans import catalogue

#: Queries whose kernels run in Python, a series at a time.
KERNELS = {
    "periodogram_power", "spectral_peaks", "period_candidates", "chosen_period", "pacf_values", "acf_pacf_stems", "stationarity_sweep", "stationarity_selection", "boxcox_lambda", "stl_components", "freq_inferred", "freq_of_many", "variance_flags",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plan(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    if name not in KERNELS:
        assert "InPandas" not in plan and "InArrow" not in plan and "ArrowEvalPython" not in plan
    assert len(df.columns) == len({c.lower() for c in df.columns})


def test_scans_read_what_they_need(spark, sf_dir):
    spark.catalog.clearCache()
    plan = plan_of(catalogue.daily(spark, sf_dir))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert "partial_sum" in plan and plan.count("Exchange") == 1
    some = catalogue.table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1997-01-01 00:00:00'")
    assert "GreaterThanOrEqual(o_orderdate" in plan_of(catalogue.sr.resample(catalogue.sr.canonical(some, "o_orderdate", "o_totalprice"), "D"))


def test_a_series_is_shuffled_once(spark, sf_dir):
    y = catalogue.daily(spark, sf_dir)
    for f in (lambda: catalogue.dg.window_mean_variance(y), lambda: catalogue.dg.acf(y), lambda: catalogue.tr.difference(y, order=2), lambda: catalogue.dg.rolling(y, 52)):
        assert plan_of(f()).count("Exchange hashpartitioning") <= 2  # the buckets' and the series'


def test_keyed_series_join_by_key(spark, sf_dir):
    """The constant key of a single series is folded away; with a real key all joins are by it."""
    y = catalogue.daily(spark, sf_dir, "o_orderpriority")
    for f in (lambda: catalogue.dg.mad_outliers(y), lambda: catalogue.dg.cv_by_season(y, "D"), lambda: catalogue.sr.reindex(y, "D"), lambda: catalogue.sr.missing_dates(y, "D"), lambda: catalogue.sr.ranged_positions(y)):
        plan = plan_of(f())
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_long_axes_go_by_ranges(spark, sf_dir):
    y = catalogue.daily(spark, sf_dir, "o_orderpriority")
    facts = catalogue.frequency.axis_facts(y, long=True)
    windows = [line for line in plan_of(facts).splitlines() if " Window [" in line]
    assert windows and all("__range" in line for line in windows)
    key = ["series_id", "rows", "gap_min", "gap_max", "gap_top", "share", "months_min", "business", "weekdays", "nths"]
    assert sorted(facts.select(*key).collect()) == sorted(catalogue.frequency.axis_facts(y).select(*key).collect())


def test_long_calendars_are_made_in_stretches(spark):
    from datetime import datetime

    ends = spark.createDataFrame([("a", datetime(2020, 1, 1), datetime(2020, 1, 1, 3)), ("b", datetime(2020, 1, 1), datetime(2020, 1, 1)), ("c", None, None)], "series_id string, start timestamp_ntz, end timestamp_ntz")
    points = catalogue.sr.between(ends, "s", step=1000)
    assert {r.series_id: (r["count"], r.n, r.a, r.b) for r in points.groupBy("series_id").agg(F.count("*").alias("count"), F.count_distinct("ts").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()} == {
        "a": (10801, 10801, datetime(2020, 1, 1), datetime(2020, 1, 1, 3)), "b": (1, 1, datetime(2020, 1, 1), datetime(2020, 1, 1)),
    }


def test_registry():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 1000
