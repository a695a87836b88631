"""The registry of queries over the test tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frequency
from ..model import DiagnosticsPacket, PreModelState, SeriesBundle, StationarityPolicy, TransformPlan, with_changes
from ..operators import diagnostics as dg
from ..operators import roles, selection
from ..operators import series as sr
from ..operators import transforms as tr
from ..operators.cleaner import TimeSeriesCleaner
from ..sources.ingest import DataIngestor
from . import frames
from .frames import stems
from .pipeline import STEPS as PLAN_STEPS
from .pipeline import PreModelOrchestrator, ViewBuilder, stacked
from .workbench import Workbench

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(name: str | Column, k: int, to: str | None = None) -> Column:
    """Rounded, so that the order of additions does not show; plus zero, so that there is no negative zero."""
    column = F.col(name) if isinstance(name, str) else name
    return (F.round(column, k) + F.lit(0.0)).alias(to or name)


def daily(spark, sf_dir, by: str | None = None) -> DataFrame:
    return sr.resample(sr.canonical(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", by), "D")


def monthly(spark, sf_dir) -> DataFrame:
    return sr.resample(sr.canonical(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "MS")


def hourly(spark, sf_dir, by: str | None = None) -> DataFrame:
    return sr.resample(sr.canonical(table(spark, sf_dir, "events"), "ts", "value", by), "h")


def regridded(spark, sf_dir) -> DataFrame:
    return sr.reindex(daily(spark, sf_dir), "D")


D = "d AS (SELECT 'all' AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS y FROM orders GROUP BY ALL)"
H = "h AS (SELECT 'all' AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value) AS y FROM events GROUP BY ALL)"
M = "m AS (SELECT 'all' AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS y FROM orders GROUP BY ALL)"
SPINE = "spine AS (SELECT 'all' AS series_id, unnest(generate_series((SELECT min(ts) FROM d), (SELECT max(ts) FROM d), INTERVAL 1 DAY)) AS ts)"
GRID = f"{D}, {SPINE}, g AS (SELECT s.series_id, s.ts, d.y FROM spine s LEFT JOIN d USING (series_id, ts))"
PLACED = "p AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM d WHERE y IS NOT NULL)"


@query(f"WITH {D} SELECT series_id, ts, round(y, 2) + 0.0 AS y FROM d")
def resample_daily_sum(spark, sf_dir):
    return daily(spark, sf_dir).select("series_id", "ts", r("y", 2))


@query("SELECT 'all' AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(avg(value), 6) + 0.0 AS y FROM events GROUP BY ALL")
def resample_hourly_mean(spark, sf_dir):
    return sr.resample(sr.canonical(table(spark, sf_dir, "events"), "ts", "value"), "h", "mean").select("series_id", "ts", r("y", 6))


@query("SELECT 'all' AS series_id, (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) + 0.0 AS y FROM orders GROUP BY ALL")
def resample_weekly(spark, sf_dir):
    return sr.resample(sr.canonical(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "W").select("series_id", "ts", r("y", 2))


@query("SELECT 'all' AS series_id, last_day(o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) + 0.0 AS y FROM orders GROUP BY ALL")
def resample_month_end(spark, sf_dir):
    return sr.resample(sr.canonical(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "ME").select("series_id", "ts", r("y", 2))


@query("SELECT 'all' AS series_id, date_trunc('quarter', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) + 0.0 AS y FROM orders GROUP BY ALL")
def resample_quarter_start(spark, sf_dir):
    return sr.resample(sr.canonical(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "QS").select("series_id", "ts", r("y", 2))


@query("SELECT 'all' AS series_id, time_bucket(INTERVAL '6 hours', ts, (SELECT date_trunc('day', min(ts)) FROM events)::TIMESTAMP) AS ts, round(sum(value), 2) + 0.0 AS y FROM events GROUP BY ALL")
def resample_six_hours(spark, sf_dir):
    return sr.resample(sr.canonical(table(spark, sf_dir, "events"), "ts", "value"), "6h").select("series_id", "ts", r("y", 2))


@query("SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) + 0.0 AS y FROM orders GROUP BY ALL")
def resample_daily_by_priority(spark, sf_dir):
    return daily(spark, sf_dir, "o_orderpriority").select("series_id", "ts", r("y", 2))


def shipments(spark, sf_dir) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag").alias("__rid")
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), "l_quantity", "l_extendedprice", "l_returnflag", order)


SHIPMENTS = "o AS (SELECT *, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) AS a, count(*) OVER (PARTITION BY l_shipdate) AS n FROM lineitem)"


@query(f"WITH {SHIPMENTS} SELECT l_shipdate AS ts, round(sum(l_quantity), 2) + 0.0 AS l_quantity, round(sum(l_extendedprice), 2) + 0.0 AS l_extendedprice, max(l_returnflag) FILTER (a = 1) AS l_returnflag FROM o GROUP BY l_shipdate")
def dedupe_sum(spark, sf_dir):
    return sr.deduplicate(shipments(spark, sf_dir), ["ts"], "sum").select("ts", r("l_quantity", 2), r("l_extendedprice", 2), "l_returnflag")


@query(f"WITH {SHIPMENTS} SELECT l_shipdate AS ts, round(avg(l_quantity), 9) + 0.0 AS l_quantity, round(avg(l_extendedprice), 9) + 0.0 AS l_extendedprice, max(l_returnflag) FILTER (a = 1) AS l_returnflag FROM o GROUP BY l_shipdate")
def dedupe_mean(spark, sf_dir):
    return sr.deduplicate(shipments(spark, sf_dir), ["ts"], "mean").select("ts", r("l_quantity", 9), r("l_extendedprice", 9), "l_returnflag")


@query(f"WITH {SHIPMENTS} SELECT l_shipdate AS ts, l_quantity, l_extendedprice, l_returnflag FROM o WHERE a = 1")
def dedupe_first(spark, sf_dir):
    return sr.deduplicate(shipments(spark, sf_dir), ["ts"], "first").drop("__rid")


@query(f"WITH {SHIPMENTS} SELECT l_shipdate AS ts, l_quantity, l_extendedprice, l_returnflag FROM o WHERE a = n")
def dedupe_last(spark, sf_dir):
    return sr.deduplicate(shipments(spark, sf_dir), ["ts"], "last").drop("__rid")


@query("SELECT count(*) AS n, count(DISTINCT l_shipdate) AS n_dates, count(*) > count(DISTINCT l_shipdate) AS has_duplicates FROM lineitem")
def duplicate_dates(spark, sf_dir):
    some = shipments(spark, sf_dir).groupBy("ts").count()
    return some.agg(F.sum("count").alias("n"), F.count("ts").alias("n_dates")).withColumn("has_duplicates", F.col("n") > F.col("n_dates"))


@query(f"WITH {D}, {SPINE} SELECT series_id, ts FROM spine")
def calendar_spine(spark, sf_dir):
    return sr.spine(daily(spark, sf_dir), "D")


@query(f"WITH {D}, {SPINE} SELECT series_id, ts FROM spine ANTI JOIN d USING (series_id, ts)")
def missing_dates(spark, sf_dir):
    return sr.missing_dates(daily(spark, sf_dir), "D")


@query(f"WITH {GRID} SELECT series_id, ts, round(y, 2) + 0.0 AS y FROM g")
def reindex_full(spark, sf_dir):
    return regridded(spark, sf_dir).select("series_id", "ts", r("y", 2))


@query(f"WITH {D}, x AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) SELECT d.series_id, d.ts, round(x.quantity, 2) + 0.0 AS quantity FROM d LEFT JOIN x USING (ts)")
def align_exog(spark, sf_dir):
    exog = sr.resample(sr.canonical(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity"), "D").withColumnRenamed("y", "quantity")
    return sr.align(daily(spark, sf_dir), exog).select("series_id", "ts", r("quantity", 2))


GAPS = "gaps AS (SELECT series_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY ts) AS delta_us, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS k FROM d)"


@query(f"WITH {D}, {GAPS} SELECT series_id, delta_us, count(*) AS count FROM gaps WHERE delta_us IS NOT NULL GROUP BY ALL")
def gap_deltas(spark, sf_dir):
    return sr.deltas(daily(spark, sf_dir)).groupBy("series_id", "delta_us").count()


DOMINANT = f"{D}, {GAPS}, c AS (SELECT series_id, delta_us, count(*) AS c, min(k) AS k FROM gaps WHERE delta_us IS NOT NULL GROUP BY ALL), top AS (SELECT series_id, delta_us, c AS count, c / sum(c) OVER (PARTITION BY series_id) AS share, count(*) OVER (PARTITION BY series_id) AS gaps, row_number() OVER (PARTITION BY series_id ORDER BY c DESC, k) AS n FROM c)"


@query(f"WITH {DOMINANT} SELECT series_id, delta_us, count, round(share, 9) + 0.0 AS share FROM top WHERE n = 1")
def dominant_delta(spark, sf_dir):
    return sr.dominant_delta(daily(spark, sf_dir)).select("series_id", "delta_us", "count", r("share", 9))


@query(f"WITH {DOMINANT} SELECT series_id, CASE WHEN share >= 0.95 THEN CASE WHEN delta_us = 86400000000 THEN 'D' ELSE (delta_us // 86400000000) || 'D' END END AS freq, gaps = 1 AS is_regular, round(share, 9) + 0.0 AS share FROM top WHERE n = 1")
def freq_inferred(spark, sf_dir):
    return frequency.infer_frequency(daily(spark, sf_dir)).select("series_id", "freq", "is_regular", r("share", 9))


#: Steps between the periods of each rule, counted in its own unit; one kind of step is a regular axis.
STEPS = """a AS (SELECT DISTINCT 'D' AS series_id, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS k FROM orders
UNION SELECT 'W', datediff('week', DATE '1970-01-05', o_orderdate::DATE) FROM orders UNION SELECT 'MS', datediff('month', DATE '1970-01-01', o_orderdate::DATE) FROM orders
UNION SELECT 'ME', datediff('month', DATE '1970-01-01', o_orderdate::DATE) FROM orders UNION SELECT 'QS', datediff('quarter', DATE '1970-01-01', o_orderdate::DATE) FROM orders
UNION SELECT 'h', datediff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)::TIMESTAMP) FROM events),
s AS (SELECT series_id, k - lag(k) OVER (PARTITION BY series_id ORDER BY k) AS step FROM a), c AS (SELECT series_id, step, count(*) AS c FROM s WHERE step IS NOT NULL GROUP BY ALL),
f AS (SELECT series_id, max_by(step, c) AS step, count(*) = 1 AS is_regular, max(c) / sum(c) AS share, count(*) AS kinds FROM c GROUP BY series_id)"""


@query(f"""WITH {STEPS} SELECT series_id, CASE WHEN is_regular OR share >= 0.95 AND series_id IN ('D', 'h') THEN CASE WHEN step > 1 THEN step::VARCHAR ELSE '' END || CASE series_id WHEN 'W' THEN 'W-SUN' WHEN 'QS' THEN 'QS-OCT' ELSE series_id END END AS freq, is_regular FROM f""")
def freq_of_many(spark, sf_dir):
    """Frequencies of daily, weekly, monthly, month-end, quarterly and hourly versions, each a series of its own."""
    orders = sr.canonical(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    parts = [sr.resample(orders, rule).withColumn("series_id", F.lit(rule)) for rule in ("D", "W", "MS", "ME", "QS")] + [hourly(spark, sf_dir).withColumn("series_id", F.lit("h"))]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return frequency.infer_frequency(both).select("series_id", "freq", "is_regular")


@query(f"WITH {GRID}, o AS (SELECT *, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY y IS NULL ORDER BY ts) AS run FROM g) SELECT series_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS length FROM o WHERE y IS NULL GROUP BY series_id, run")
def missing_blocks(spark, sf_dir):
    return dg.missing_blocks(regridded(spark, sf_dir))


@query(f"WITH {GRID} SELECT series_id, count(*) AS n, count(y) AS n_nonmissing, round(avg(y), 4) + 0.0 AS mean, round(stddev_samp(y), 4) + 0.0 AS std FROM g GROUP BY series_id")
def summary_stats(spark, sf_dir):
    return dg.summary(regridded(spark, sf_dir)).select("series_id", "n", "n_nonmissing", r("mean", 4), r("std", 4))


@query(f"WITH {GRID} SELECT series_id, count(*) FILTER (y IS NULL) AS missing_count, round(avg((y IS NULL)::INT), 9) + 0.0 AS missing_pct FROM g GROUP BY series_id")
def missingness(spark, sf_dir):
    return dg.missingness(regridded(spark, sf_dir)).select("series_id", "missing_count", r("missing_pct", 9))


ROLL = "WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"


@query(f"WITH {GRID} SELECT series_id, ts, CASE WHEN count(y) OVER w >= 17 THEN round(avg(y) OVER w, 4) + 0.0 END AS rolling_mean, CASE WHEN count(y) OVER w >= 17 THEN round(sqrt(var_samp(y) OVER w), 2) + 0.0 END AS rolling_std, 52 AS \"window\" FROM g {ROLL}")
def rolling_mean_var(spark, sf_dir):
    return dg.rolling(regridded(spark, sf_dir), dg.rolling_window(1000)).select("series_id", "ts", r("rolling_mean", 4), r(F.sqrt("rolling_var"), 2, "rolling_std"), "window")


@query(f"WITH {GRID} SELECT series_id, ts, CASE WHEN count(y) OVER w >= 17 THEN round(stddev_samp(y) OVER w / nullif(avg(y) OVER w, 0), 8) + 0.0 END AS ratio_std_over_mean, 52 AS \"window\" FROM g {ROLL}")
def rolling_cv_ratio(spark, sf_dir):
    return dg.rolling_ratio(regridded(spark, sf_dir), dg.rolling_window(1000)).select("series_id", "ts", r("ratio_std_over_mean", 8), "window")


POINTS = "pts AS (SELECT series_id, ((12 * (pos + 1) - 1) // n)::INT AS \"window\", avg(y) AS mean, var_samp(y) AS var FROM p WHERE n >= 10 GROUP BY ALL HAVING count(*) >= 3 AND avg(y) > 0 AND var_samp(y) > 0)"


@query(f"WITH {D}, {PLACED}, {POINTS} SELECT series_id, \"window\", round(mean, 2) + 0.0 AS mean, round(sqrt(var), 2) + 0.0 AS std FROM pts")
def window_mean_variance(spark, sf_dir):
    return dg.window_mean_variance(daily(spark, sf_dir)).select("series_id", "window", r("mean", 2), r(F.sqrt("var"), 2, "std"))


@query(f"WITH {D}, {PLACED}, {POINTS} SELECT series_id, count(*) AS n_windows, round(regr_slope(ln(var), ln(mean)), 6) + 0.0 AS slope_loglog, round(regr_r2(ln(var), ln(mean)), 6) + 0.0 AS r2_loglog FROM pts GROUP BY series_id")
def loglog_fit(spark, sf_dir):
    return dg.loglog_fit(dg.window_mean_variance(daily(spark, sf_dir))).select("series_id", "n_windows", r("slope_loglog", 6), r("r2_loglog", 6))


def season_sql(cte: str, name: str, group: str, key: str) -> str:
    return f"WITH {cte} SELECT series_id, '{group}' AS \"group\", {key}::INT AS g, round(avg(y), 2) + 0.0 AS mean, round(stddev_samp(y), 2) + 0.0 AS std, count(*) AS count, round(stddev_samp(y) / nullif(avg(y), 0), 8) + 0.0 AS cv FROM {name} GROUP BY ALL"


def _seasons(df):
    return df.select("series_id", "group", "g", r("mean", 2), r("std", 2), "count", r("cv", 8))


@query(season_sql(M, "m", "month", "month(ts)"))
def cv_by_month(spark, sf_dir):
    return _seasons(dg.cv_by_season(monthly(spark, sf_dir), "MS"))


@query(season_sql(D, "d", "dayofweek", "(isodow(ts) - 1)"))
def cv_by_dow(spark, sf_dir):
    return _seasons(dg.cv_by_season(daily(spark, sf_dir), "D"))


@query(season_sql(H, "h", "hour", "hour(ts)"))
def cv_by_hour(spark, sf_dir):
    return _seasons(dg.cv_by_season(hourly(spark, sf_dir), "h"))


@query(f"WITH {D}, s AS (SELECT series_id, isodow(ts) AS g, stddev_samp(y) / avg(y) AS cv FROM d GROUP BY ALL) SELECT series_id, round(stddev_pop(cv), 9) + 0.0 AS cv_std FROM s GROUP BY series_id")
def cv_std(spark, sf_dir):
    return dg.cv_std(dg.cv_by_season(daily(spark, sf_dir), "D")).select("series_id", r("cv_std", 9))


@query(f"""WITH {D}, a AS (SELECT series_id, avg(y) AS mu, stddev_samp(y) AS sd FROM d GROUP BY series_id)
SELECT series_id, round(avg(power((y - mu) / sd, 3)), 6) + 0.0 AS skew, round(avg(power((y - mu) / sd, 4)) - 3, 6) + 0.0 AS kurtosis, round(avg((y = 0)::INT), 9) + 0.0 AS zero_pct FROM d JOIN a USING (series_id) GROUP BY series_id""")
def distribution(spark, sf_dir):
    return dg.distribution(daily(spark, sf_dir)).select("series_id", r("skew", 6), r("kurtosis", 6), r("zero_pct", 9))


MAD = "med AS (SELECT series_id, median(y) AS med FROM d GROUP BY series_id), mad AS (SELECT series_id, any_value(med) AS med, median(abs(y - med)) + 1e-9 AS mad FROM d JOIN med USING (series_id) GROUP BY series_id), z AS (SELECT series_id, ts, y, 0.6745 * (y - med) / mad AS z FROM d JOIN mad USING (series_id))"


@query(f"WITH {D}, {MAD} SELECT series_id, ts, round(y, 2) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM z")
def mad_scores(spark, sf_dir):
    return dg.mad_scores(daily(spark, sf_dir)).select("series_id", "ts", r("y", 2), r("z", 6))


@query(f"WITH {M.replace('m AS', 'd AS')}, {MAD} SELECT series_id, ts, round(y, 2) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM z WHERE abs(z) > 4.0")
def mad_outliers(spark, sf_dir):
    return dg.mad_outliers(monthly(spark, sf_dir)).select("series_id", "ts", r("y", 2), r("z", 6))


def balances(spark, sf_dir) -> DataFrame:
    """Customers' balances, some below zero, in the order of their keys a day apart."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.lit("all").alias("series_id"), F.date_from_unix_date(F.col("c_custkey").cast("int")).cast("timestamp_ntz").alias("ts"), F.col("c_acctbal").alias("y"))


BALANCES = "d AS (SELECT 'all' AS series_id, (DATE '1970-01-01' + c_custkey::INT)::TIMESTAMP AS ts, c_acctbal AS y FROM customer), o AS (SELECT CASE WHEN min(y) <= 0 THEN -min(y) + 1e-6 ELSE 0.0 END AS recommended_offset FROM d)"


@query(f"WITH {BALANCES} SELECT 'all' AS series_id, round(recommended_offset, 8) + 0.0 AS recommended_offset FROM o")
def recommended_offset(spark, sf_dir):
    return dg.recommended_offset(balances(spark, sf_dir)).select("series_id", r("recommended_offset", 8))


def _logged(spark, sf_dir):
    y = balances(spark, sf_dir)
    offset = dg.recommended_offset(y).first().recommended_offset
    return tr.log_transform(y, offset + 1), offset + 1


@query(f"WITH {BALANCES} SELECT series_id, ts, round(ln(y + recommended_offset + 1), 8) + 0.0 AS y FROM d, o")
def log_transform(spark, sf_dir):
    return _logged(spark, sf_dir)[0].select("series_id", "ts", r("y", 8))


@query(f"WITH {BALANCES} SELECT series_id, ts, round(exp(ln(y + recommended_offset + 1)) - recommended_offset - 1, 6) + 0.0 AS y FROM d, o")
def log_inverse(spark, sf_dir):
    logged, offset = _logged(spark, sf_dir)
    return logged.select("series_id", "ts", r(tr.log_inverse(F.col("y"), offset), 6, "y"))


@query(f"""WITH {D}, l AS (SELECT unnest([-1.0, -0.5, 0.0, 0.5, 1.0, 2.0])::DOUBLE AS lam),
s AS (SELECT series_id, lam, sum(ln(y)) AS logs, var_pop(CASE WHEN lam = 0 THEN ln(y) ELSE (power(y, lam) - 1) / nullif(lam, 0) END) AS v, count(*) AS n FROM d, l GROUP BY ALL)
SELECT series_id, lam AS "lambda", round((lam - 1) * logs - n / 2.0 * ln(v), 3) + 0.0 AS llf FROM s""")
def boxcox_grid_llf(spark, sf_dir):
    return dg.boxcox_grid(daily(spark, sf_dir), [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]).select("series_id", "lambda", r("llf", 3))


@query(f"WITH {D}, {PLACED}, f AS (SELECT regr_slope(y, pos) AS a, regr_intercept(y, pos) AS b FROM p) SELECT series_id, ts, round(y - (a * pos + b), 2) + 0.0 AS y FROM p, f")
def detrend_linear(spark, sf_dir):
    return tr.detrend(daily(spark, sf_dir), "linear").select("series_id", "ts", r("y", 2))


def diff_sql(lags: list[int]) -> str:
    ctes, last = [D], "d"
    for k, lag in enumerate(lags):
        ctes.append(f"x{k} AS (SELECT * FROM (SELECT series_id, ts, y - lag(y, {lag}) OVER (PARTITION BY series_id ORDER BY ts) AS y FROM {last}) WHERE y IS NOT NULL)")
        last = f"x{k}"
    return f"WITH {', '.join(ctes)} SELECT series_id, ts, round(y, 2) + 0.0 AS y FROM {last}"


@query(diff_sql([1]))
def detrend_diff1(spark, sf_dir):
    return tr.detrend(daily(spark, sf_dir), "diff1").select("series_id", "ts", r("y", 2))


@query(diff_sql([1]))
def diff_d1(spark, sf_dir):
    return tr.difference(daily(spark, sf_dir)).select("series_id", "ts", r("y", 2))


@query(diff_sql([1, 1]))
def diff_d2(spark, sf_dir):
    return tr.difference(daily(spark, sf_dir), order=2).select("series_id", "ts", r("y", 2))


@query(diff_sql([7]))
def seasonal_diff_7(spark, sf_dir):
    return tr.seasonal_difference(daily(spark, sf_dir), 7).select("series_id", "ts", r("y", 2))


@query(diff_sql([7, 1]))
def seasonal_then_regular(spark, sf_dir):
    plan = TransformPlan(seasonal_period_m=7, D=1, d=1)
    return tr.TransformEngine().stationary(SeriesBundle(daily(spark, sf_dir)), plan).y.select("series_id", "ts", r("y", 2))


@query(f"WITH {D}, {PLACED} SELECT series_id, ts, round(y, 2) + 0.0 AS y, pos FROM p WHERE pos < 100")
def first_values(spark, sf_dir):
    return tr.values_of(daily(spark, sf_dir)).where("pos < 100").select("series_id", "ts", r("y", 2), "pos")


@query("SELECT event_type AS series_id, ts, round(value, 6) + 0.0 AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS pos FROM events")
def ranged_positions(spark, sf_dir):
    return sr.ranged_positions(sr.canonical(table(spark, sf_dir, "events"), "ts", "value", "event_type")).select("series_id", "ts", r("y", 6), "pos")


@query(f"WITH h AS (SELECT event_type AS series_id, ts, value AS y FROM events) SELECT series_id, ts, CASE WHEN count(y) OVER w >= 17 THEN round(avg(y) OVER w, 8) + 0.0 END AS rolling_mean, CASE WHEN count(y) OVER w >= 17 THEN round(sqrt(var_samp(y) OVER w), 8) + 0.0 END AS rolling_std FROM h {ROLL}")
def rolling_long_series(spark, sf_dir):
    """Rolling figures over raw events, a block of rows at a time."""
    found = sr.ranged_rolling(sr.canonical(table(spark, sf_dir, "events"), "ts", "value", "event_type"), 52, 500)
    return found.select("series_id", "ts", r("rolling_mean", 8), r(F.sqrt("rolling_var"), 8, "rolling_std"))


DFT = f"""{H}, q AS (SELECT series_id, y - avg(y) OVER () AS e, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS n FROM h),
k AS (SELECT unnest(generate_series(1, (SELECT max(n) // 2 FROM q))) AS k),
f AS (SELECT series_id, k, any_value(n) AS n, sum(e * cos(2 * pi() * k * t / n)) AS c, sum(e * sin(2 * pi() * k * t / n)) AS s FROM q, k GROUP BY series_id, k),
spec AS (SELECT series_id, k::INT AS k, n, k / n AS freq, (c * c + s * s) / n * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS power FROM f)"""
PEAKS = f"{DFT}, tops AS (SELECT * FROM (SELECT *, lag(power) OVER (ORDER BY k) AS a, lead(power) OVER (ORDER BY k) AS b FROM spec) WHERE power > a AND power > b), per AS (SELECT series_id, round_even(n / k, 0)::INT AS m, max(power) AS power FROM tops GROUP BY series_id, round_even(n / k, 0)::INT, n HAVING round_even(n / k, 0)::INT BETWEEN 2 AND n // 2)"
CANDIDATES = f"""{PEAKS}, ranked AS (SELECT *, row_number() OVER (ORDER BY power DESC) AS rank FROM per), c5 AS (SELECT * FROM ranked WHERE rank <= 5),
cor AS (SELECT c5.rank, corr(a.e, b.e) AS r FROM c5 JOIN q a ON true JOIN q b ON b.t = a.t + c5.m GROUP BY c5.rank),
cand AS (SELECT series_id, rank::INT AS rank, m, power, r AS acf_at_m, greatest(0, coalesce(r, 0)) AS verify_score FROM c5 JOIN cor USING (rank))"""


@query(f"WITH {DFT} SELECT series_id, k, round(freq, 9) + 0.0 AS freq, round(power, 3) + 0.0 AS power FROM spec")
def periodogram_power(spark, sf_dir):
    return dg.periodogram(hourly(spark, sf_dir)).select("series_id", "k", r("freq", 9), r("power", 3))


@query(f"WITH {PEAKS} SELECT series_id, m, round(power, 3) + 0.0 AS power FROM per")
def spectral_peaks(spark, sf_dir):
    return dg.spectral_peaks(dg.periodogram(hourly(spark, sf_dir))).select("series_id", "m", r("power", 3))


@query(f"WITH {CANDIDATES} SELECT series_id, rank, m, round(power, 3) + 0.0 AS power, round(acf_at_m, 8) + 0.0 AS acf_at_m, round(verify_score, 8) + 0.0 AS verify_score FROM cand")
def period_candidates(spark, sf_dir):
    return dg.period_candidates(hourly(spark, sf_dir)).select("series_id", "rank", "m", r("power", 3), r("acf_at_m", 8), r("verify_score", 8))


@query(f"WITH {CANDIDATES} SELECT series_id, m AS chosen_m FROM cand ORDER BY verify_score DESC, rank LIMIT 1")
def chosen_period(spark, sf_dir):
    return dg.chosen_period(dg.period_candidates(hourly(spark, sf_dir)))


ACF = """q AS (SELECT series_id, y - avg(y) OVER () AS e, row_number() OVER (ORDER BY ts) AS t, count(*) OVER () AS n FROM d),
l AS (SELECT unnest(generate_series(0, least(60, (SELECT max(n) // 2 FROM q)))) AS lag),
c AS (SELECT a.series_id, l.lag, any_value(a.n) AS n, sum(a.e * b.e) AS g FROM l JOIN q a ON true JOIN q b ON b.t = a.t + l.lag GROUP BY ALL),
k AS (SELECT series_id, lag, n, g / (SELECT g FROM c WHERE lag = 0) AS acf FROM c),
se AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf ELSE 0 END) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END AS se FROM k)"""


@query(f"WITH {D}, {ACF} SELECT series_id, lag::INT AS lag, round(acf, 8) + 0.0 AS acf, round(acf - 1.959963984540054 * se, 8) + 0.0 AS acf_lo, round(acf + 1.959963984540054 * se, 8) + 0.0 AS acf_hi, n FROM se")
def acf_values(spark, sf_dir):
    return dg.acf(daily(spark, sf_dir)).select("series_id", "lag", r("acf", 8), r("acf_lo", 8), r("acf_hi", 8), "n")


@query(f"WITH {D}, {ACF} SELECT series_id, lag::INT AS lag, round(acf, 8) + 0.0 AS acf, round(acf - 1.959963984540054 * se, 8) + 0.0 AS ci_low, round(acf + 1.959963984540054 * se, 8) + 0.0 AS ci_high, acf - 1.959963984540054 * se > 0 OR acf + 1.959963984540054 * se < 0 AS significant FROM se WHERE lag IN (7, 14, 21)")
def acf_seasonal_lags(spark, sf_dir):
    return dg.seasonal_lags(dg.acf(daily(spark, sf_dir)), 7).select("series_id", "lag", r("acf", 8), r("ci_low", 8), r("ci_high", 8), "significant")


@query(f"WITH {D}, x AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY ts) AS x FROM d) SELECT series_id, round(corr(x, y), 8) + 0.0 AS corr FROM x GROUP BY series_id")
def lag1_corr(spark, sf_dir):
    return dg.lag_correlation(daily(spark, sf_dir)).select("series_id", r("corr", 8))


#: Levinson-Durbin on autocovariances adjusted for the overlap, a row for each order.
PACF = f"""RECURSIVE {D}, q AS (SELECT series_id, y - avg(y) OVER () AS e, row_number() OVER (ORDER BY ts) AS t, count(*) OVER () AS n FROM d),
l AS (SELECT unnest(generate_series(0, least(60, (SELECT max(n) // 2 FROM q)))) AS lag),
c AS (SELECT a.series_id, l.lag, any_value(a.n) AS n, sum(a.e * b.e) AS g FROM l JOIN q a ON true JOIN q b ON b.t = a.t + l.lag GROUP BY ALL),
v AS (SELECT series_id, any_value(n) AS n, list(g / (n - lag) ORDER BY lag) AS g FROM c GROUP BY series_id),
lev AS (SELECT series_id, n, g, 1 AS k, g[2] / g[1] AS a, [g[2] / g[1]] AS phi, g[1] * (1 - (g[2] / g[1]) ** 2) AS s FROM v
UNION ALL SELECT series_id, n, g, k + 1, b, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), s * (1 - b * b)
FROM (SELECT *, (g[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * g[k + 2 - j]))) / s AS b FROM lev WHERE k < len(g) - 1)),
pa AS (SELECT series_id, 0 AS lag, 1.0::DOUBLE AS pacf, n FROM v UNION ALL SELECT series_id, k, a, n FROM lev)"""


@query(f"WITH {PACF} SELECT series_id, lag::INT AS lag, round(pacf, 7) + 0.0 AS pacf, round(pacf - CASE WHEN lag > 0 THEN 1.959963984540054 / sqrt(n) ELSE 0 END, 7) + 0.0 AS pacf_lo, round(pacf + CASE WHEN lag > 0 THEN 1.959963984540054 / sqrt(n) ELSE 0 END, 7) + 0.0 AS pacf_hi FROM pa")
def pacf_values(spark, sf_dir):
    return dg.pacf(daily(spark, sf_dir)).select("series_id", "lag", r("pacf", 7), r("pacf_lo", 7), r("pacf_hi", 7))


@query(f"""WITH {PACF}, st AS (SELECT series_id, 'acf' AS kind, lag, g / (SELECT g FROM c WHERE lag = 0) AS value, n FROM c UNION ALL SELECT series_id, 'pacf', lag, pacf, n FROM pa)
SELECT series_id, kind, lag::INT AS lag, round(value, 7) + 0.0 AS value, round(-1.96 / sqrt(n), 7) + 0.0 AS band_lo, round(1.96 / sqrt(n), 7) + 0.0 AS band_hi FROM st WHERE lag > 0""")
def acf_pacf_stems(spark, sf_dir):
    return stems(dg.acf_pacf(daily(spark, sf_dir))).select("series_id", "kind", "lag", r("value", 7), r("band_lo", 7), r("band_hi", 7))


def _sweep(spark, sf_dir, by=None):
    made, _ = ViewBuilder().candidates(SeriesBundle(daily(spark, sf_dir, by)), TransformPlan(seasonal_period_m=7))
    return dg.stationarity_tests(stacked(made))


@query()
def stationarity_sweep(spark, sf_dir):
    policy = StationarityPolicy()
    return _sweep(spark, sf_dir).withColumn("pass_stationarity", selection.passes_column(policy)).withColumn("overdiff", selection.overdiff_column(policy))


@query()
def stationarity_selection(spark, sf_dir):
    """The choice for each order priority's series."""
    return selection.selected_by_series(_sweep(spark, sf_dir, "o_orderpriority"))


@query("""WITH t AS (SELECT s_suppkey::VARCHAR AS series_id, D_, d, (s_suppkey * 37 + D_ * 11 + d * 7) % 40 / 400.0 AS adf_pvalue, CASE WHEN (s_suppkey + d) % 11 > 0 THEN (s_suppkey * 13 + D_ * 5 + d * 3) % 30 / 200.0 END AS kpss_pvalue, 0.5 - (s_suppkey * 7 + D_ * 3 + d * 2) % 23 / 20.0 AS acf1
FROM supplier, (VALUES (0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2)) g(D_, d)),
k AS (SELECT *, coalesce(adf_pvalue <= 0.05 AND kpss_pvalue >= 0.05, false) AS passed, CASE WHEN acf1 <= -0.5 THEN 2 WHEN acf1 <= -0.3 THEN 1 ELSE 0 END AS severity FROM t),
o AS (SELECT *, bool_or(passed) OVER (PARTITION BY series_id) AS any_passed, row_number() OVER (PARTITION BY series_id ORDER BY CASE WHEN passed THEN 0 WHEN severity < 2 THEN 1 ELSE 2 END, severity, D_ + d, -D_, d) AS n FROM k)
SELECT series_id, D_, d, passed, ['none', 'soft', 'hard'][severity + 1] AS overdiff, any_passed FROM o WHERE n = 1""")
def selection_by_rules(spark, sf_dir):
    """The selector over a table of made-up test results, six candidates for each supplier."""
    grid = spark.createDataFrame(selection.GRID, "D_ int, d int")
    key, D_, d = F.col("s_suppkey"), F.col("D_"), F.col("d")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey").join(F.broadcast(grid), F.lit(True)).select(
        key.cast("string").alias("series_id"), "D_", "d", ((key * 37 + D_ * 11 + d * 7) % 40 / 400.0).alias("adf_pvalue"), F.when((key + d) % 11 > 0, (key * 13 + D_ * 5 + d * 3) % 30 / 200.0).alias("kpss_pvalue"), (0.5 - (key * 7 + D_ * 3 + d * 2) % 23 / 20.0).alias("acf1")
    )
    return selection.selected_by_series(rows, StationarityPolicy(alpha_adf=0.05, alpha_kpss=0.05, acf1_soft=-0.3, acf1_hard=-0.5))


LOGGED = f"{D}, b AS (SELECT series_id, ts, ln(y + 1) AS y FROM d), p AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS pos FROM b)"
VIEW_PLAN = with_changes(TransformPlan(), variance_transform="log", boxcox_offset=1.0, seasonal_period_m=7, D=1, d=1, detrend_for_periodogram="linear")


def view(spark, sf_dir, name: str) -> DataFrame:
    """What a step of the registry looks at under VIEW_PLAN, from the builder that keeps views."""
    state = PreModelState(SeriesBundle(daily(spark, sf_dir), "revenue", "D"), VIEW_PLAN, DiagnosticsPacket())
    spec = next(s.spec for s in PLAN_STEPS if s.spec.name == name)
    return ViewBuilder().get_view(state, spec).y.select("series_id", "ts", r("y", 6))


@query(f"WITH {D} SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM d")
def view_raw(spark, sf_dir):
    return view(spark, sf_dir, "raw_diagnostics")


@query(f"WITH {LOGGED} SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM b")
def view_var_stable(spark, sf_dir):
    return tr.TransformEngine().var_stable(SeriesBundle(daily(spark, sf_dir)), VIEW_PLAN).y.select("series_id", "ts", r("y", 6))


@query(f"WITH {LOGGED} SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM b")
def view_stl_interpretation(spark, sf_dir):
    return view(spark, sf_dir, "stl_interpretation")


@query(f"WITH {LOGGED}, f AS (SELECT regr_slope(y, pos) AS a, regr_intercept(y, pos) AS c FROM p) SELECT series_id, ts, round(y - (a * pos + c), 6) + 0.0 AS y FROM p, f")
def view_periodogram(spark, sf_dir):
    return view(spark, sf_dir, "periodogram")


@query(f"WITH {LOGGED}, s AS (SELECT series_id, ts, pos, y - lag(y, 7) OVER (ORDER BY pos) AS y FROM p), t AS (SELECT * FROM s WHERE y IS NOT NULL), u AS (SELECT series_id, ts, y - lag(y) OVER (ORDER BY pos) AS y FROM t) SELECT series_id, ts, round(y, 6) + 0.0 AS y FROM u WHERE y IS NOT NULL")
def view_final_stationary(spark, sf_dir):
    return view(spark, sf_dir, "acf_pacf_final")


@query(f"WITH {D} SELECT series_id, ts, round(y, 2) + 0.0 AS y FROM d")
def frame_time_series(spark, sf_dir):
    return frames.time_series(daily(spark, sf_dir)).select("series_id", "ts", r("y", 2))


@query(f"WITH {D}, {PLACED}, s AS (SELECT * FROM p WHERE pos < 200), m AS (SELECT unnest([7, 12]) AS m) SELECT series_id, m::INT AS m, ts, round(y, 2) + 0.0 AS y, round(avg(y) OVER (PARTITION BY m, pos % m), 6) + 0.0 AS proto FROM s, m")
def frame_period_resemblance(spark, sf_dir):
    return frames.period_resemblance(daily(spark, sf_dir), [7, 12, 30], max_candidates=2, use_first_n=200).select("series_id", "m", "ts", r("y", 2), r("proto", 6))


@query(f"WITH {D}, {PLACED} SELECT series_id, ts, pos::INT AS i, CASE WHEN count(y) OVER w >= 17 THEN round(avg(y) OVER w, 4) + 0.0 END AS rolling_mean FROM p WINDOW w AS (ORDER BY pos ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)")
def frame_rolling(spark, sf_dir):
    raw = {"rolling": dg.rolling(daily(spark, sf_dir), dg.rolling_window(1000))}
    return frames.rolling_mean_var(raw).select("series_id", "ts", F.col("i").cast("int").alias("i"), r("rolling_mean", 4))


@query("SELECT 'all' AS series_id, last_day(o_orderdate)::TIMESTAMP AS ts, round(sum(o_totalprice), 2) + 0.0 AS y FROM orders GROUP BY ALL")
def workbench_resample(spark, sf_dir):
    """The menu's resample twice over: days, then months of them; reset_series first undoes a coarser one."""
    bench = Workbench(sr.canonical(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "revenue")
    bench.resample("YE")
    bench.reset_series()
    bench.resample("D")
    return bench.resample("ME").select("series_id", "ts", r("y", 2))


@query()
def boxcox_lambda(spark, sf_dir):
    return dg.boxcox_mle(daily(spark, sf_dir))


@query()
def stl_components(spark, sf_dir):
    return dg.stl(daily(spark, sf_dir), 7)


@query(f"WITH {D}, {PLACED} SELECT series_id, ts, round(y, 2) + 0.0 AS y, 7 AS m, round(avg(y) OVER (PARTITION BY pos % 7), 2) + 0.0 AS proto FROM p")
def seasonal_prototype(spark, sf_dir):
    return dg.seasonal_prototype(daily(spark, sf_dir), 7).select("series_id", "ts", r("y", 2), "m", r("proto", 2))


@query(f"""WITH {D}, {PLACED}, {POINTS}, f AS (SELECT series_id, regr_slope(ln(var), ln(mean)) AS slope, regr_r2(ln(var), ln(mean)) AS r2 FROM pts GROUP BY series_id),
s AS (SELECT series_id, isodow(ts) AS g, stddev_samp(y) / avg(y) AS cv FROM d GROUP BY ALL), v AS (SELECT series_id, stddev_pop(cv) AS cv_std FROM s GROUP BY series_id)
SELECT series_id, round(slope, 6) + 0.0 AS slope_loglog, round(r2, 6) + 0.0 AS r2_loglog, round(cv_std, 9) + 0.0 AS cv_std, slope > 0.7 AND r2 > 0.4 AS variance_scales_with_level, slope > 0.7 AND r2 > 0.4 AND cv_std < 0.25 AS likely_multiplicative,
(slope > 0.7 AND r2 > 0.4) OR cv_std < 0.25 AS needs_stabilization, CASE WHEN (slope > 0.7 AND r2 > 0.4) OR cv_std < 0.25 THEN 'log' ELSE 'none' END AS suggested_transform FROM f JOIN v USING (series_id)""")
def variance_flags(spark, sf_dir):
    engine, bundle = dg.DiagnosticsEngine(), SeriesBundle(daily(spark, sf_dir), freq="D")
    view = tr.TransformEngine().raw(bundle)
    return engine.variance(view, engine.raw(view, "D")["flags"]).select("series_id", r("slope_loglog", 6), r("r2_loglog", 6), r("cv_std", 9), "variance_scales_with_level", "likely_multiplicative", "needs_stabilization", "suggested_transform")


@query("SELECT * FROM (VALUES ('orders', 'o_orderdate', 'o_custkey', 'o_orderkey,o_totalprice'), ('events', 'ts', 'value', '')) t(name, date_col, target_col, kept)")
def schema_roles(spark, sf_dir):
    """The roles of two tables; of the exogenous columns those are listed that the detector keeps for orders."""
    rows = []
    for name in ("orders", "events"):
        found = roles.SchemaDetector(table(spark, sf_dir, name)).detect()
        rows.append((name, found.date_col, found.target_col, ",".join(found.exog_cols)))
    return spark.createDataFrame(rows, "name string, date_col string, target_col string, kept string")


@query("""WITH v AS (SELECT 'o_orderkey' AS name, o_orderkey AS o, o_orderkey AS v FROM orders UNION ALL SELECT 'o_custkey', o_orderkey, o_custkey FROM orders),
g AS (SELECT *, v - lag(v) OVER (PARTITION BY name ORDER BY o) AS gap FROM v), c AS (SELECT name, gap, count(*) AS c FROM g WHERE gap IS NOT NULL GROUP BY ALL),
t AS (SELECT name, sum(CASE WHEN gap < 0 THEN c ELSE 0 END)::BIGINT AS falls, max(c) / sum(c) AS top_share FROM c GROUP BY name)
SELECT name, count(*) AS n, count(*) FILTER (v IS NULL) AS nulls, count(DISTINCT v) AS "distinct", any_value(falls) AS falls, round(any_value(top_share), 9) + 0.0 AS top_share FROM v JOIN t USING (name) GROUP BY name""")
def id_like_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("__rid", F.col("o_orderkey"))
    return roles.id_like_facts(orders, ["o_orderkey", "o_custkey"], "__rid").select("name", "n", "nulls", "distinct", "falls", r("top_share", 9))


@query("""WITH f AS (SELECT 'p_size' AS name, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part)
SELECT name, round(count(v) / count(*), 9) + 0.0 AS completeness, round(var_samp(v), 4) + 0.0 AS variance, round(count(v) / count(*) * var_samp(v), 4) + 0.0 AS score FROM f GROUP BY name""")
def variance_completeness(spark, sf_dir):
    return roles.variance_completeness(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).select("name", r("completeness", 9), r("variance", 4), r("score", 4))


@query("SELECT count(DISTINCT l_quantity) AS l_quantity, count(DISTINCT l_discount) AS l_discount, count(DISTINCT l_tax) AS l_tax, count(DISTINCT l_linenumber) AS l_linenumber FROM lineitem")
def exog_nunique(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(*[F.count_distinct(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")])


@query("""WITH o AS (SELECT o_orderdate AS ts, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS b FROM orders)
SELECT count(*) AS rows, 0::BIGINT AS unparseable, count(ts) - count(DISTINCT ts) AS duplicates, count(*) FILTER (ts IS NULL OR ts < b) AS falls FROM o""")
def date_quality(spark, sf_dir):
    return roles.date_quality(table(spark, sf_dir, "orders"), "o_orderdate", order="o_orderkey")


@query(f"WITH {GRID} SELECT min(ts) AS start, max(ts) AS \"end\", count(*) AS n_obs, count(*) FILTER (y IS NULL) AS n_missing_dates, (SELECT count(*) > count(DISTINCT date_trunc('day', o_orderdate)) FROM orders) AS has_duplicates, (SELECT CASE WHEN count(DISTINCT ts) FILTER (y IS NOT NULL) >= 0.95 * count(*) THEN 'D' END FROM g) AS freq FROM g")
def cleaned_daily(spark, sf_dir):
    """Orders by day through the whole cleaner: duplicates summed, gaps found and filled."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("sales"))
    schema = roles.SchemaDetector(df).detect()
    _, meta = TimeSeriesCleaner(df, schema, missing="reindex", freq="D").clean()
    return spark.createDataFrame([(meta.start, meta.end, meta.n_obs, meta.n_missing_dates, meta.has_duplicates, meta.freq)], "start timestamp_ntz, end timestamp_ntz, n_obs long, n_missing_dates long, has_duplicates boolean, freq string")


def nation_csv(spark, sf_dir) -> bytes:
    """A small table as the bytes of a CSV file."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return ("n_nationkey;n_name;n_regionkey\n" + "\n".join(f"{r.n_nationkey};{r.n_name};{r.n_regionkey}" for r in rows) + "\n").encode()


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def ingest_csv_roundtrip(spark, sf_dir):
    return DataIngestor(spark, nation_csv(spark, sf_dir), file_type="csv").load().drop("__rid")


@query("SELECT count(*) AS n_rows, 3 AS n_cols, 'csv' AS file_type, ';' AS delimiter FROM nation")
def ingest_metadata(spark, sf_dir):
    m = DataIngestor(spark, nation_csv(spark, sf_dir), filename="nation.csv").get_metadata()
    return spark.createDataFrame([(m.n_rows, m.n_cols, m.file_type, m.delimiter)], "n_rows long, n_cols int, file_type string, delimiter string")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ' – 5 €' AS n_name FROM nation")
def ingest_windows_1252(spark, sf_dir):
    """The encoding is found out; the signs are those that Latin-1 lacks."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    data = "n_nationkey;n_name\n" + "".join(f"{r.n_nationkey};{r.n_name} – 5 €\n" for r in rows)
    return DataIngestor(spark, data.encode("cp1252"), file_type="csv").load().drop("__rid")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || chr(10) || 'next line' AS n_name FROM nation WHERE n_nationkey < 12")
def ingest_first_rows(spark, sf_dir):
    """Quoted line ends, and types by the first rows alone: the last row's key is no number."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    data = "n_nationkey,n_name\n" + "".join(f'{r.n_nationkey},"{r.n_name}\nnext line"\n' for r in rows) + "last,one\n"
    return DataIngestor(spark, data.encode(), file_type="csv", max_rows=12).load().drop("__rid")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_nationkey < 5")
def ingest_preview(spark, sf_dir):
    return DataIngestor(spark, nation_csv(spark, sf_dir), file_type="csv", max_rows=20).preview(5)


@query()
def pipeline_summary(spark, sf_dir):
    """What a whole pre-modelling run of daily revenue decides."""
    engine = PreModelOrchestrator()
    state = engine.run(SeriesBundle(daily(spark, sf_dir), "revenue", "D"))
    engine.release(state)
    p, d = state.plan, state.diagnostics
    row = (p.variance_transform, p.boxcox_offset, p.seasonal_period_m, p.d, p.D, d.stationarity_selection["reason"], len(d.stationarity_table), d.acf_pacf.get("nlags"))
    return spark.createDataFrame([row], "variance_transform string, boxcox_offset double, m int, d int, D_ int, reason string, n_candidates int, nlags int")


@query()
def locked_pipeline(spark, sf_dir):
    """A run under locks: log, m = 7 and one seasonal difference as the plan says."""
    plan = with_changes(TransformPlan(), variance_transform="log", seasonal_period_m=7, D=1)
    engine = PreModelOrchestrator()
    state = engine.run(SeriesBundle(daily(spark, sf_dir), "revenue", "D"), plan, True, True, True)
    engine.release(state)
    rows = [(r["D"], r["d"], r["m"], r["n"], r.get("adf_pvalue"), r.get("kpss_pvalue"), r.get("acf1"), r["pass_stationarity"]) for r in state.diagnostics.stationarity_table]
    return spark.createDataFrame(rows, "D_ int, d int, m int, n int, adf_pvalue double, kpss_pvalue double, acf1 double, pass_stationarity boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue on the whole calendar with its rolling mean and variance, and whether the day was missing."""
    y = regridded(spark, sf_dir)
    return dg.rolling(y, dg.rolling_window(1000)).join(y.select("series_id", "ts", "y", F.col("y").isNull().alias("is_missing")), ["series_id", "ts"])
