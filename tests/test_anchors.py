"""Figures of the test tables that were worked out independently beforehand."""

import pytest

from tsprep.model import SeriesBundle, TransformPlan
from tsprep.operators import diagnostics as dg
from tsprep.operators import transforms as tr
from tsprep.plans import catalogue

ANCHORS = [
    ("sf0.001", "daily", "D", 1094, 2.070379, 0.513834, 0.025368, 0.957479, 1.397144, 4, -0.030764, [3, 4, 13, 2, 22], 22),
    ("sf0.001", "hourly", "h", 531, 1.405621, 0.551572, 0.089761, 1.255834, 1.869602, 3, -0.027418, [4, 5, 3, 2, 20], 4),
    ("sf0.001", "monthly", "MS", 80, 0.287583, 0.001475, 0.098911, 0.132904, 1.540506, 1, -0.126545, [16, 3, 2, 27, 4], 3),
    ("sf0.01", "daily", "D", 2399, 1.139868, 0.124041, 0.013756, 0.478403, 0.055395, 0, -0.014640, [2, 3, 4, 14, 6], 6),
    ("sf0.01", "hourly", "h", 720, 0.024166, 0.000038, 0.046910, 0.551634, 0.320001, 0, 0.078745, [5, 9, 13, 4, 3], 9),
    ("sf0.01", "monthly", "MS", 80, -11.961076, 0.561702, 0.101303, -3.955844, 25.220423, 1, -0.145033, [2, 4, 3, 6, 13], 6),
]


@pytest.mark.parametrize("anchor", ANCHORS, ids=lambda a: f"{a[0]}-{a[1]}")
def test_anchor(spark, anchor):
    sf, name, freq, n, slope, r2, cv, skew, kurt, outliers, lag1, periods, chosen = anchor
    y = getattr(catalogue, name)(spark, f"/root/testdata/{sf}").persist()
    assert y.count() == n
    fit = dg.loglog_fit(dg.window_mean_variance(y)).first()
    assert (round(fit.slope_loglog, 6), round(fit.r2_loglog, 6)) == (slope, r2)
    assert round(dg.cv_std(dg.cv_by_season(y, freq)).first().cv_std, 6) == cv
    shape = dg.distribution(y).first()
    assert (round(shape.skew, 6), round(shape.kurtosis, 6)) == (skew, kurt)
    assert dg.mad_outliers(y).count() == outliers and round(dg.lag_correlation(y).first()["corr"], 6) == lag1
    view = tr.TransformEngine().for_periodogram(SeriesBundle(y), TransformPlan(variance_transform="log"))
    found = dg.period_candidates(view.y)
    assert [r.m for r in found.orderBy("rank").collect()] == periods and dg.chosen_period(found).first().chosen_m == chosen
