import io
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tsprep.functions import kernels
from tsprep.model import DiagnosticsPacket, PreModelState, SeriesBundle, StationarityPolicy, TransformedSeries, TransformPlan
from tsprep.operators import diagnostics as dg
from tsprep.operators import selection, series
from tsprep.plans.frames import PreModelViewer
from tsprep.plans.pipeline import STEPS, PreModelOrchestrator, ViewBuilder
from tsprep.plans.workbench import Workbench, run_manual_pre_model
from tsprep.plans.report import DiagnosticsReporter
from tsprep.sources import encodings
from tsprep.sources import ingest as ingest_module
from tsprep.sources.ingest import DataIngestor, mangled
from tsprep.streaming.resample import stream_resample


def wave(n, period=7, trend=0.7, noise=1.0, seed=7):
    rng = np.random.default_rng(seed)
    return 50 + trend * np.arange(n) + 10 * np.sin(2 * np.pi * np.arange(n) / period) + noise * rng.normal(size=n)


def test_adf_and_kpss_known_values():
    for tau, p in ((-3.43, 0.0100), (-2.86, 0.0502), (-2.57, 0.0994), (-1.61, 0.4780), (3.0, 1.0), (-20.0, 0.0)):
        assert math.isclose(kernels.adf_p(tau), p, abs_tol=2e-4)
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    assert kernels.adf(noise) < 0.01 and kernels.kpss(noise) > 0.05
    assert kernels.adf(walk) > 0.05 and kernels.kpss(walk) == 0.01
    assert kernels.adf(np.ones(50)) is None and kernels.kpss(np.ones(50)) is None


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(14, 80))
def test_acf_and_pacf(seed, n):
    y = np.random.default_rng(seed).normal(size=n)
    r, p = kernels.acf(y, 5), kernels.pacf(y, 5)
    e = y - y.mean()
    assert np.isclose(r[0], 1) and np.isclose(p[0], 1)
    assert np.isclose(p[1], (e[1:] @ e[:-1] / (n - 1)) / (e @ e / n))
    g = [e[k:] @ e[: n - k] / (n - k) for k in range(4)]
    phi = np.linalg.solve(np.array([[g[abs(i - j)] for j in range(3)] for i in range(3)]), np.array(g[1:4]))
    assert np.isclose(p[3], phi[-1])


def test_stl_adds_up_and_finds_the_season():
    y = wave(210, noise=0.2)
    trend, season, rest = kernels.stl(y, 7)
    assert np.allclose(trend + season + rest, y)
    assert np.corrcoef(season, np.sin(2 * np.pi * np.arange(210) / 7))[0, 1] > 0.99
    assert np.abs(np.diff(trend)[20:-20] - 0.7).max() < 0.3
    with pytest.raises(ValueError):
        kernels.stl(y[:10], 7)


def test_boxcox():
    rng = np.random.default_rng(2)
    lam, llf = kernels.boxcox_mle(np.exp(rng.normal(size=4000)), 0.0)
    assert abs(lam) < 0.05 and llf >= kernels.boxcox_llf(np.exp(rng.normal(size=10)), 0.3) - 1e9
    assert kernels.boxcox_mle(np.ones(30), 0.0) == (None, None) and kernels.boxcox_mle(np.arange(1.0, 15), 0.0) == (None, None)


def test_spectrum():
    y = wave(137, trend=0)
    freq, power = kernels.periodogram(y)
    e = y - y.mean()
    want = [2 * abs((e * np.exp(-2j * np.pi * k * np.arange(137) / 137)).sum()) ** 2 / 137 for k in range(1, 69)]
    assert np.allclose(power, want)
    assert kernels.peaks(np.array([0, 2, 2, 2, 1, 3, 1.0])).tolist() == [2, 5]
    assert kernels.peaks(np.array([3.0, 2, 1])).tolist() == []
    assert kernels.period_candidates(y)[0][0] == 7 and kernels.period_candidates(y[:15]) == []


def test_frames_of_kernels(spark):
    s = series.from_values(spark, wave(137).tolist())
    got = dg.acf(s).orderBy("lag").toPandas()
    v = wave(137)
    r = kernels.acf(v, 60)
    assert np.allclose(got.acf, r) and np.allclose(got.acf_hi - got.acf, kernels.Z975 * kernels.acf_error(r, 137))
    assert dg.acf_pacf(s).count() == 61 and dg.acf(series.from_values(spark, [1.0] * 5)).count() == 0
    assert dg.stl(s, 7).count() == 137 and dg.stl(s, 100).count() == 0
    lags = dg.seasonal_lags(dg.acf(s), 7).orderBy("lag").collect()
    assert [x.lag for x in lags] == [7, 14, 21] and lags[0].significant
    assert np.isclose(dg.boxcox_grid(s, [0.0]).first().llf, kernels.boxcox_llf(v, 0.0))


def candidate(d, D, m=7):
    return TransformedSeries(None, None, TransformPlan(d=d, D=D, seasonal_period_m=m), [])


def test_selection_rules(spark):
    row = lambda d, D, a, k, r: {"d": d, "D": D, "m": 7, "adf_pvalue": a, "kpss_pvalue": k, "acf1": r}
    pool = [candidate(0, 0), candidate(1, 0), candidate(0, 1)]
    rows = [row(0, 0, 0.5, 0.01, 0.9), row(1, 0, 0.01, 0.1, -0.4), row(0, 1, 0.01, 0.1, 0.0)]
    best, meta = selection.select_stationary_candidate(pool, rows)
    assert (best.plan.d, best.plan.D) == (0, 1) and meta["passed"] and meta["any_passed"]
    best, meta = selection.select_stationary_candidate(pool, [row(0, 0, None, None, -0.9), row(1, 0, 0.5, 0.1, -0.4), row(0, 1, 0.5, 0.1, None)])
    assert (best.plan.d, best.plan.D) == (0, 1) and not meta["any_passed"]
    assert selection.select_stationary_candidate([candidate(2, 0)], rows, StationarityPolicy(max_d=1))[0] is None
    table = spark.createDataFrame([("a", r["D"], r["d"], r["adf_pvalue"], r["kpss_pvalue"], r["acf1"]) for r in rows], "series_id string, D_ int, d int, adf_pvalue double, kpss_pvalue double, acf1 double")
    found = selection.selected_by_series(table).first()
    assert (found.D_, found.d, found.passed) == (1, 0, True)
    # What rows say of themselves comes before their tests, and a candidate without a row is one that fails.
    flagged = [row(0, 0, 0.01, 0.1, 0.9) | {"overdiff_flag": "hard"}, row(0, 1, 0.01, 0.1, 0.0)]
    assert selection.select_stationary_candidate(pool, flagged)[0].plan.D == 1
    stated = [row(0, 0, 0.01, 0.1, 0.0) | {"pass_stationarity": False}, row(1, 0, 0.9, 0.01, 0.0) | {"pass_stationarity": True}, row(0, 1, 0.01, 0.1, 0.0) | {"pass_stationarity": False}]
    assert selection.select_stationary_candidate(pool, stated)[0].plan.d == 1
    best, meta = selection.select_stationary_candidate(pool, [row(1, 0, 0.9, 0.01, 0.0)])
    assert (best.plan.d, best.plan.D, meta["passed"], meta["any_candidates"]) == (0, 0, False, True)
    table = spark.createDataFrame([("a", 0, 0, 0.01, 0.1, 0.9, "hard", True), ("a", 1, 0, 0.9, 0.01, 0.0, None, True), ("a", 0, 1, 0.01, 0.1, 0.0, "none", False)], "series_id string, D_ int, d int, adf_pvalue double, kpss_pvalue double, acf1 double, overdiff_flag string, pass_stationarity boolean")
    assert selection.selected_by_series(table).select("D_", "d", "passed", "any_passed").first() == (1, 0, True, True)
    assert selection.candidate_grid(None, 2, 1) == [(0, 0), (0, 1), (0, 2)] and len(selection.candidate_grid(7, 2, 1)) == 6


def test_plans_and_views(spark):
    with pytest.raises(NotImplementedError):
        TransformPlan(variance_transform="boxcox", boxcox_lambda=0.5).checked()
    for bad in (TransformPlan(variance_transform="boxcox"), TransformPlan(variance_transform="x"), TransformPlan(D=1), TransformPlan(detrend_for_periodogram="x")):
        with pytest.raises(ValueError):
            bad.checked()
    views, specs = ViewBuilder(), {s.name: s.spec for s in STEPS}
    a, b = TransformPlan(), TransformPlan(max_d=1)
    assert views.view_id(a, specs["periodogram"]) == views.view_id(b, specs["periodogram"])
    assert views.view_id(a, specs["periodogram"]) != views.view_id(TransformPlan(detrend_for_periodogram="none"), specs["periodogram"])


def test_orchestrator(spark):
    state = PreModelOrchestrator().run(SeriesBundle(series.from_values(spark, wave(137).tolist()), "y", "D"))
    assert state.plan.variance_transform == "log" and state.diagnostics.period_candidates["chosen_m"] == 7 and state.plan.seasonal_period_m == 7
    assert len(state.diagnostics.stationarity_table) == 6 and state.final is not None and state.diagnostics.stl.count() == 137
    frames = PreModelViewer(use_first_n=30).render_from_state(state)
    assert frames["period_resemblance"].where("m = 7").count() == 30 and frames["acf_pacf"].count() > 0 and len(frames["chosen_stationarity"]) == 1
    with pytest.raises(ValueError):
        PreModelViewer().render_from_report({})
    locked = PreModelOrchestrator().run(state.bundle, TransformPlan(seasonal_period_m=7, d=1), True, True, True, compat_stl_view=True)
    assert (locked.plan.d, locked.plan.D, locked.plan.variance_transform) == (1, 0, "none") and locked.diagnostics.stl.count() == 136


def test_report(tmp_path):
    """A page from a state alone: signs are escaped, long tables are cut and say so."""
    state = PreModelState(SeriesBundle(None, "a<b"), TransformPlan(seasonal_period_m=7), DiagnosticsPacket())
    d = state.diagnostics
    d.notes.append("x & y")
    d.stationarity_table += [{"D": 0, "d": k, "m": 7, "n": 90, "adf_pvalue": 0.0123456789, "kpss_pvalue": None, "acf1": -0.1, "pass_stationarity": False} for k in range(15)]
    page = DiagnosticsReporter(state, max_rows=12).save(tmp_path / "artifacts" / "a.html").read_text()
    assert "<h1>a&lt;b: diagnostics</h1>" in page and "x &amp; y" in page and "0.0123457" in page and page.count("<tr><td>0</td>") == 12 and "3 more rows" in page and "seasonal_period_m</td><td>7" in page
    assert "<p>nothing</p>" in page


def test_short_series(spark):
    for values in ([1.0, 2.0], [None, None, 1.0], [5.0] * 13):
        plan = TransformPlan(detrend_for_periodogram="none")
        state = PreModelOrchestrator().run(SeriesBundle(series.from_values(spark, values)), plan)
        assert state.diagnostics.period_candidates["chosen_m"] is None


def csv_text(n=30, sep=","):
    y = wave(n)
    return "\n".join([sep.join(["date", "sales", "temp"]), *(sep.join([f"2021-01-{k + 1:02d}", f"{y[k]:.3f}", str(k % 5)]) for k in range(n))]) + "\n"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_from_bytes_and_streams(spark, sep):
    for source in (csv_text(sep=sep).encode(), io.BytesIO(csv_text(sep=sep).encode())):
        ingest = DataIngestor(spark, source, file_type="csv")
        meta = ingest.get_metadata()
        assert (meta.delimiter, meta.n_rows, meta.column_names) == (sep, 30, ["date", "sales", "temp"])
        assert meta.dtypes == {"date": "string", "sales": "double", "temp": "bigint"}
        assert ingest.validate() == ingest.validate()


def test_csv_from_a_path(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("d;é;n\n2021-01-01;NA;1\n2021-01-02;2,5;2\nx;y;3;9\n2021-01-03\n".encode("latin-1"))
    ingest = DataIngestor(spark, str(path), delimiter=";")
    rows = ingest.load().orderBy("__rid").drop("__rid").collect()
    assert ingest.encoding == "latin-1" and [tuple(r) for r in rows] == [("2021-01-01", None, 1.0), ("2021-01-02", "2,5", 2.0), ("2021-01-03", None, None)]
    assert any("too many fields" in w for w in ingest.warnings) and any("Fewer than 10" in w for w in ingest.warnings)
    assert DataIngestor(spark, str(path), delimiter=";", max_rows=1).load().count() == 1


def test_encodings_are_told_apart():
    french = "prix;café\n1;déjà vu, garçon\n"
    russian = "дата;продажи\n2021;Это простой текст о продажах\n"
    cases = {
        "utf-8": french.encode(), "utf-16": french.encode("utf-16"), "utf-16-le": french.encode("utf-16-le"), "utf-16-be": french.encode("utf-16-be"), "utf-32": french.encode("utf-32"),
        "latin-1": french.encode("latin-1"), "cp1252": (french + "2;price €0 – “so”\n").encode("cp1252"), "cp1251": russian.encode("cp1251"), "koi8-r": russian.encode("koi8-r"),
        "shift_jis": "日付;売り上げ\n1;これはとても短いテキストです\n".encode("shift_jis"), "euc_kr": "날짜;매출\n1;이것은 짧은 글입니다\n".encode("euc_kr"), "gb18030": "日期;销售额\n一;这是一个很短的文本\n".encode("gb18030"),
    }
    assert {name: encodings.detect(data)[0] for name, data in cases.items()} == {name: name for name in cases}
    assert encodings.detect(b"\xef\xbb\xbfa,b\n")[0] == "utf-8" and encodings.detect("é".encode()[:1] * 0 + "aé".encode()[:2])[0] == "utf-8"
    assert encodings.detect(b"")[1] and encodings.detect(b"a,b\n")[0] == "utf-8"


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "cp1252", "cp1251", "shift_jis", "utf-16"])
def test_path_and_bytes_agree(spark, tmp_path, encoding):
    words = {"cp1251": "цена", "shift_jis": "これは値段", "latin-1": "été", "cp1252": "€0 – “x”"}.get(encoding, "ß€漢")
    data = (f"d,{words},n\n" + "".join(f"2021-01-{k:02d},{words} {k},{k}\n" for k in range(1, 15))).encode(encoding)
    (tmp_path / "x.csv").write_bytes(data)
    path, whole = (DataIngestor(spark, source, file_type="csv", encoding=encoding) for source in (str(tmp_path / "x.csv"), data))
    assert path.load().columns == whole.load().columns == ["d", words, "n", "__rid"]
    rows = [[tuple(r) for r in x.load().orderBy("__rid").drop("__rid").collect()] for x in (path, whole)]
    assert rows[0] == rows[1] and rows[0][0] == ("2021-01-01", f"{words} 1", 1)


def test_what_lies_past_the_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest_module, "ENCODING_SAMPLE", 4096)
    lines = [f"{k},text {k}" for k in range(2000)]
    late = tmp_path / "late.csv"
    late.write_bytes(("n,t\n" + "\n".join(lines) + "\n2000,caf").encode() + b"\xe9\n")
    ingest = DataIngestor(spark, str(late))
    assert ingest.load().where("n = 2000").first().t == "café" and ingest.encoding == "latin-1" and any("fallback" in w for w in ingest.warnings)
    torn = tmp_path / "torn.csv"
    torn.write_text("n,t\n" + "\n".join(lines) + '\n2000,"two\nlines"\n')
    ingest = DataIngestor(spark, str(torn))
    assert ingest.load().count() == 2001 and ingest.load().where("n = 2000").first().t == "two\nlines" and ingest.encoding == "utf-8"
    few = DataIngestor(spark, str(late), max_rows=12)
    assert few.load().count() == 12 and few.encoding == "utf-8" and [r.n for r in few.preview(2).collect()] == [0, 1]
    mixed = tmp_path / "mixed.csv"
    mixed.write_text("n,t\n" + "\n".join(lines) + "\nx,y\n")
    assert dict(DataIngestor(spark, str(mixed), max_rows=50).load().dtypes)["n"] == "bigint" and dict(DataIngestor(spark, str(mixed)).load().dtypes)["n"] == "string"


def test_ingest_errors(spark, tmp_path):
    for source, options in ((b"a,b\n", {"file_type": "csv"}), (b"x", {}), ("a.txt", {}), (b"x", {"file_type": "json"})):
        with pytest.raises(ValueError):
            DataIngestor(spark, source, **options).load()
    assert mangled(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    twice = DataIngestor(spark, b"a,a\n1,2\n", file_type="csv")
    assert twice.load().columns == ["a", "a.1", "__rid"] and any("more than once" in w for w in twice.warnings)


def workbook(rows):
    cells = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{n}"><v>{v}</v></c>' for k, v in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def test_excel(spark):
    df = DataIngestor(spark, workbook([["date", "v"], ["2021-01-01", 1.5], ["2021-01-02", 2]]), filename="a.xlsx").load()
    assert [tuple(r) for r in df.orderBy("__rid").drop("__rid").collect()] == [("2021-01-01", 1.5), ("2021-01-02", 2.0)]
    with pytest.raises(ValueError, match="xls"):
        DataIngestor(spark, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1xxxx", file_type="excel").load()


def test_workbench(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(csv_text())
    bench = Workbench.from_csv(spark, str(path), "sales")
    assert bench.freq == "D" and bench.time_plot().count() == 30
    bench.set_m(7)
    bench.save()
    bench.set_diffs(1, 0)
    bench.revert()
    assert (bench.plan.seasonal_period_m, bench.plan.d) == (7, 0)
    bench.resample("W")
    assert bench.y.count() == 5
    bench.reset_series()
    bench.reset()
    assert bench.y.count() == 30 and bench.plan == TransformPlan() and bench.toggle_lock("m") is False
    answers, said = iter(["0", "5", "7", "7", "1", "x", "6", "nope", "0", "99", "q"]), []
    plan = run_manual_pre_model(spark, str(path), "sales", ask=lambda _: next(answers), tell=said.append)
    assert (plan.seasonal_period_m, plan.d, plan.D) == (7, 1, 0) and any("failed" in s for s in said) and "no such choice" in said


def test_stream_resample(spark, tmp_path):
    t = pd.date_range("2024-01-01", periods=48, freq="30min")
    spark.createDataFrame(pd.DataFrame({"ts": t, "v": 1.0})).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, v double").parquet(str(tmp_path / "in"))
    run = stream_resample(events, "ts", "v", "1 hour", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) >= 22 and (got.y == 2.0).all()
