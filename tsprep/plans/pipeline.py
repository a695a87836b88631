"""The pre-modelling run: views with a memo, the ordered steps, and the orchestrator that ties them together."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import functions as F

from ..model import DiagnosticSpec, DiagnosticsPacket, PreModelState, SeriesBundle, SeriesView, StationarityPolicy, Step, TransformedSeries, TransformPlan, with_changes
from ..operators.diagnostics import DiagnosticsEngine, chosen_period, seasonal_lags
from ..operators.selection import candidate_grid, passes, select_stationary_candidate
from ..operators.transforms import TransformEngine

VIEW_TYPES = ("raw", "var_stable", "for_periodogram", "stationary_candidate", "final_stationary", "stl_interpretation")
STEPS = (
    Step("raw_diagnostics", DiagnosticSpec("raw_diagnostics", "raw", artifact_key="raw")),
    Step("variance_assessment", DiagnosticSpec("variance_assessment", "raw", artifact_key="variance")),
    Step("periodogram", DiagnosticSpec("periodogram", "for_periodogram", needs_variance=True, artifact_key="period_candidates")),
    Step("stationarity_sweep", DiagnosticSpec("stationarity_sweep", "stationary_candidate", needs_variance=True, needs_m=True, artifact_key="stationarity_table")),
    Step("acf_pacf_final", DiagnosticSpec("acf_pacf_final", "final_stationary", needs_variance=True, needs_m=True, needs_diffs=True, artifact_key="acf_pacf")),
    Step("stl_interpretation", DiagnosticSpec("stl_interpretation", "stl_interpretation", needs_variance=True, needs_m=True, artifact_key="stl")),
)
#: What of a plan a view depends on; edits of anything else leave the memo as it is.
RELEVANT = {
    "raw": (),
    "var_stable": ("variance_transform", "boxcox_lambda", "boxcox_offset"),
    "stl_interpretation": ("variance_transform", "boxcox_lambda", "boxcox_offset"),
    "for_periodogram": ("variance_transform", "boxcox_lambda", "boxcox_offset", "detrend_for_periodogram"),
    "stationary_candidate": ("variance_transform", "boxcox_lambda", "boxcox_offset", "seasonal_period_m", "d", "D"),
    "final_stationary": ("variance_transform", "boxcox_lambda", "boxcox_offset", "seasonal_period_m", "d", "D"),
}


def stable_hash(value: dict) -> str:
    return hashlib.md5(json.dumps(value, sort_keys=True, default=str).encode(), usedforsecurity=False).hexdigest()[:10]


class ViewBuilder:
    def __init__(self, transforms: TransformEngine | None = None):
        self.transforms = transforms or TransformEngine()

    def view_id(self, plan: TransformPlan, spec: DiagnosticSpec) -> str:
        if spec.view_type not in VIEW_TYPES:
            raise ValueError(f"unknown view type: {spec.view_type}")
        kind = "stationary" if spec.view_type in ("stationary_candidate", "final_stationary") else spec.view_type
        return f"{kind}:{stable_hash({k: v for k, v in asdict(plan).items() if k in RELEVANT[spec.view_type]})}"

    def get_view(self, state: PreModelState, spec: DiagnosticSpec) -> SeriesView:
        """The view that a step looks at; made once for what it depends on and kept in memory as far as there is room."""
        key = self.view_id(state.plan, spec)
        if key not in state.views:
            t, b, p = self.transforms, state.bundle, state.plan
            if spec.view_type in ("stationary_candidate", "final_stationary"):
                made = t.stationary(b, p)
                view = SeriesView(key, made.y, made.exog, made.applied_steps)
            else:
                view = {"raw": lambda: t.raw(b), "var_stable": lambda: t.var_stable(b, p), "for_periodogram": lambda: t.for_periodogram(b, p), "stl_interpretation": lambda: t.stl_interpretation(b, p)}[spec.view_type]()
            state.views[key] = SeriesView(key, view.y.persist(), view.exog, view.applied_steps)
        return state.views[key]

    def candidates(self, bundle: SeriesBundle, plan: TransformPlan) -> tuple[list[TransformedSeries], list[str]]:
        """The sweep's candidates within the plan's limits; what can't be made becomes a note."""
        made, notes = [], []
        for D, d in candidate_grid(plan.seasonal_period_m, plan.max_d, plan.max_D):
            try:
                made.append(self.transforms.stationary(bundle, with_changes(plan, D=D, d=d)))
            except (ValueError, NotImplementedError) as failed:
                notes.append(f"candidate D={D}, d={d} failed: {failed}")
        return made, notes


def stacked(candidates: list[TransformedSeries]):
    """Candidates one below the other, so that their tests run side by side."""
    frames = [c.y.select("series_id", "ts", "y", F.lit(c.plan.D).alias("D_"), F.lit(c.plan.d).alias("d")) for c in candidates]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


class PreModelOrchestrator:
    """Runs the steps for a bundle of one series; locks keep what the caller's plan says of m, variance or differences."""

    def __init__(self, diagnostics: DiagnosticsEngine | None = None, transforms: TransformEngine | None = None):
        self.diagnostics = diagnostics or DiagnosticsEngine()
        self.views = ViewBuilder(transforms)

    def release(self, state: PreModelState) -> None:
        """Gives back the memory of the views that a run has kept; they are made again where they are looked at."""
        for view in state.views.values():
            view.y.unpersist()
        self.views.transforms.release()

    def run(self, bundle: SeriesBundle, manual_plan: TransformPlan | None = None, lock_m: bool = False, lock_variance: bool = False, lock_diffs: bool = False, compat_stl_view: bool = False) -> PreModelState:
        """compat_stl_view decomposes the differenced series instead of the one that can be interpreted."""
        plan = manual_plan or TransformPlan()
        if lock_variance:
            plan.checked()
        state = PreModelState(bundle, plan, DiagnosticsPacket())
        out, spec = state.diagnostics, {s.name: s.spec for s in STEPS}
        view = self.views.get_view(state, spec["raw_diagnostics"])
        out.raw = self.diagnostics.raw(view, bundle.freq)

        out.variance = self.diagnostics.variance(view, out.raw["flags"]).first()
        out.variance = out.variance.asDict() if out.variance else {}
        if not lock_variance:
            if out.variance.get("suggested_transform") == "log":
                state.plan = with_changes(state.plan, variance_transform="log", boxcox_offset=out.variance["recommended_offset"])
                out.notes.append("variance: log suggested and applied")
            else:
                state.plan = with_changes(state.plan, variance_transform="none", boxcox_lambda=None, boxcox_offset=0.0)
                out.notes.append("variance: no transform suggested")

        periods = self.diagnostics.periods(self.views.get_view(state, spec["periodogram"])).persist()
        chosen = chosen_period(periods).first()
        rows = [r.asDict() for r in periods.orderBy("series_id", "rank").collect()]
        out.period_candidates = {"candidates": rows, "chosen_m": chosen.chosen_m if chosen else None}
        if not rows:
            out.period_candidates["notes"] = "Too short"
        if not lock_m and out.period_candidates["chosen_m"]:
            state.plan = with_changes(state.plan, seasonal_period_m=out.period_candidates["chosen_m"])

        state.candidates, notes = self.views.candidates(bundle, state.plan)
        out.notes += notes
        policy = StationarityPolicy(max_d=state.plan.max_d, max_D=state.plan.max_D)
        if state.candidates:
            found = {(r.D_, r.d): r.asDict() for r in self.diagnostics.stationarity(stacked(state.candidates)).collect()}
            for c in state.candidates:
                row = {"D": c.plan.D, "d": c.plan.d, "m": c.plan.seasonal_period_m} | {k: v for k, v in found.get((c.plan.D, c.plan.d), {"n": 0}).items() if k not in ("series_id", "D_", "d")}
                out.stationarity_table.append(row | {"pass_stationarity": passes(row, policy)})
        state.final, out.stationarity_selection = select_stationary_candidate(state.candidates, out.stationarity_table, policy)
        if not lock_diffs and state.final is not None:
            state.plan = state.final.plan

        table = self.diagnostics.acf_pacf(self.views.get_view(state, spec["acf_pacf_final"])).persist()
        rows = [r.asDict() for r in table.orderBy("series_id", "lag").collect()]
        n = rows[0]["n"] if rows else self.views.get_view(state, spec["acf_pacf_final"]).y.where("y IS NOT NULL").count()
        out.acf_pacf = {"n": n} | ({"nlags": rows[-1]["lag"], "rows": rows} if rows else {})
        m = state.plan.seasonal_period_m
        if m and rows:
            out.seasonal_lags = [r.asDict() for r in seasonal_lags(table, m).orderBy("lag").collect()]
        if m:
            out.stl = self.diagnostics.stl(self.views.get_view(state, spec["acf_pacf_final" if compat_stl_view else "stl_interpretation"]), m)
        return state
