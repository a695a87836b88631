"""A finished run as one HTML page: the plan and what its diagnostics found, as tables."""

from __future__ import annotations

from html import escape
from pathlib import Path
from typing import Any

from ..model import PreModelState
from . import frames

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;margin:.5em 0 1.5em}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:right}th{background:#eee}"


def shown(value: Any) -> str:
    return "" if value is None else escape(f"{value:.6g}" if isinstance(value, float) else str(value))


def html_table(rows: list[dict]) -> str:
    """The rows under the names of all their fields, in the order in which these come up."""
    names = list(dict.fromkeys(name for row in rows for name in row))
    if not names:
        return "<p>nothing</p>"
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{shown(row.get(n))}</td>" for n in names) + "</tr>" for row in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def named(values: dict) -> list[dict]:
    return [{"name": k, "value": v} for k, v in values.items()]


class DiagnosticsReporter:
    """What render_html puts on the page comes from the state alone; long tables are cut to max_rows, which the page says."""

    def __init__(self, state: PreModelState, title: str | None = None, max_rows: int = 200):
        self.state, self.title, self.max_rows = state, title or f"{state.bundle.name}: diagnostics", max_rows

    def sections(self) -> dict[str, list[dict]]:
        s, d = self.state, self.state.diagnostics
        return {
            "Plan": named(vars(s.plan)),
            "Variance": named(d.variance),
            "Periods": d.period_candidates.get("candidates", []),
            "Stationarity": frames.stationarity_table(d.stationarity_table, len(d.stationarity_table)),
            "Selection": named(d.stationarity_selection.get("selected") or {}) + named({"reason": d.stationarity_selection.get("reason")}),
            "Autocorrelation": d.acf_pacf.get("rows", []),
            "Seasonal lags": d.seasonal_lags or [],
            "Notes": [{"note": n} for n in d.notes],
        }

    def render_html(self) -> str:
        parts = []
        for name, rows in self.sections().items():
            more = f"<p>{len(rows) - self.max_rows} more rows</p>" if len(rows) > self.max_rows else ""
            parts.append(f"<h2>{escape(name)}</h2>{html_table(rows[: self.max_rows])}{more}")
        return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(self.title)}</title><style>{STYLE}</style></head><body><h1>{escape(self.title)}</h1>{"".join(parts)}</body></html>'

    def save(self, path: str | Path) -> Path:
        """Writes the page to the driver's disk, folders included."""
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(self.render_html(), encoding="utf-8")
        return path
