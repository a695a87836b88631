"""The records that steps hand to each other: plans, metadata, policies and states. Data stays in DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame

VARIANCE_TRANSFORMS = ("none", "log", "boxcox")
DETRENDS = ("none", "linear", "diff1")


@dataclass(frozen=True)
class IngestionMetadata:
    n_rows: int
    n_cols: int
    column_names: list[str]
    dtypes: dict[str, str]
    file_type: str
    encoding: str | None = None
    delimiter: str | None = None
    warnings: list[str] = field(default_factory=list)
    index_is_datetime: bool = False


@dataclass(frozen=True)
class SchemaMetadata:
    date_col: str | None
    target_col: str | None
    exog_cols: list[str]
    all_numeric: list[str]
    all_categorical: list[str]
    notes: list[str]


@dataclass(frozen=True)
class TimeSeriesMeta:
    date_col: str
    target_col: str | None
    exog_cols: list[str]
    start: Any
    end: Any
    freq: str | None
    n_obs: int
    has_missing_dates: bool
    n_missing_dates: int
    has_duplicates: bool
    notes: list[str]
    is_regular: bool = False


@dataclass(frozen=True)
class TransformPlan:
    """What to do to a series; copied with `dataclasses.replace`."""

    variance_transform: str = "none"
    boxcox_lambda: float | None = None
    boxcox_offset: float = 0.0
    detrend_for_periodogram: str = "linear"
    seasonal_period_m: int | None = None
    d: int = 0
    D: int = 0
    max_d: int = 2
    max_D: int = 1

    def checked(self) -> TransformPlan:
        if self.variance_transform not in VARIANCE_TRANSFORMS:
            raise ValueError(f"unknown variance_transform: {self.variance_transform}")
        if self.detrend_for_periodogram not in DETRENDS:
            raise ValueError(f"unknown detrend_for_periodogram: {self.detrend_for_periodogram}")
        if self.variance_transform == "boxcox":
            if self.boxcox_lambda is None:
                raise ValueError("boxcox needs boxcox_lambda")
            raise NotImplementedError("the boxcox transform is reserved; use log")
        if self.D and (self.seasonal_period_m or 0) <= 1:
            raise ValueError("seasonal differencing needs seasonal_period_m > 1")
        return self


@dataclass(frozen=True)
class TransformStepRecord:
    name: str
    params: dict[str, Any] = field(default_factory=dict)
    invertible: bool = False
    notes: str = ""


@dataclass(frozen=True)
class SeriesBundle:
    """series_id, ts, y in one frame; exogenous columns in another, keyed alike."""

    y: DataFrame
    name: str = "y"
    freq: str | None = None
    exog: DataFrame | None = None


@dataclass(frozen=True)
class SeriesView:
    view_id: str
    y: DataFrame
    exog: DataFrame | None
    applied_steps: list[TransformStepRecord]


@dataclass(frozen=True)
class TransformedSeries:
    y: DataFrame
    exog: DataFrame | None
    plan: TransformPlan
    applied_steps: list[TransformStepRecord]
    inverse: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class StationarityPolicy:
    alpha_adf: float = 0.05
    alpha_kpss: float = 0.05
    acf1_soft: float = -0.30
    acf1_hard: float = -0.50
    max_d: int = 2
    max_D: int = 1


@dataclass(frozen=True)
class DiagnosticSpec:
    """What a step looks at and what it needs of the plan."""

    name: str
    view_type: str
    needs_variance: bool = False
    needs_m: bool = False
    needs_diffs: bool = False
    artifact_key: str = ""


@dataclass(frozen=True)
class Step:
    name: str
    spec: DiagnosticSpec


@dataclass
class DiagnosticsPacket:
    raw: dict[str, Any] = field(default_factory=dict)
    variance: dict[str, Any] = field(default_factory=dict)
    period_candidates: dict[str, Any] = field(default_factory=dict)
    stationarity_table: list[dict[str, Any]] = field(default_factory=list)
    stationarity_selection: dict[str, Any] = field(default_factory=dict)
    acf_pacf: dict[str, Any] = field(default_factory=dict)
    seasonal_lags: list[dict[str, Any]] = field(default_factory=list)
    stl: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


@dataclass
class PreModelState:
    bundle: SeriesBundle
    plan: TransformPlan
    diagnostics: DiagnosticsPacket = field(default_factory=DiagnosticsPacket)
    views: dict[str, SeriesView] = field(default_factory=dict)
    candidates: list[TransformedSeries] = field(default_factory=list)
    final: TransformedSeries | None = None


def with_changes(plan: TransformPlan, **changes: Any) -> TransformPlan:
    return replace(plan, **changes)
