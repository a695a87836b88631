"""Spark-native time-series preparation and pre-modelling diagnostics."""

from .model import DiagnosticsPacket, IngestionMetadata, PreModelState, SchemaMetadata, SeriesBundle, SeriesView, StationarityPolicy, TimeSeriesMeta, TransformedSeries, TransformPlan, TransformStepRecord
from .operators.cleaner import TimeSeriesCleaner
from .operators.diagnostics import DiagnosticsEngine
from .operators.roles import SchemaDetector
from .operators.selection import select_stationary_candidate
from .operators.transforms import TransformEngine
from .plans.frames import PreModelViewer
from .plans.pipeline import PreModelOrchestrator, ViewBuilder
from .plans.report import DiagnosticsReporter
from .plans.workbench import Workbench, run_manual_pre_model
from .sources.ingest import DataIngestor

__version__ = "0.1.0"
__all__ = [
    "DataIngestor", "DiagnosticsEngine", "DiagnosticsPacket", "DiagnosticsReporter", "IngestionMetadata", "PreModelOrchestrator", "PreModelState", "PreModelViewer", "SchemaDetector", "SchemaMetadata", "SeriesBundle", "SeriesView",
    "StationarityPolicy", "TimeSeriesCleaner", "TimeSeriesMeta", "TransformEngine", "TransformPlan", "TransformStepRecord", "TransformedSeries", "ViewBuilder", "Workbench", "run_manual_pre_model", "select_stationary_candidate",
]
