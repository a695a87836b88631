"""The workbench: a plan that is edited step by step, and runs that leave it as it is. A menu for terminals lies on top."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import DETRENDS, VARIANCE_TRANSFORMS, PreModelState, SeriesBundle, TransformPlan, with_changes
from ..operators.cleaner import TimeSeriesCleaner
from ..operators.roles import SchemaDetector
from ..operators.series import canonical, resample
from ..sources.ingest import DataIngestor
from . import frames
from .pipeline import PreModelOrchestrator


class Workbench:
    def __init__(self, y: DataFrame, name: str = "y", freq: str | None = None, plan: TransformPlan | None = None):
        self.y_original = self.y = y
        self.freq_original = self.freq = freq
        self.name, self.plan = name, plan or TransformPlan()
        self.saved = self.first = self.plan
        self.locks = {"m": True, "variance": True, "diffs": True}
        self.state: PreModelState | None = None

    @classmethod
    def from_csv(cls, spark: SparkSession, source, user_target_col: str | None = None, **options) -> Workbench:
        df = DataIngestor(spark, source, **options).load()
        schema = SchemaDetector(df, user_target_col=user_target_col).detect()
        if schema.target_col is None:
            raise ValueError("no target column was found")
        rows, meta = TimeSeriesCleaner(df, schema).clean()
        return cls(canonical(rows, "ts", schema.target_col), schema.target_col, meta.freq)

    def show_plan(self) -> dict:
        return vars(self.plan) | {f"lock_{k}": v for k, v in self.locks.items()}

    def time_plot(self) -> DataFrame:
        return frames.time_series(self.y)

    def resample(self, rule: str, how: str = "sum") -> DataFrame:
        """Puts the series on coarser buckets; what has been resampled is resampled again. reset_series undoes it."""
        self.y, self.freq = resample(self.y, rule, how), rule
        return self.y

    def reset_series(self) -> None:
        self.y, self.freq = self.y_original, self.freq_original

    def rolling(self) -> DataFrame:
        return frames.rolling_mean_var(self.run().diagnostics.raw)

    def periods(self) -> dict:
        return self.run().diagnostics.period_candidates

    def set_m(self, m: int | None) -> None:
        self.plan = with_changes(self.plan, seasonal_period_m=m)

    def set_variance(self, transform: str, offset: float = 0.0, lam: float | None = None) -> None:
        if transform not in VARIANCE_TRANSFORMS:
            raise ValueError(f"unknown variance_transform: {transform}")
        self.plan = with_changes(self.plan, variance_transform=transform, boxcox_offset=offset, boxcox_lambda=lam)

    def set_diffs(self, d: int, D: int) -> None:
        self.plan = with_changes(self.plan, d=d, D=D)

    def set_detrend(self, how: str) -> None:
        if how not in DETRENDS:
            raise ValueError(f"unknown detrend: {how}")
        self.plan = with_changes(self.plan, detrend_for_periodogram=how)

    def save(self) -> None:
        self.saved = self.plan

    def revert(self) -> None:
        self.plan = self.saved

    def reset(self) -> None:
        self.plan = self.saved = self.first

    def toggle_lock(self, name: str) -> bool:
        self.locks[name] = not self.locks[name]
        return self.locks[name]

    def run(self) -> PreModelState:
        bundle = SeriesBundle(self.y, self.name, self.freq)
        self.state = PreModelOrchestrator().run(bundle, self.plan, lock_m=self.locks["m"], lock_variance=self.locks["variance"], lock_diffs=self.locks["diffs"])
        return self.state


def whole_number(text: str) -> int | None:
    try:
        return int(text.strip())
    except ValueError:
        return None


def real_number(text: str) -> float | None:
    try:
        return float(text.strip())
    except ValueError:
        return None


MENU = "0 plan, 1 series, 2 resample, 3 rolling, 4 periods, 5 m, 6 variance, 7 differences, 8 detrend, 9 save, 10 revert, 11 reset, 12 locks, 13 run, q quit"


def run_manual_pre_model(spark: SparkSession, csv_path: str, user_target_col: str | None = None, ask: Callable[[str], str] = input, tell: Callable[[str], None] = print) -> TransformPlan:
    """The menu: answers come from ask, results go to tell; gives the plan as it was left."""
    bench = Workbench.from_csv(spark, csv_path, user_target_col)
    table = lambda df: tell("\n".join(map(str, df.limit(20).collect())))
    while (choice := ask(f"{MENU}: ").strip().lower()) != "q":
        try:
            if choice == "0":
                tell(str(bench.show_plan()))
            elif choice == "1":
                table(bench.time_plot())
            elif choice == "2":
                bench.resample(ask("rule: ").strip(), ask("sum or mean: ").strip())
            elif choice == "3":
                table(bench.rolling())
            elif choice == "4":
                tell(str(bench.periods()))
            elif choice == "5":
                bench.set_m(whole_number(ask("m: ")))
            elif choice == "6":
                bench.set_variance(ask("none, log or boxcox: ").strip(), real_number(ask("offset: ")) or 0.0)
            elif choice == "7":
                bench.set_diffs(whole_number(ask("d: ")) or 0, whole_number(ask("D: ")) or 0)
            elif choice == "8":
                bench.set_detrend(ask("none, linear or diff1: ").strip())
            elif choice in ("9", "10", "11"):
                {"9": bench.save, "10": bench.revert, "11": bench.reset}[choice]()
            elif choice == "12":
                bench.toggle_lock(ask("m, variance or diffs: ").strip())
            elif choice == "13":
                state = bench.run()
                tell(str(state.plan))
                tell(str(frames.stationarity_table(state.diagnostics.stationarity_table)))
            else:
                tell("no such choice")
        except (ValueError, NotImplementedError, KeyError) as failed:
            tell(f"failed: {failed}")
    return bench.plan
