"""Metric and report registry."""

from __future__ import annotations

import importlib
import pkgutil
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Metric:
    """A registered metric: a builder from prepared pairs to observations."""

    name: str
    build: Callable[[DataFrame], DataFrame] | None = None
    description: str = ""
    metric_type: str = "standard"
    require: tuple[str, ...] = ()
    report: Callable[..., DataFrame | dict[str, DataFrame]] | None = None


class MetricRegistry:
    """Metrics by name. A report may be registered before or after its metric."""

    def __init__(self) -> None:
        self._metrics: dict[str, Metric] = {}

    def _entry(self, name: str) -> Metric:
        return self._metrics.setdefault(name, Metric(name))

    def register(self, name: str, description: str, metric_type: str = "standard",
                 require: tuple[str, ...] | list[str] = ()):
        def keep(build):
            entry = self._entry(name)
            entry.build, entry.description = build, description
            entry.metric_type, entry.require = metric_type, tuple(require)
            return build

        return keep

    def renderer(self, name: str):
        def keep(report):
            self._entry(name).report = report
            return report

        return keep

    def get_metric(self, name: str) -> Metric | None:
        return self._metrics.get(name)

    def list_metrics(self) -> dict[str, Metric]:
        return dict(self._metrics)

    def get_metric_names(self) -> list[str]:
        return list(self._metrics)

    def get_metric_renderer(self, name: str):
        entry = self._metrics.get(name)
        return entry.report if entry else None

    def has_renderer(self, name: str) -> bool:
        return self.get_metric_renderer(name) is not None

    def render(self, name: str, *tables: DataFrame):
        """Report of a metric; without one the observations themselves."""
        report = self.get_metric_renderer(name)
        return report(*tables) if report else tables[0]

    def evaluate(self, name: str, pairs: DataFrame) -> DataFrame:
        entry = self.get_metric(name)
        if entry is None or entry.build is None:
            raise ValueError(f"Metric '{name}' not found in registry")
        return entry.build(prepare_inputs(pairs, entry.require))


# Input names a metric may require, and the pair columns that provide them.
INPUT_COLUMNS = {
    "prediction": "prediction",
    "ground_truth": "truth",
    "output": "prediction",
    "output_true": "truth",
    "query": "query",
    "document_type": "document_type",
}
IDENTITY = ("task_id", "model_version", "prediction_id", "processing_time_ms")


def prepare_inputs(pairs: DataFrame, require: tuple[str, ...]) -> DataFrame:
    """Identity columns plus the required inputs under their required names."""
    chosen = [
        F.col(INPUT_COLUMNS[name]).alias(name)
        for name in require
        if INPUT_COLUMNS.get(name) in pairs.columns
    ]
    return pairs.select(*[c for c in IDENTITY if c in pairs.columns], *chosen)


def discover(package: ModuleType, skip: tuple[str, ...] = ("utils",)) -> list[str]:
    """Import every public module of ``package`` so that its metrics register.

    A module that fails to import is reported as a warning and left out.
    """
    loaded = []
    for info in pkgutil.iter_modules(package.__path__):
        if info.name.startswith("_") or info.name in skip:
            continue
        try:
            importlib.import_module(f"{package.__name__}.{info.name}")
            loaded.append(info.name)
        except Exception as exc:  # noqa: BLE001 - any failure of a plug-in is only a warning
            warnings.warn(f"Failed to import metric module {info.name}: {exc}", stacklevel=2)
    return loaded


registry = MetricRegistry()
