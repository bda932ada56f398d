"""The catalog-driven field comparison as a registered metric, with its report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..constants import FIELD_METRIC_NAME
from ..operators import evaluation, reports
from ..operators.registry import registry


@registry.register(
    name=FIELD_METRIC_NAME,
    description="Compare declared fields with the metrics of the field catalog",
    metric_type="pydantic_comparison",
    require=("prediction", "ground_truth", "document_type"),
)
def field_by_field(inputs: DataFrame) -> DataFrame:
    return evaluation.observations(inputs.withColumnRenamed("ground_truth", "truth"))


@registry.renderer(FIELD_METRIC_NAME)
def field_report(observations: DataFrame, scores: DataFrame, models: list[str] | None = None):
    return reports.report_by_model(observations, scores, models)
