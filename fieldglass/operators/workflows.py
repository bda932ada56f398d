"""Workflow catalog, step lists and effective parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K


def first_by_position(workflows: DataFrame, position: str = "position") -> DataFrame:
    """First definition of each id in file order."""
    others = [c for c in workflows.columns if c != "id"]
    first = F.min_by(F.struct(*others), F.col(position))
    return workflows.groupBy("id").agg(first.alias("w")).select("id", "w.*").drop(position)


def with_workflow(last_events: DataFrame, workflows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events joined with their workflow, events whose workflow does not exist)."""
    flows = workflows.select(
        F.col("id").alias("__wid"), *[F.col(c).alias(f"workflow_{c}") for c in workflows.columns if c != "id"]
    )
    same = F.col("workflow_id") == F.col("__wid")
    return (
        last_events.join(flows, same).drop("__wid"),
        last_events.join(flows.select("__wid"), same, "left_anti"),
    )


def step_registry(spark: SparkSession) -> DataFrame:
    """Known step names (a fixed short list)."""
    return spark.createDataFrame([(s,) for s in K.WORKFLOW_STEPS], "step string")


def exploded_steps(workflows: DataFrame) -> DataFrame:
    return workflows.select(
        F.col("id").alias("workflow_id"), F.posexplode("steps").alias("position", "step")
    )


def resolve_steps(workflows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runnable steps in order, unknown steps). Unknown names are skipped at run time."""
    steps = exploded_steps(workflows)
    known = F.broadcast(step_registry(workflows.sparkSession))
    return steps.join(known, "step"), steps.join(known, "step", "left_anti")


def runnable_workflows(workflows: DataFrame) -> DataFrame:
    """Per workflow the ordered known steps; an empty list cannot run."""
    known = F.filter("steps", lambda s: s.isin(*K.WORKFLOW_STEPS))
    return workflows.select(
        "id", known.alias("steps"),
        F.when(F.size(known) == 0, "No workflow steps found").alias("error"),
    )


def effective_model(requested: Column, default: Column) -> Column:
    return F.coalesce(requested, default)


def effective_parameters(executions: DataFrame, workflows: DataFrame) -> DataFrame:
    """Model, document type and candidate types that an execution really uses.

    Expects ``requested_model``, ``requested_type`` and ``candidate_types``. A given
    document type skips the classification with full confidence; otherwise a
    restricted list, or every supported type, is offered.
    """
    flows = workflows.select(F.col("id").alias("workflow_id"), "llm_model")
    supported = F.array(*[F.lit(t) for t in K.DOCUMENT_TYPES if t != K.OTHER_TYPE])
    given = F.col("requested_type").isNotNull()
    restricted = F.coalesce(F.size("candidate_types"), F.lit(0)) > 0
    return executions.join(flows, "workflow_id").select(
        *executions.columns,
        effective_model(F.col("requested_model"), F.col("llm_model")).alias("effective_model"),
        given.alias("classification_skipped"),
        F.when(given, 1.0).alias("confidence"),
        F.when(given, F.array("requested_type"))
        .when(restricted, F.col("candidate_types"))
        .otherwise(supported)
        .alias("effective_types"),
    )


def supported_types(rows: DataFrame, column: str = "document_type") -> DataFrame:
    return rows.filter(F.col(column) != K.OTHER_TYPE)


def resolve_extraction_type(classified: Column, requested: Column) -> Column:
    """Type to extract: the classification wins over the request."""
    return F.coalesce(classified, requested)
