"""Per-execution and per-request roll-ups of log lines and step facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import elapsed_ms
from ..functions.delivery import classify_error
from .slices import chunked_lists, header_and_items, ordinal_in_group


def execution_log(events: DataFrame) -> DataFrame:
    """One entry per execution, however many lines it has: status, times, error triple.

    All values come from aggregates that reduce map-side; the lines are rows of
    ``execution_log_lines``.
    """
    order = F.struct("created_at", "id")
    failed = F.col("event_type") == K.FAILED
    header = events.groupBy("execution_id").agg(
        F.min_by("workflow_id", order).alias("workflow_id"),
        F.min("created_at").alias("started_at"),
        F.max("created_at").alias("finished_at"),
        F.max_by("event_type", order).alias("last_type"),
        F.max(F.when(failed, F.col("retry_count"))).alias("retry_count"),
        F.max_by(F.struct("error_type", "step_name"), F.when(failed, order)).alias("err"),
        F.count(F.lit(1)).alias("log_lines"),
    )
    success = F.col("last_type") != K.FAILED
    error = classify_error(F.col("err.error_type"), F.lit(None).cast("string"), F.col("err.step_name"))
    return header.select(
        "execution_id",
        "workflow_id",
        F.when(success, "succeeded").otherwise("failed").alias("status"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        "started_at",
        "finished_at",
        elapsed_ms("started_at", "finished_at").alias("elapsed_time_ms"),
        F.when(~success, error["error_type"]).alias("error_type"),
        F.when(~success, error["failed_step"]).alias("failed_step"),
        "log_lines",
    )


def execution_log_lines(events: DataFrame, slice_by: Column) -> DataFrame:
    """The lines of the entries: one row per line with its position from 1."""
    numbered = ordinal_in_group(
        events, ["execution_id"], [F.col("created_at"), F.col("id")], slice_by, "position"
    )
    return numbered.select("execution_id", "position", "created_at", "event_type", "step_name")


def request_log(lines: DataFrame) -> DataFrame:
    """One entry per request id with tags from its first line; see ``request_log_lines``."""
    order = F.struct("ts", "id")
    header = lines.groupBy("request_id").agg(
        F.min_by(F.struct("method", "path", "organization_id"), order).alias("t"),
        F.max_by("status_code", order).alias("status_code"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("log_lines"),
    )
    return header.select(
        "request_id", "t.*", "status_code",
        elapsed_ms("first_ts", "last_ts").alias("elapsed_ms"), "log_lines",
    )


def request_log_lines(lines: DataFrame, slice_by: Column) -> DataFrame:
    """The messages of the entries: one row per message with its position from 1."""
    numbered = ordinal_in_group(lines, ["request_id"], [F.col("ts"), F.col("id")], slice_by, "position")
    return numbered.select("request_id", "position", "ts", "message")


def step_facts(executions: DataFrame) -> DataFrame:
    """Step metadata as a fact table: one row per execution and step, in order."""
    return executions.select(
        "execution_id", F.posexplode("workflow_metadata").alias("position", "m")
    ).select("execution_id", "position", "m.*")


def collect_step_metadata(facts: DataFrame, slice_by: Column, chunk_rows: int = 1000) -> DataFrame:
    """Step facts back to ordered lists per execution."""
    members = [c for c in facts.columns if c not in ("execution_id", "position")]
    return chunked_lists(
        facts, ["execution_id"], [F.col("position")], slice_by, F.struct(*members),
        "workflow_metadata", chunk_rows,
    )


def step_items(facts: DataFrame, slice_by: Column) -> tuple[DataFrame, DataFrame]:
    """Step facts of an execution as a header (steps, seconds) and one row per step in order."""
    return header_and_items(
        facts.withColumnRenamed("position", "step"), ["execution_id"], [F.col("step")], slice_by,
        {"execution_time": F.sum("execution_time")},
    )


def result_lists(codes: DataFrame, steps: DataFrame) -> DataFrame:
    """Codes and step metadata of every execution as the ordered lists of its final record.

    ``codes`` and ``steps`` have ``execution_id`` and ``position``; an execution's record holds
    what its pages and its workflow gave, so the lists are as short as these are.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        item = F.struct(*[c for c in rows.columns if c not in ("execution_id", "position")])
        ordered = F.array_sort(F.collect_list(F.struct("position", item.alias("item"))))
        return rows.groupBy("execution_id").agg(ordered.alias("l")).select("execution_id", F.col("l.item").alias(name))

    return listed(codes, "barcodes").join(listed(steps, "workflow_metadata"), "execution_id", "full")


def completed_results(
    executions: DataFrame,
    classifications: DataFrame,
    extractions: DataFrame,
    barcodes: DataFrame,
    steps: DataFrame,
) -> DataFrame:
    """Final result per execution from its optional parts, all keyed by execution_id.

    ``executions`` gives started_at and finished_at; ``barcodes`` and ``steps`` are
    already reduced to one row per execution.
    """
    joined = executions
    for part in (classifications, extractions, barcodes, steps):
        joined = joined.join(part, "execution_id", "left")
    return joined.withColumn(
        "total_processing_time_ms", elapsed_ms("started_at", "finished_at")
    ).withColumn("steps_completed", F.coalesce("steps_executed", F.lit(0)) + 1)
