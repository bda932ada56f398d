"""Prompt history and the latest inference per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import filename_from_url, or_unknown
from .slices import lag_in_group


def prompt_changes(prompts: DataFrame, slice_by: Column, kind: str = "document_type",
                   order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Snapshots where the prompt differs from the previous one of its document type.

    The first prompt of a type is a change, even a null one.
    """
    named = prompts.withColumn(kind, or_unknown(F.col(kind)))
    seen = lag_in_group(named, [kind], list(order), slice_by, "prompt", "previous_prompt")
    changed = ~F.col("has_previous") | ~F.col("prompt").eqNullSafe(F.col("previous_prompt"))
    return seen.filter(changed).drop("has_previous")


def latest_inference(runs: DataFrame) -> DataFrame:
    """Last run per task; runs without an execution are ignored."""
    others = [c for c in runs.columns if c != "task_id"]
    newest = F.max_by(F.struct(*others), F.struct("updated_at", "execution_id"))
    return (
        runs.filter(F.coalesce(F.col("execution_id"), F.lit("")) != "")
        .groupBy("task_id")
        .agg(newest.alias("r"))
        .select("task_id", "r.*")
    )


def inference_to_task(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Runs with the file of their task; ``unknown`` when the task or file is missing."""
    files = tasks.select(F.col("id").alias("task_id"), F.col("data.pdf").alias("file_ref"))
    joined = runs.join(files, "task_id", "left")
    return joined.withColumn("filename", filename_from_url("file_ref"))


def inference_with_replay(runs: DataFrame, replays: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with their replay payload, runs without one).

    The payload's document type wins over the run's own.
    """
    payloads = replays.select(
        "execution_id",
        F.col("document_type").alias("replay_type"),
        "model",
        "system_prompt",
        "user_prompt",
    )
    found = runs.join(payloads, "execution_id").withColumn(
        "document_type", or_unknown(F.coalesce("replay_type", "document_type"))
    )
    missing = runs.join(payloads.select("execution_id"), "execution_id", "left_anti")
    return found.drop("replay_type"), missing


def sorted_entries(runs: DataFrame, project_id=None) -> DataFrame:
    """Newest first, of one project when given."""
    mine = runs if project_id is None else runs.filter(F.col("project_id") == project_id)
    return mine.orderBy(F.col("updated_at").desc(), F.col("task_id"))
