"""Experiment runs and their observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.protect import observation_without_values
from .events import page
from .slices import join_children


def filter_experiments(experiments: DataFrame, project_id=None, metric_name=None) -> DataFrame:
    found = experiments
    if project_id is not None:
        found = found.filter(F.col("label_project_id") == project_id)
    if metric_name:
        found = found.filter(F.col("metric_name") == metric_name)
    return found


def experiment_rollup(observations: DataFrame, total_tasks: Column | int = 0,
                      keys: tuple[str, ...] = ("experiment_id",)) -> DataFrame:
    """Average of known scores, distinct tasks, and the task total (given if positive).

    Rows are reduced to one per task first, so the distinct count is a plain count
    and no key is expanded.
    """
    given = total_tasks if isinstance(total_tasks, Column) else F.lit(total_tasks)
    per_task = observations.groupBy(*keys, "task_id").agg(
        F.sum("score").alias("s"), F.count("score").alias("n")
    )
    rolled = per_task.groupBy(*keys).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("task_id").alias("processed_count")
    )
    return rolled.select(
        *keys,
        F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("average_score"),
        "processed_count",
        F.when(given > 0, given).otherwise(F.col("processed_count")).cast("bigint")
        .alias("total_tasks"),
    )


def observation_counts(experiments: DataFrame, observations: DataFrame) -> DataFrame:
    """Experiments with their number of observations, 0 when there are none."""
    counts = observations.groupBy(F.col("experiment_id").alias("__eid")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        experiments.join(counts, experiments["id"] == counts["__eid"], "left")
        .withColumn("observation_count", F.coalesce("n", F.lit(0)))
        .drop("__eid", "n")
    )


def success_rate(total: Column, processed: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(processed / total)


def experiment_list(
    experiments: DataFrame,
    observations: DataFrame,
    project_id=None,
    metric_name=None,
    limit: int | None = 50,
    offset: int = 0,
) -> DataFrame:
    """Newest experiments first, with success rate, skipped and observation counts.

    The page is cut before the observations are counted, and only the observations
    of the page are counted.
    """
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    top = page(filter_experiments(experiments, project_id, metric_name), newest, limit, offset)
    mine = observations.join(
        top.select(F.col("id").alias("experiment_id")), "experiment_id", "left_semi"
    )
    summary = observation_counts(top, mine)
    rate = success_rate(F.col("total_tasks"), F.col("processed_count"))
    return (
        summary.withColumn("success_rate", rate)
        .withColumn("skipped_count", F.col("total_tasks") - F.col("processed_count"))
        .orderBy(*newest)
    )


def experiment_with_observations(experiments: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per experiment and observation; experiments without any keep one row.

    Children stay rows instead of one nested list, so a huge experiment is many rows.
    """
    return join_children(experiments, observations, "id", "experiment_id")


def export_experiments(experiments: DataFrame, observations: DataFrame,
                       results: Column) -> DataFrame:
    """Experiment columns plus the observation rebuilt as JSON text, one row each.

    The text is built after the join, so that only the values are shuffled.
    """
    values = observations.select(
        "experiment_id",
        F.struct(
            "task_id",
            "prediction_id",
            F.coalesce("model_version", F.lit("Unknown")).alias("model_version"),
            "score",
            "processing_time_ms",
            F.coalesce(results, F.lit("{}")).alias("observation"),
        ).alias("observation"),
    )
    joined = experiment_with_observations(experiments, values)
    return joined.withColumn("observation", F.to_json("observation"))


def delete_cascade(
    parents: DataFrame, children: DataFrame, ids: DataFrame,
    parent_key: str = "id", child_key: str = "experiment_id",
) -> tuple[DataFrame, DataFrame]:
    """Parents and children that remain after deleting ``ids`` (column ``id``).

    The ids are hashed, so that no task sorts the rows they are held against. Repeated ids
    are left in: an aggregate of them would keep Spark from splitting a busy key.
    """
    gone = ids.select(F.col("id").alias("__gone")).hint("shuffle_hash")
    return (
        parents.join(gone, parents[parent_key] == gone["__gone"], "left_anti"),
        children.join(gone, children[child_key] == gone["__gone"], "left_anti"),
    )


def private_observations(observations: DataFrame, experiment_id: str) -> DataFrame:
    """Observation rows fit to store: ids, scores and results without raw values."""
    known = F.struct(F.coalesce("score", F.lit(0.0)).alias("score"))
    return observations.select(
        F.lit(experiment_id).alias("experiment_id"),
        F.coalesce("task_id", F.lit(0)).alias("task_id"),
        F.coalesce("prediction_id", F.lit(0)).alias("prediction_id"),
        F.coalesce("model_version", F.lit("Unknown")).alias("model_version"),
        known["score"].alias("score"),
        F.col("processing_time_ms").cast("double").alias("processing_time_ms"),
        observation_without_values("observation").alias("metric_results"),
    )
