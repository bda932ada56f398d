"""Composite jobs: evaluation, reports, history, status, pipeline, retention, quota."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import custom, evaluation, events, experiments, quota, reports, workflows
from ..operators.registry import registry
from ..session import scratch_dir
from ..sources.sinks import rewrite_days, save_experiment
from ..sources.tables import scan_event_store, scan_experiments, scan_observations


def evaluate_project(
    tasks: DataFrame, document_type: str | None = None, metric: str = K.FIELD_METRIC_NAME
) -> tuple[DataFrame, DataFrame]:
    """(observations, run counters) of a labelled dataset."""
    from ..metrics import field_by_field  # noqa: F401 - registers the built-in metric

    pairs = evaluation.pair_predictions(tasks, document_type)
    return registry.evaluate(metric, pairs), evaluation.evaluation_counters(tasks, document_type)


def model_report(tasks: DataFrame, document_type: str | None = None) -> DataFrame:
    """Summary per model version, straight from tasks."""
    observations, _ = evaluate_project(tasks, document_type)
    return reports.model_summary(observations)


def report_by_model(tasks: DataFrame, models: list[str] | None = None) -> dict[str, DataFrame]:
    """The report of a labelled dataset.

    Tasks are read and scored once, into a fact table in scratch; one aggregation of it is
    kept as well, and all tables of the report come from these two.
    """
    spark, root = tasks.sparkSession, scratch_dir(tasks.sparkSession, "report")
    found = evaluation.observations(evaluation.pair_predictions(tasks))
    found.select("task_id", "prediction_id", *reports.FACT).write.parquet(f"{root}/facts")
    facts = spark.read.parquet(f"{root}/facts")
    reports.report_aggregates(facts).write.parquet(f"{root}/aggregates")
    return reports.report_from_facts(facts, spark.read.parquet(f"{root}/aggregates"), models)


def experiment_history(
    observations: DataFrame | None,
    path: str,
    spark: SparkSession,
    project_id=None,
    metric_name: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    run: dict | None = None,
) -> DataFrame:
    """Save a run (when given) and list the stored experiments, newest first.

    All experiments of the project and metric are listed, or a page of them.
    """
    if observations is not None:
        save_experiment(observations, path, **(run or {}))
    return experiments.experiment_list(
        scan_experiments(spark, f"{path}/experiments"),
        scan_observations(spark, f"{path}/observations"),
        project_id, metric_name, limit, offset,
    )


def execution_status(log: DataFrame, catalog: DataFrame, organization=None,
                     debug: bool = False) -> DataFrame:
    """Status of every execution, in one pass over the log.

    Executions of unknown workflows are left out, as are those of other
    organizations when one is given.
    """
    last = events.last_event(log)
    mine = last if organization is None else events.owned_by(last, organization)
    known, _ = workflows.with_workflow(mine, catalog.select("id"))
    return events.status_view(events.parse_event_payload(known), debug)


def execution_pipeline(
    log: DataFrame,
    catalog: DataFrame,
    run_steps: Callable[[dict], dict],
    n_partitions: int | None = None,
) -> DataFrame:
    """Run every resumable execution with a user function and shape the outcome.

    One row per execution: success with its result list, or the classified error.
    Executions of unknown workflows and workflows without a runnable step fail
    before the function is called. What is to run is written to scratch first, so the log
    is reduced once for both kinds.
    """
    todo = events.resumable_executions(log)
    flows = workflows.runnable_workflows(catalog).withColumnRenamed("id", "workflow_id")
    planned = todo.join(flows, "workflow_id", "left")
    blocked = F.when(F.col("steps").isNull(), "WorkflowNotFoundException").when(
        F.col("error").isNotNull(), "Exception"
    )
    path = scratch_dir(log.sparkSession, "to-run")
    planned.withColumn("blocked", blocked).write.parquet(path)
    ready = log.sparkSession.read.parquet(path)
    ran = custom.predict(
        ready.filter(F.col("blocked").isNull()).drop("blocked", "error"),
        run_steps, key="execution_id", n_partitions=n_partitions,
    ).select("execution_id", "success", "error", "error_type", "result")
    refused = ready.filter(F.col("blocked").isNotNull()).select(
        "execution_id",
        F.lit(False).alias("success"),
        F.coalesce("error", F.lit("Workflow not found")).alias("error"),
        F.col("blocked").alias("error_type"),
        F.lit(None).cast(ran.schema["result"].dataType).alias("result"),
    )
    return ran.unionByName(refused)


def retention(spark: SparkSession, path: str, now: Column, days: int = K.RETENTION_DAYS,
              rules: str = "payload") -> str:
    """Redact due events of the stored log and write back the days they belong to.

    Days after the cutoff are not read, days without a due event are not rewritten.
    The new version of the due days goes to scratch first, so the log is never
    read and overwritten in the same job. Returns the scratch folder.

    Events of due days must not be appended while this runs: what comes between the two
    writes would be lost. Events are dated when they are written, so with the retention of
    whole days only a writer that back-dates events has to be held off.
    """
    cutoff = now - F.expr(f"INTERVAL {days} DAYS")
    old_days = scan_event_store(spark, path).filter(F.col("event_date") <= cutoff.cast("date"))
    due_days = events.pending_before(old_days, cutoff).select("event_date").distinct()
    touched = old_days.join(due_days, "event_date", "left_semi").drop("event_date")
    staging = scratch_dir(spark, "retention")
    events.redact_events(touched, cutoff, rules).write.parquet(staging)
    rewrite_days(spark.read.parquet(staging), path)
    return staging


def usage_quota(requests: DataFrame, per_minute: int = K.LIMIT_PER_MINUTE,
                per_day: int = K.LIMIT_PER_DAY) -> DataFrame:
    return quota.usage_quota(requests, per_minute, per_day)
