"""Sinks. All of them are plain distributed writes; none moves rows to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.files import or_unknown, safe_path_component
from ..operators.experiments import private_observations
from ..operators.reports import model_version_stats
from .tables import scan_observations


def build_events(df: DataFrame, event_type: str, members: dict[str, Column],
                 defaults: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Event rows with a JSON payload from the columns of ``df``.

    ``members`` are payload members; ``defaults`` fill the ones that are null.
    Identity columns, version and time are part of every payload. Columns named in
    ``keep`` stay beside the event.
    """
    defaults = defaults or {}
    filled = {
        name: F.coalesce(value, defaults[name]) if name in defaults else value
        for name, value in members.items()
    }
    created = F.coalesce(F.col("created_at"), F.current_timestamp()) if "created_at" in df.columns \
        else F.current_timestamp()
    event_id = F.coalesce(F.col("id"), F.uuid()) if "id" in df.columns else F.uuid()
    payload = F.to_json(
        F.struct(
            F.col("workflow_id"), F.col("execution_id"), F.col("organization_id"),
            created.alias("created_at"), F.lit(1).alias("version"),
            F.lit(event_type).alias("event_type"),
            *[v.alias(n) for n, v in filled.items()],
        )
    )
    return df.select(
        event_id.cast("string").alias("id"),
        "workflow_id",
        "execution_id",
        "organization_id",
        created.alias("created_at"),
        F.lit(event_type).alias("event_type"),
        payload.alias("event"),
        F.lit("PENDING").alias("anonymization_status"),
        *keep,
    )


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def started_events(df: DataFrame) -> DataFrame:
    classification = "struct<llm_model:string,document_types:array<string>>"
    extraction = "struct<llm_model:string,document_type:string>"
    none = F.lit(None).cast("string")
    members = {
        "s3_file_info": _given(df, "s3_file_info", "string"),
        "file_url": _given(df, "file_url", "string"),
        "metadata": _given(df, "metadata", "string"),
        "classification_parameters": _given(df, "classification_parameters", classification),
        "extraction_parameters": _given(df, "extraction_parameters", extraction),
    }
    empty_classification = F.struct(
        none.alias("llm_model"), F.lit(None).cast("array<string>").alias("document_types")
    )
    empty_extraction = F.struct(none.alias("llm_model"), none.alias("document_type"))
    return build_events(df, K.STARTED, members, {
        "metadata": F.lit("{}"),
        "classification_parameters": empty_classification,
        "extraction_parameters": empty_extraction,
    })


def step_events(df: DataFrame) -> DataFrame:
    return build_events(df, K.STEP_COMPLETED, {
        "step_name": F.col("step_name"),
        "step_result": _given(df, "step_result", "string"),
        "execution_time_ms": F.col("execution_time_ms"),
        "output_data": _given(df, "output_data", "string"),
    }, {"step_result": F.lit("{}")})


def completed_events(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return build_events(df, K.COMPLETED, {
        "final_result": F.col("final_result"),
        "total_processing_time_ms": F.col("total_processing_time_ms"),
        "output_summary": _given(df, "output_summary", "string"),
        "steps_completed": F.col("steps_completed"),
        "workflow_metadata": _given(df, "workflow_metadata", "array<string>"),
    }, {"output_summary": F.lit("{}")}, keep)


def failed_events(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return build_events(df, K.FAILED, {
        "error_type": F.col("error_type"),
        "error_message": F.col("error_message"),
        "failed_step": _given(df, "failed_step", "string"),
        "retry_count": _given(df, "retry_count", "int"),
    }, {"retry_count": F.lit(0)}, keep)


def append_events(events: DataFrame, path: str) -> None:
    """Append to the log, partitioned by day so that retention and scans prune.

    Rows are rebalanced by day: Spark cuts a large day into as many pieces of the advisory
    partition size as it needs and puts small days together.
    """
    _by_day(events).write.mode("append").partitionBy("event_date").parquet(path)


def _by_day(events: DataFrame) -> DataFrame:
    dated = events.withColumn("event_date", F.to_date("created_at"))
    return dated.hint("rebalance", F.col("event_date")).sortWithinPartitions(
        "event_date", "execution_id", "created_at"
    )


def rewrite_days(events: DataFrame, path: str) -> None:
    """Write back whole days of the log (retention): only the days present in
    ``events`` are replaced.

    ``events`` must not be read from the same path lazily; see ``plans.jobs.retention``.
    """
    (
        _by_day(events).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date").parquet(path)
    )


def write_dataset(tasks: DataFrame, path: str) -> None:
    """Labelling tasks as JSON lines; raw files stay where they are, tasks refer to them."""
    tasks.write.mode("overwrite").json(f"{path}/tasks")


def export_tasks(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def save_experiment(
    observations: DataFrame,
    path: str,
    experiment_id: str,
    project_id: int,
    metric_name: str,
    total_tasks: int = 0,
    notes: str | None = None,
) -> None:
    """Append one experiment and its observations; raw values are never written.

    The observations are evaluated once: what the header needs of their scores is observed in
    the pass that writes the rows, and the rest is read from the columns of the stored rows,
    of which only those of this experiment are touched.
    """
    seen = Observation()
    missing, zero = F.col("task_id").isNull(), F.col("task_id") == 0
    watched = observations.observe(
        seen, F.sum("score").alias("score"), F.count("score").alias("scored"),
        F.count_if(missing).alias("no_task"), F.count_if(zero).alias("task_zero"),
    )
    # Observations first: a header is only visible once its rows are.
    rows = private_observations(watched, experiment_id).withColumn("created_at", F.current_timestamp())
    rows.write.mode("append").parquet(f"{path}/observations")
    totals = seen.get

    spark = observations.sparkSession
    stored = scan_observations(spark, f"{path}/observations").filter(F.col("experiment_id") == experiment_id)
    tasks = stored.select("task_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    # a missing task is stored as task 0
    phantom = 1 if totals["no_task"] and not totals["task_zero"] else 0
    processed = (F.col("n") - phantom).cast("int")
    stats = model_version_stats(stored, "experiment_id").select(F.to_json("model_version_stats").alias("model_version_stats"))
    average = totals["score"] / totals["scored"] if totals["scored"] else None
    header = tasks.join(stats, how="left").select(
        F.lit(experiment_id).alias("id"), F.lit(project_id).cast("bigint").alias("label_project_id"),
        F.lit(metric_name).alias("metric_name"), F.current_timestamp().alias("created_at"),
        (F.lit(total_tasks) if total_tasks > 0 else processed).cast("int").alias("total_tasks"),
        processed.alias("processed_count"), F.lit(average).cast("double").alias("average_score"),
        "model_version_stats", F.lit("completed").alias("status"), F.lit(notes).cast("string").alias("notes"),
    )
    header.write.mode("append").parquet(f"{path}/experiments")


def write_bucketed(rows: DataFrame, table: str, path: str, key: str = "task_id", buckets: int = 64) -> None:
    """A table cut into buckets by its key and sorted in them, so that tables of the same
    number of buckets join on the key without being shuffled."""
    (
        rows.repartition(buckets, key).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    )


def message_rows(messages: DataFrame, *members: str) -> DataFrame:
    """Messages as {data JSON, timestamp, retries 0}."""
    return messages.select(
        F.to_json(F.struct(*members)).alias("data"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
        F.lit(0).alias("retries"),
    )


def publish_messages(messages: DataFrame, path: str, *members: str) -> None:
    message_rows(messages, *members).write.mode("append").json(path)


def write_dead_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("append").parquet(path)


def write_execution_log(entries: DataFrame, path: str) -> None:
    """One JSON text per entry, foldered by status."""
    body = F.to_json(F.struct(*[c for c in entries.columns]))
    entries.select("status", body.alias("value")).write.mode("append").partitionBy("status").text(path)


def write_replay_payloads(payloads: DataFrame, path: str) -> None:
    payloads.write.mode("append").json(path)


def write_prompt_history(snapshots: DataFrame, path: str, kind: str = "document_type") -> None:
    """Prompt snapshots, one folder per document type (made safe for a path)."""
    folder = safe_path_component(or_unknown(F.col(kind)))
    (
        snapshots.withColumn("document_type_key", folder)
        .write.mode("append").partitionBy("document_type_key").json(path)
    )
