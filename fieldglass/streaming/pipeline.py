"""The execution pipeline on a message stream: decode, prepare, run, record, route, notify."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.delivery import is_last_retry
from ..operators import custom, events, messages, tenancy, workflows
from ..sources import sinks

REQUEST = ("workflow_execution_id",)


def prepare(batch: DataFrame, log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Messages with their start event and runnable steps; ``blocked`` names what is missing.

    Only the log of the executions a batch asks for is searched for start events.
    """
    asked = messages.decoded(batch, REQUEST, exact=True).withColumn(
        "execution_id", F.col("message")[REQUEST[0]]
    )
    wanted = asked.select("execution_id").filter(F.col("execution_id").isNotNull()).distinct()
    starts = events.resumable_executions(log.join(wanted, "execution_id", "left_semi"))
    steps = workflows.runnable_workflows(catalog).select(
        F.col("id").alias("workflow_id"), "steps", F.col("error").alias("no_steps")
    )
    blocked = (
        F.when(F.col("message").isNull(), "decode_error")
        .when(F.col("id").isNull(), "NoEventAttachedToExecutionException")
        .when(F.col("steps").isNull(), "WorkflowNotFoundException")
        .when(F.col("no_steps").isNotNull(), "Exception")
    )
    return (
        asked.join(starts, "execution_id", "left")
        .join(steps, "workflow_id", "left")
        .withColumn("blocked", blocked)
        .drop("message", "no_steps")
    )


def outcomes(prepared: DataFrame, results: DataFrame, max_deliveries: int) -> DataFrame:
    """Prepared messages with the result of their run, the route and the reason."""
    ran = results.select(
        "msg_id", F.col("success").alias("ok"), "error", F.col("error_type").alias("kind"),
        F.col("result").alias("final_result"), "total_processing_time_ms",
    )
    joined = prepared.drop("error_type", "error").join(ran, "msg_id", "left")
    kind = F.coalesce("blocked", "kind")
    outcome = F.when(F.col("ok"), "success").when(kind == K.RETRYABLE_ERROR, "retryable").otherwise("fatal")
    readable = F.when(F.coalesce(F.col("blocked") != "decode_error", F.lit(True)), F.lit(True))
    routed = messages.route_outcomes(
        joined.withColumns({"outcome": outcome, "message": readable, "error_type": kind}), max_deliveries
    )
    return routed.withColumn("is_last_retry", is_last_retry("retries", max_deliveries)).drop("message", "kind")


def result_events(done: DataFrame) -> DataFrame:
    """Completed and failed events of the executions whose workflow was found.

    ``msg_id`` stays beside the event, which gets a time and id of its own.
    """
    found = done.filter(F.col("steps").isNotNull()).drop("id", "created_at")
    good = found.filter(F.col("ok")).withColumns({
        "steps_completed": F.size("steps"),
        "total_processing_time_ms": F.col("total_processing_time_ms").cast("bigint"),
    })
    bad = found.filter(~F.coalesce(F.col("ok"), F.lit(False))).withColumns({
        "error_message": F.coalesce("error", "error_type"),
        "failed_step": F.when(F.col("blocked").isNotNull(), "execute_workflow").otherwise(K.UNKNOWN_STEP),
        "retry_count": F.col("retries"),
    })
    return sinks.completed_events(good, keep=("msg_id",)).unionByName(
        sinks.failed_events(bad, keep=("msg_id",))
    )


def pipeline_batch(
    path: str,
    log: Callable[[], DataFrame],
    catalog: DataFrame,
    webhooks: DataFrame,
    run_steps: Callable[[dict], dict],
    consumer: str,
    n_partitions: int | None = None,
    max_deliveries: int = K.MAX_DELIVERIES,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for the whole chain.

    ``log`` gives the event log as of the batch. User code runs once per message: its
    results are written before events, routes and notifications are derived from
    them. Each table has one folder per batch, which a repeated batch overwrites.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def save(df: DataFrame, name: str) -> DataFrame:
            target = f"{path}/{name}/batch_id={batch_id}"
            df.write.mode("overwrite").parquet(target)
            return spark.read.schema(df.schema).parquet(target)

        prepared = save(prepare(batch, log(), catalog), "prepared")
        ready = prepared.filter(F.col("blocked").isNull())
        results = save(
            custom.predict(ready.drop("execution_id"), run_steps, "msg_id", n_partitions), "results"
        )
        done = save(outcomes(prepared, results, max_deliveries), "outcomes")
        save(result_events(done), "events")
        save(
            done.select("msg_id", "data", "retries", "route", "reason", "next_retries", "error",
                        F.lit(consumer).alias("consumer")),
            "routes",
        )
        finished = tenancy.finished_to_notify(done.filter(F.col("id").isNotNull()))
        told = tenancy.webhook_fanout(finished.select("msg_id", "execution_id", "organization_id"), webhooks)
        save(told.select("msg_id", "execution_id", "webhook_id", "url"), "notifications")

    return write
