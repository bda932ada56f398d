"""Message tables: routing, dead letters, reclaim, trimming and delivery plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.delivery import backoff_seconds, decode_message, http_retryable, route


def decoded(messages: DataFrame, keys: tuple[str, ...], exact: bool = True) -> DataFrame:
    return messages.withColumn("message", decode_message("data", keys, exact))


def route_outcomes(messages: DataFrame, max_deliveries: int = K.MAX_DELIVERIES) -> DataFrame:
    """Adds route, reason and next_retries to messages with outcome and ``message``."""
    return messages.withColumn(
        "r", route("outcome", "retries", F.col("message").isNotNull(), max_deliveries)
    ).select("*", "r.*").drop("r")


def dead_letters(routed: DataFrame, consumer: str, at: Column | None = None) -> DataFrame:
    """Dead-letter rows of a routed table: seven text columns."""
    error = F.col("error") if "error" in routed.columns else F.lit(None)
    when = at if at is not None else F.current_timestamp()
    return routed.filter(F.col("route") == "dlq").select(
        F.coalesce("data", F.lit("")).alias("data"),
        F.coalesce(F.col("retries").cast("string"), F.lit("0")).alias("retries"),
        F.col("msg_id").cast("string").alias("original_id"),
        "reason",
        F.coalesce(error.cast("string"), F.lit("")).alias("error"),
        F.lit(consumer).alias("consumer"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("timestamp"),
    )


def webhook_dead_letters(messages: DataFrame, stream: str) -> DataFrame:
    """Dead letters of the notification stream: origin, id, error and data."""
    return messages.select(
        F.lit(stream).alias("original_stream"),
        F.col("msg_id").cast("string").alias("original_id"),
        F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("data", F.lit("")).alias("data"),
    )


def requeued(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("route") == "requeue").select(
        "data", F.col("next_retries").alias("retries")
    )


def reclaim_idle(
    deliveries: DataFrame,
    acknowledged: DataFrame,
    now: Column,
    idle_ms: int = K.IDLE_MS,
    max_deliveries: int = K.MAX_DELIVERIES,
    mode: str = "fixed",
) -> DataFrame:
    """Unacknowledged deliveries idle for longer than ``idle_ms``: requeue or dead letter.

    ``mode="fixed"`` raises the retry count by one and always acknowledges;
    ``mode="reference"`` raises it by two on requeue and leaves dead letters pending.
    """
    acks = acknowledged.select("msg_id").distinct()
    idle = (F.unix_micros(now.cast("timestamp")) -
            F.unix_micros(F.col("delivered_at").cast("timestamp"))) > idle_ms * 1000
    retry = F.coalesce("retries", F.lit(0)) + 1
    dead = retry > max_deliveries
    step = 1 if mode == "reference" else 0
    return (
        deliveries.join(acks, "msg_id", "left_anti")
        .filter(idle)
        .select(
            "msg_id",
            "data",
            F.when(dead, "dlq").otherwise("requeue").alias("route"),
            F.when(dead, "max_retries_exceeded").alias("reason"),
            F.when(~dead, retry + step).alias("next_retries"),
            (~dead if mode == "reference" else F.lit(True)).alias("acknowledged"),
        )
    )


def trim_stream(messages: DataFrame, maxlen: int = K.STREAM_MAXLEN, keys: tuple[str, ...] = (),
                order: tuple[str, ...] = ("delivered_at", "msg_id")) -> DataFrame:
    """Newest ``maxlen`` messages per stream.

    A single stream is a distributed top-k. Several streams use a ranked window whose
    limit Spark applies before the shuffle, so a busy stream sends at most ``maxlen``
    rows per map task.
    """
    newest = [F.col(c).desc() for c in order]
    if not keys:
        return messages.orderBy(*newest).limit(maxlen)
    ranked = messages.withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    )
    return ranked.filter(F.col("__rank") <= maxlen).drop("__rank")


def delivery_plan(attempts: DataFrame, max_retries: int = K.WEBHOOK_RETRIES) -> DataFrame:
    """Decision per delivery attempt (attempt, status): done, retry after a delay, or
    dead letter with its error text.

    Only 2xx is a delivery. An attempt without an answer (time-out, refused connection)
    has no status: it is logged and acknowledged, neither retried nor a dead letter.
    """
    answered = F.col("status").isNotNull()
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    code = F.col("status").cast("string")
    can_retry = http_retryable("status")
    error = F.when(~answered, "No answer").when(~ok & ~can_retry, F.concat(F.lit("Non retryable HTTP "), code)).when(
        ~ok & (F.col("attempt") >= max_retries),
        F.concat(F.lit("Max retries exceeded (HTTP "), code, F.lit(")")),
    )
    action = F.when(~answered, "logged").when(ok, "done").when(error.isNotNull(), "dlq").otherwise("retry")
    return attempts.withColumns(
        {
            "action": action,
            "error": error,
            "delay_seconds": F.when(action == "retry", backoff_seconds("attempt")),
        }
    )


def retry_schedule(failures: DataFrame, max_retries: int = K.WEBHOOK_RETRIES) -> DataFrame:
    """Planned attempts of messages that keep failing: attempt number and due time."""
    attempt = F.explode(F.sequence(F.lit(0), F.lit(max_retries)))
    waited = K.BACKOFF_SECONDS * (F.pow(F.lit(K.BACKOFF_FACTOR), F.col("attempt")) - 1) / (
        K.BACKOFF_FACTOR - 1
    )
    planned = failures.withColumn("attempt", attempt).withColumn("wait_seconds", waited)
    once = (F.col("attempt") == 0) | http_retryable("status")
    return planned.filter(once).withColumn(
        "due_at",
        F.timestamp_micros(
            F.unix_micros(F.col("delivered_at").cast("timestamp"))
            + (F.col("wait_seconds") * 1_000_000).cast("bigint")
        ),
    )
