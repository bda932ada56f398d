"""Message routing, dead letters, reclaim and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import delivery as D
from ..operators import messages as M
from .registry import query
from .views import Inputs, at, sql_at

ROUTE_SQL = """
SELECT msg_id, retries,
  CASE WHEN msg_id % 17 = 0 THEN 'dlq' WHEN outcome = 'success' THEN 'ack'
    WHEN outcome = 'retryable' AND retries < 2 THEN 'requeue' ELSE 'dlq' END AS route,
  CASE WHEN msg_id % 17 = 0 THEN 'decode_error' WHEN outcome = 'success' THEN NULL
    WHEN outcome = 'retryable' AND retries < 2 THEN NULL WHEN outcome = 'retryable' THEN 'max_retries_exceeded'
    ELSE 'not_retryable_error' END AS reason,
  CASE WHEN msg_id % 17 <> 0 AND outcome = 'retryable' AND retries < 2 THEN retries + 1 END AS next_retries
FROM messages"""


@query("route_outcomes", sql=ROUTE_SQL)
def route_outcomes(v: Inputs) -> DataFrame:
    routed = M.route_outcomes(M.decoded(v.messages, ("k",)))
    return routed.select("msg_id", "retries", "route", "reason", "next_retries")


@query("dead_letters", sql="""
SELECT data, CAST(retries AS VARCHAR) AS retries, CAST(msg_id AS VARCHAR) AS original_id,
  CASE WHEN msg_id % 17 = 0 THEN 'decode_error' WHEN outcome = 'retryable' THEN 'max_retries_exceeded'
    ELSE 'not_retryable_error' END AS reason, '' AS error, 'consumer-1' AS consumer
FROM messages WHERE msg_id % 17 = 0 OR outcome = 'fatal' OR (outcome = 'retryable' AND retries >= 2)""")
def dead_letters(v: Inputs) -> DataFrame:
    routed = M.route_outcomes(M.decoded(v.messages, ("k",)))
    return M.dead_letters(routed, "consumer-1").drop("timestamp")


@query("requeued_messages", sql="""
SELECT data, retries + 1 AS retries FROM messages WHERE msg_id % 17 <> 0 AND outcome = 'retryable' AND retries < 2""")
def requeued_messages(v: Inputs) -> DataFrame:
    return M.requeued(M.route_outcomes(M.decoded(v.messages, ("k",))))


@query("last_retries", sql="SELECT msg_id, retries >= 2 AS is_last FROM messages")
def last_retries(v: Inputs) -> DataFrame:
    return v.messages.select("msg_id", D.is_last_retry("retries").alias("is_last"))


NOW = "2024-01-15 12:00:00"


def _reclaim_sql(step: int, dead_acked: str) -> str:
    return f"""
SELECT msg_id, data, CASE WHEN retries + 1 > 3 THEN 'dlq' ELSE 'requeue' END AS route,
  CASE WHEN retries + 1 > 3 THEN 'max_retries_exceeded' END AS reason,
  CASE WHEN retries + 1 <= 3 THEN retries + {step} END AS next_retries,
  CASE WHEN retries + 1 > 3 THEN {dead_acked} ELSE true END AS acknowledged
FROM messages WHERE outcome <> 'success' AND delivered_at < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND"""


def _reclaim(v: Inputs, mode: str) -> DataFrame:
    acked = v.messages.filter(F.col("outcome") == "success").select("msg_id")
    return M.reclaim_idle(v.messages, acked, F.lit(NOW).cast("timestamp"), mode=mode)


@query("reclaim_idle", sql=_reclaim_sql(1, "true"))
def reclaim_idle(v: Inputs) -> DataFrame:
    return _reclaim(v, "fixed")


@query("reclaim_idle_reference", sql=_reclaim_sql(2, "false"))
def reclaim_idle_reference(v: Inputs) -> DataFrame:
    return _reclaim(v, "reference")


@query("trim_stream", sql="SELECT msg_id FROM messages ORDER BY delivered_at DESC, msg_id DESC LIMIT 1000")
def trim_stream(v: Inputs) -> DataFrame:
    return M.trim_stream(v.messages).select("msg_id")


@query("trim_streams", sql="""
SELECT msg_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY delivered_at DESC, msg_id DESC) AS rn
  FROM messages) WHERE rn <= 200""")
def trim_streams(v: Inputs) -> DataFrame:
    return M.trim_stream(v.messages, 200, ("outcome",)).select("msg_id", "outcome")


_CODE = ("CASE msg_id % 9 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 404 WHEN 3 THEN 422 WHEN 4 THEN 500 WHEN 5 THEN 503"
         " WHEN 6 THEN 302 WHEN 7 THEN 204 END")


def _attempts(v: Inputs) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in (200, 401, 404, 422, 500, 503, 302, 204, None)])
    return v.messages.select(
        "msg_id", "delivered_at", F.col("retries").alias("attempt"),
        F.element_at(codes, (F.col("msg_id") % 9 + 1).cast("int")).alias("status"),
    )


@query("delivery_plan", sql=f"""
WITH a AS (SELECT msg_id, retries AS attempt, {_CODE} AS status FROM messages),
b AS (SELECT *, CASE WHEN status IS NULL THEN 'No answer' WHEN status IN (302, 401, 422) THEN 'Non retryable HTTP ' || status
  WHEN status >= 300 AND attempt >= 3 THEN 'Max retries exceeded (HTTP ' || status || ')' END AS error FROM a)
SELECT msg_id, attempt, CASE WHEN status IS NULL THEN 'logged' WHEN status < 300 THEN 'done' WHEN error IS NOT NULL THEN 'dlq' ELSE 'retry' END AS action, error,
  CASE WHEN status >= 300 AND error IS NULL THEN 5.0::DOUBLE * pow(2, attempt) END AS delay_seconds FROM b""")
def delivery_plan(v: Inputs) -> DataFrame:
    return M.delivery_plan(_attempts(v)).select("msg_id", "attempt", "action", "error", "delay_seconds")


@query("retry_schedule", sql=f"""
WITH a AS (SELECT msg_id, delivered_at, {_CODE} AS status FROM messages)
SELECT msg_id, CAST(n AS INT) AS attempt, {sql_at("delivered_at + to_seconds(CAST(5 * (pow(2, n) - 1) AS INT))")} AS due_at
FROM a JOIN range(0, 4) r(n) ON n = 0 OR status NOT IN (302, 401, 422) WHERE status >= 300 OR status IS NULL AND n = 0""")
def retry_schedule(v: Inputs) -> DataFrame:
    failing = _attempts(v).filter(~F.coalesce(F.col("status") < 300, F.lit(False))).drop("attempt")
    return M.retry_schedule(failing).select("msg_id", "attempt", at("due_at").alias("due_at"))


@query("webhook_dead_letters", sql=f"""
SELECT 'webhooks' AS original_stream, CAST(msg_id AS VARCHAR) AS original_id,
  CASE WHEN status IN (302, 401, 422) THEN 'Non retryable HTTP ' || status ELSE 'Max retries exceeded (HTTP ' || status || ')' END AS error, data
FROM (SELECT *, {_CODE} AS status FROM messages) WHERE status IN (302, 401, 422) OR (status >= 300 AND retries >= 3)""")
def webhook_dead_letters(v: Inputs) -> DataFrame:
    planned = M.delivery_plan(_attempts(v).join(v.messages.select("msg_id", "data"), "msg_id"))
    return M.webhook_dead_letters(planned.filter(F.col("action") == "dlq"), "webhooks")
