"""Questions over the execution event log, retention and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import events as V
from ..operators import quota as Q
from ..operators import workflows as W
from ..sources import sinks
from .registry import query
from .views import Inputs, at, sql_at

_ORDER = "created_at, id"
_STATUS = """CASE {0} WHEN 'WorkflowExecutionStarted' THEN 'STARTED' WHEN 'WorkflowExecutionFailed' THEN 'FAILED'
  WHEN 'WorkflowExecutionCompleted' THEN 'SUCCESS' ELSE 'UNSUPPORTED' END"""
CUTOFF = "2024-01-20 00:00:00"


def payload_events(v: Inputs) -> DataFrame:
    """The flat event view with its members packed into the JSON payload column."""
    e = v.event_store
    failed = F.col("event_type") == K.FAILED
    members = F.struct(
        F.when(F.col("event_type") == K.STARTED,
               F.struct(F.col("s3_file_info").alias("filename"))).alias("s3_file_info"),
        F.when(F.col("event_type") == K.STARTED, F.col("metadata")).alias("metadata"),
        F.when(F.col("event_type") == K.STEP_COMPLETED, F.col("step_name")).alias("step_name"),
        F.when(failed, F.col("error_type")).alias("error_type"),
        F.when(failed, F.col("step_name")).alias("failed_step"),
        F.when(failed, F.col("retry_count")).alias("retry_count"),
        F.when(F.col("event_type") == K.COMPLETED, F.col("execution_time_ms")).alias("total_processing_time_ms"),
    )
    return e.select("id", "workflow_id", "execution_id", "organization_id", "created_at",
                    "event_type", F.to_json(members).alias("event"), "anonymization_status")


@query("last_event", sql=f"""
SELECT execution_id, id, workflow_id, event_type, {sql_at('created_at')} AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, id DESC) AS rn FROM event_store)
WHERE rn = 1""")
def last_event(v: Inputs) -> DataFrame:
    return V.last_event(v.event_store).select(
        "execution_id", "id", "workflow_id", "event_type", at("created_at").alias("created_at"))


@query("event_records", sql=f"""
SELECT id, workflow_id, execution_id, {sql_at('created_at')} AS created_at, event_type,
  CASE WHEN event_type = 'WorkflowExecutionFailed' THEN error_type END AS error_type,
  CASE WHEN event_type = 'WorkflowExecutionFailed' THEN retry_count END AS retry_count,
  CASE WHEN event_type = 'WorkflowExecutionStepCompleted' THEN step_name END AS step_name,
  CASE WHEN event_type = 'WorkflowExecutionStarted' THEN s3_file_info END AS filename
FROM event_store""")
def event_records(v: Inputs) -> DataFrame:
    parsed = V.parse_event_payload(V.event_records(payload_events(v)))
    return parsed.select(
        "id", "workflow_id", "execution_id", at("created_at").alias("created_at"), "event_type",
        "payload.error_type", "payload.retry_count", "payload.step_name",
        F.col("payload.s3_file_info.filename").alias("filename"),
    )


@query("rejected_events", sql="""
SELECT event_id AS id, event_type FROM events WHERE event_type NOT IN ('signup', 'purchase')""")
def rejected_events(v: Inputs) -> DataFrame:
    _, rejected = V.valid_enum(v.events, "event_type", ("signup", "purchase"))
    return rejected.select(F.col("event_id").alias("id"), "event_type")


@query("range_violations", sql="""
SELECT id, execution_time_ms, retry_count FROM event_store WHERE execution_time_ms > 100 OR retry_count < 1""")
def range_violations(v: Inputs) -> DataFrame:
    _, bad = V.valid_ranges(v.event_store, {"execution_time_ms": (0, 100), "retry_count": (1, None)})
    return bad.select("id", "execution_time_ms", "retry_count")


def _resumable_sql(direction: str) -> str:
    return f"""
WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY created_at {direction}, id {direction}) AS rn
  FROM event_store) WHERE rn = 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY created_at, id) AS rn
  FROM event_store WHERE event_type = 'WorkflowExecutionStarted') WHERE rn = 1)
SELECT execution_id, id, event_type FROM d WHERE event_type = 'WorkflowExecutionStarted'
UNION ALL
SELECT s.execution_id, s.id, s.event_type FROM d JOIN s ON s.execution_id = d.execution_id
WHERE d.event_type = 'WorkflowExecutionFailed' AND d.error_type = 'RetryableException'"""


@query("resumable_latest", sql=_resumable_sql("DESC"))
def resumable_latest(v: Inputs) -> DataFrame:
    return V.resumable_executions(v.event_store).select("execution_id", "id", "event_type")


@query("resumable_reference", sql=_resumable_sql("ASC"))
def resumable_reference(v: Inputs) -> DataFrame:
    out = V.resumable_executions(v.event_store, mode="reference")
    return out.select("execution_id", "id", "event_type")


@query("event_stream_summary", sql=f"""
SELECT execution_id, count(*) AS total_events, {sql_at('min(created_at)')} AS first_event_at,
  {sql_at('max(created_at)')} AS last_event_at, arg_min(workflow_id, created_at) AS workflow_id
FROM event_store GROUP BY 1""")
def event_stream_summary(v: Inputs) -> DataFrame:
    out = V.event_stream_summary(v.event_store)
    return out.withColumns({c: at(c) for c in ("first_event_at", "last_event_at")})


@query("events_page", sql=f"""
SELECT id, execution_id, {sql_at('created_at')} AS created_at FROM event_store
ORDER BY event_store.created_at, id LIMIT 50 OFFSET 100""")
def events_page(v: Inputs) -> DataFrame:
    out = V.events_page(v.event_store, limit=50, offset=100)
    return out.select("id", "execution_id", at("created_at").alias("created_at"))


@query("events_of_execution", sql="""
SELECT id, event_type FROM event_store WHERE execution_id = '1-2024-01-01' AND workflow_id = 'wf-1'""")
def events_of_execution(v: Inputs) -> DataFrame:
    return V.events_of(v.event_store, "1-2024-01-01", "wf-1").select("id", "event_type")


@query("execution_status", sql=f"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, id DESC) AS rn
  FROM event_store) WHERE rn = 1)
SELECT l.execution_id, {_STATUS.format('l.event_type')} AS status,
  CASE WHEN l.event_type = 'WorkflowExecutionStarted' THEN l.s3_file_info END AS file_name,
  CASE WHEN l.event_type = 'WorkflowExecutionFailed' THEN l.error_type END AS error_type,
  CASE WHEN l.event_type = 'WorkflowExecutionFailed' THEN l.step_name END AS failed_step,
  CASE WHEN l.event_type = 'WorkflowExecutionCompleted' THEN l.execution_time_ms END AS total_processing_time_ms
FROM l JOIN workflow_rows w ON w.id = l.workflow_id""")
def execution_status(v: Inputs) -> DataFrame:
    from ..plans.jobs import execution_status as job

    out = job(payload_events(v), v.workflows)
    return out.select(
        "execution_id", "status", F.col("started.s3_file_info.file_name").alias("file_name"),
        "failed.error_type", "failed.failed_step", "success.total_processing_time_ms",
    )


@query("unknown_workflows", sql="""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, id DESC) AS rn
  FROM event_store) WHERE rn = 1)
SELECT execution_id, workflow_id FROM l WHERE workflow_id NOT IN (SELECT id FROM workflow_rows)""")
def unknown_workflows(v: Inputs) -> DataFrame:
    _, missing = W.with_workflow(V.last_event(v.event_store), v.workflows)
    return missing.select("execution_id", "workflow_id")


@query("ownership_violations", sql="""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY created_at DESC, id DESC) AS rn
  FROM event_store) WHERE rn = 1)
SELECT execution_id, organization_id FROM l WHERE organization_id <> 2""")
def ownership_violations(v: Inputs) -> DataFrame:
    return V.owned_by(V.last_event(v.event_store), 2, negate=True).select("execution_id", "organization_id")


def _await_sql(wait_seconds: int) -> str:
    return f"""
WITH s AS (SELECT execution_id, id, created_at FROM event_store WHERE event_type = 'WorkflowExecutionStarted'),
m AS (SELECT s.execution_id, s.id AS start_id, e.id AS result_id, e.event_type,
  row_number() OVER (PARTITION BY s.id ORDER BY e.created_at, e.id) AS rn
  FROM s LEFT JOIN event_store e ON e.execution_id = s.execution_id AND e.event_type <> 'WorkflowExecutionStarted'
    AND e.created_at BETWEEN s.created_at AND s.created_at + INTERVAL {wait_seconds} SECOND)
SELECT execution_id, start_id, result_id,
  CASE WHEN result_id IS NULL THEN 'TIMEOUT' ELSE {_STATUS.format('event_type')} END AS status
FROM m WHERE rn = 1"""


@query("await_result", sql=_await_sql(30))
def await_result(v: Inputs) -> DataFrame:
    return V.await_result(v.event_store).select("execution_id", "start_id", "result_id", "status")


@query("await_result_six_hours", sql=_await_sql(21600))
def await_result_six_hours(v: Inputs) -> DataFrame:
    out = V.await_result(v.event_store, timeout_s=21600, cap_s=21600)
    return out.select("execution_id", "start_id", "result_id", "status")


def _due(rules: str) -> str:
    cond = f"anonymization_status = 'PENDING' AND created_at <= TIMESTAMP '{CUTOFF}'"
    clears = {
        "payload": ("s3_file_info", "metadata"),
        "reference": ("metadata",),
    }[rules]
    cols = [
        f"CASE WHEN {cond} AND event_type = 'WorkflowExecutionStarted' THEN NULL ELSE {c} END AS {c}"
        if c in clears else c
        for c in ("s3_file_info", "metadata")
    ]
    return (f"SELECT id, {', '.join(cols)}, CASE WHEN {cond} THEN 'DONE' ELSE anonymization_status END"
            " AS anonymization_status FROM event_store")


@query("retention_redact", sql=_due("payload"))
def retention_redact(v: Inputs) -> DataFrame:
    out = V.redact_events(v.event_store, F.to_timestamp_ntz(F.lit(CUTOFF)))
    return out.select("id", "s3_file_info", "metadata", "anonymization_status")


@query("retention_redact_reference", sql=_due("reference"))
def retention_redact_reference(v: Inputs) -> DataFrame:
    out = V.redact_events(v.event_store, F.to_timestamp_ntz(F.lit(CUTOFF)), rules="reference")
    return out.select("id", "s3_file_info", "metadata", "anonymization_status")


@query("retention_redact_payload", sql=f"""
SELECT id, CASE WHEN event_type = 'WorkflowExecutionStarted' AND NOT due THEN s3_file_info END AS filename,
  CASE WHEN due THEN CASE WHEN id % 29 = 0 THEN 'ERROR' ELSE 'DONE' END ELSE anonymization_status END AS anonymization_status
FROM (SELECT *, anonymization_status = 'PENDING' AND created_at <= TIMESTAMP '{CUTOFF}' AS due FROM event_store)""")
def retention_redact_payload(v: Inputs) -> DataFrame:
    cutoff = F.to_timestamp_ntz(F.lit(CUTOFF))
    due = (F.col("anonymization_status") == "PENDING") & (F.col("created_at") <= cutoff)
    broken = F.when((F.col("id") % 29 == 0) & due, "{oops").otherwise(F.col("event"))
    log = payload_events(v).withColumn("event", broken)
    out = V.redact_events(log, cutoff)
    return out.select("id", F.get_json_object("event", "$.s3_file_info.filename").alias("filename"),
                      "anonymization_status")


@query("pending_before", sql=f"""
SELECT id, execution_id FROM event_store WHERE anonymization_status = 'PENDING' AND created_at <= TIMESTAMP '{CUTOFF}'""")
def pending_before(v: Inputs) -> DataFrame:
    out = V.pending_before(v.event_store, F.to_timestamp_ntz(F.lit(CUTOFF)))
    return out.select("id", "execution_id")


@query("build_events", sql="""
SELECT execution_id, event_type,
  CASE WHEN event_type = 'WorkflowExecutionFailed' THEN error_type END AS error_type,
  CASE WHEN event_type = 'WorkflowExecutionFailed' THEN CASE WHEN retry_count = 1 THEN 0 ELSE retry_count END END AS retry_count,
  CASE WHEN event_type = 'WorkflowExecutionStepCompleted' THEN step_name END AS step_name,
  '1' AS version, 'PENDING' AS anonymization_status
FROM event_store WHERE event_type IN ('WorkflowExecutionFailed', 'WorkflowExecutionStepCompleted')""")
def build_events(v: Inputs) -> DataFrame:
    flat = v.event_store.withColumn("error_message", F.lit("boom"))
    sparse = F.when(F.col("retry_count") != 1, F.col("retry_count"))
    made = sinks.failed_events(
        flat.filter(F.col("event_type") == K.FAILED).withColumn("retry_count", sparse)
    ).unionByName(sinks.step_events(flat.filter(F.col("event_type") == K.STEP_COMPLETED)))
    parsed = V.parse_event_payload(made)
    return parsed.select(
        "execution_id", "event_type", "payload.error_type", "payload.retry_count", "payload.step_name",
        F.get_json_object("event", "$.version").alias("version"), "anonymization_status",
    )


@query("started_events", sql="""
SELECT execution_id, event_type, s3_file_info AS filename, CASE WHEN id % 3 = 0 THEN '{}' ELSE metadata END AS metadata,
  CASE WHEN id % 2 = 0 THEN 'albert-large' END AS extraction_model, '1' AS version, 'PENDING' AS anonymization_status
FROM event_store WHERE event_type = 'WorkflowExecutionStarted'""")
def started_events(v: Inputs) -> DataFrame:
    """Started events with and without metadata and parameters, and the defaults of those without."""
    model = F.struct(F.lit("albert-large").alias("llm_model"), F.lit("cni").alias("document_type"))
    made = sinks.started_events(v.event_store.filter(F.col("event_type") == K.STARTED).withColumns({
        "metadata": F.when(F.col("id") % 3 != 0, F.col("metadata")), "extraction_parameters": F.when(F.col("id") % 2 == 0, model),
    }))
    member = lambda path: F.get_json_object("event", path)
    return made.select(
        "execution_id", "event_type", member("$.s3_file_info").alias("filename"), member("$.metadata").alias("metadata"),
        member("$.extraction_parameters.llm_model").alias("extraction_model"), member("$.version").alias("version"), "anonymization_status",
    )


_ORDINALS = """
SELECT id, api_key, row_number() OVER (PARTITION BY api_key, date_trunc('minute', ts) ORDER BY ts, id) AS minute_count,
  row_number() OVER (PARTITION BY api_key, date_trunc('day', ts) ORDER BY ts, id) AS day_count FROM requests"""


@query("quota_ordinals", sql=_ORDINALS)
def quota_ordinals(v: Inputs) -> DataFrame:
    return Q.request_ordinals(v.requests).select("id", "api_key", "minute_count", "day_count")


def quota_sql(ordinals: str) -> str:
    return f"""
WITH o AS ({ordinals})
SELECT id, api_key, minute_count <= 1 AND day_count <= 20 AS allowed,
  greatest(0, 1 - minute_count) AS remaining_minute, greatest(0, 20 - day_count) AS remaining_day,
  {sql_at("date_trunc('minute', ts) + INTERVAL 1 MINUTE")} AS reset_minute,
  {sql_at("date_trunc('day', ts) + INTERVAL 1 DAY")} AS reset_day FROM o"""


QUOTA_SQL = quota_sql(_ORDINALS.replace("SELECT id, api_key,", "SELECT id, api_key, ts,"))


def shape_verdicts(out: DataFrame) -> DataFrame:
    return out.select("id", "api_key", "allowed", "remaining_minute", "remaining_day",
                      at("reset_minute").alias("reset_minute"), at("reset_day").alias("reset_day"))


@query("quota_verdicts", sql=QUOTA_SQL)
def quota_verdicts(v: Inputs) -> DataFrame:
    return shape_verdicts(Q.usage_quota(v.requests, per_minute=1, per_day=20))


@query("quota_windows", sql=f"""
SELECT api_key, 'minute' AS window_size, {sql_at("date_trunc('minute', ts)")} AS window_start, count(*) AS requests,
  greatest(0, 1 - count(*)) AS remaining, greatest(0, count(*) - 1) AS denied FROM requests GROUP BY api_key, date_trunc('minute', ts)
UNION ALL
SELECT api_key, 'day', {sql_at("date_trunc('day', ts)")}, count(*), greatest(0, 20 - count(*)), greatest(0, count(*) - 20)
FROM requests GROUP BY api_key, date_trunc('day', ts)""")
def quota_windows(v: Inputs) -> DataFrame:
    out = Q.window_usage(v.requests, per_minute=1, per_day=20)
    return out.withColumn("window_start", at("window_start"))
