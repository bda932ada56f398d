"""Streaming jobs replayed over the event file; the SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events as E
from ..session import drop_folder, scratch_dir
from ..sources.streams import read_message_stream
from ..streaming import pipeline as SP
from ..streaming import quota as SQ
from ..streaming import routing as SR
from ..streaming import state as SS
from ..streaming.replay import batch_writer, run_available
from . import event_log, messages
from .registry import query
from .tenants import FANOUT_SQL
from .views import VIEWS, Inputs, at, sql_at


def replay(v: Inputs, stream: DataFrame, **to) -> StreamingQuery:
    """Run a stream to its end, with one state partition per core."""
    return run_available(stream, partitions=v.spark.sparkContext.defaultParallelism, **to)


def final_watermark(ended: StreamingQuery) -> str:
    return ended.lastProgress["eventTime"]["watermark"]


_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(v: Inputs, view: str) -> DataFrame:
    """A derived view over the event file read as a stream."""
    raw = read_message_stream(v.spark, v.sf_dir, _EVENTS, "parquet", glob="events.parquet")
    return v.spark.sql(VIEWS[view].replace("FROM events", "FROM {stream}").replace("'{bad'", "'{{bad'"),
                       stream=raw)


#: Files that a feed arrives in, and seconds that a row may come after its time.
PARTS, DELAY = 8, 3000


def feed(v: Inputs, view: str, time: str, number: str, delay: int = DELAY) -> str:
    """A derived view written as ``PARTS`` files in order of arrival, one after the other.

    A row arrives up to ``delay`` seconds after its time, by its number, so that files overlap
    in time; a file is a stretch of arrival. The stream reads them oldest file first.
    """
    path = scratch_dir(v.spark, "feed")
    rows = v.__getattr__(view)
    staged = scratch_dir(v.spark, "staged")
    arrival = F.unix_micros(F.col(time).cast("timestamp")) + F.pmod(F.col(number) * 7919, F.lit(delay or 1)) * 1_000_000
    ends = rows.agg(F.min(arrival).alias("lo"), F.max(arrival).alias("hi")).first()
    part = F.floor((arrival - F.lit(ends["lo"])) * PARTS / F.lit(ends["hi"] - ends["lo"] + 1))
    # the view is derived by all tasks at once, only the copy into one file per part is not
    rows.withColumn("part", part).write.partitionBy("part").parquet(staged)
    for n in range(PARTS):
        v.spark.read.parquet(staged).filter(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(path)
    drop_folder(v.spark, staged)
    return path


def feed_stream(v: Inputs, view: str, time: str, number: str, slots: int = 1, delay: int = DELAY) -> DataFrame:
    path = feed(v, view, time, number, delay)
    return read_message_stream(v.spark, path, v.spark.read.parquet(path).schema, "parquet", slots=slots)


def part_sql(view: str, time: str, number: str, delay: int = DELAY) -> str:
    """The rows of a view with the number of the file that ``feed`` puts them in."""
    arrival = f"epoch_us({time}) + (({number} * 7919) % {delay or 1}) * 1000000"
    return (f"SELECT *, CAST(floor((arrival - min(arrival) OVER ()) * {PARTS} / (max(arrival) OVER () - min(arrival) OVER () + 1)) AS BIGINT) AS part"
            f" FROM (SELECT *, {arrival} AS arrival FROM {view})")


@query("stream_route", sql=messages.ROUTE_SQL)
def stream_route(v: Inputs) -> DataFrame:
    out = scratch_dir(v.spark, "routes")
    replay(v, event_stream(v, "messages"), each=SR.route_batch(out, "consumer-1", ("k",)))
    return v.spark.read.parquet(out).select("msg_id", "retries", "route", "reason", "next_retries")


@query("stream_quota", sql=f"""
SELECT api_key, {sql_at("date_trunc('minute', ts)")} AS window_start, count(*) AS requests
FROM requests GROUP BY api_key, date_trunc('minute', ts)""")
def stream_quota(v: Inputs) -> DataFrame:
    out = scratch_dir(v.spark, "windows")
    windows = SQ.quota_windows(event_stream(v, "requests"), "1 minute")
    replay(v, windows, mode="update", each=batch_writer(out))
    # Update mode writes a window again when it grows, so the largest count is its state.
    return v.spark.read.parquet(out).groupBy("api_key", at("window_start").alias("window_start")).agg(
        F.max("requests").alias("requests"))


_ARRIVAL = f"""
SELECT id, api_key, ts,
  row_number() OVER (PARTITION BY api_key, date_trunc('minute', ts) ORDER BY part, ts, id) AS minute_count,
  row_number() OVER (PARTITION BY api_key, date_trunc('day', ts) ORDER BY part, ts, id) AS day_count
FROM ({part_sql('requests', 'ts', 'id')})"""


@query("stream_quota_verdicts", sql=event_log.quota_sql(_ARRIVAL))
def stream_quota_verdicts(v: Inputs) -> DataFrame:
    out = scratch_dir(v.spark, "verdicts")
    replay(v, feed_stream(v, "requests", "ts", "id"), each=SQ.verdict_batch(out, 1, 20))
    return event_log.shape_verdicts(v.spark.read.parquet(f"{out}/verdicts"))


@query("stream_status", sql=f"""
SELECT execution_id, arg_max(id, created_at) AS event_id, {sql_at('max(created_at)')} AS updated_at,
  {event_log._STATUS.format('arg_max(event_type, created_at)')} AS status, count(*) AS events
FROM event_store GROUP BY 1""")
def stream_status(v: Inputs) -> DataFrame:
    out = scratch_dir(v.spark, "status")
    states = SS.execution_state(feed_stream(v, "event_store", "created_at", "id"), late_s=DELAY)
    replay(v, states, mode="update", each=SS.status_batch(out, DELAY))
    return SS.status_table(v.spark, out).select(
        "execution_id", "event_id", at("updated_at").alias("updated_at"), "status", "events")


_WAIT = 6 * 3600


@query("stream_await", sql=event_log._await_sql(_WAIT))
def stream_await(v: Inputs) -> DataFrame:
    out = scratch_dir(v.spark, "await")
    waits = SS.await_with_timeout(feed_stream(v, "event_store", "created_at", "id"), _WAIT, _WAIT, late_s=DELAY,
                                  buckets=2 * v.spark.sparkContext.defaultParallelism)
    ended = replay(v, waits, path=out, settings=SS.ROCKSDB)
    answers, behind = SS.split_late(v.spark.read.parquet(out))
    # the waits that are open when the stream ends, and no others, are answered by the batch operator
    deadline = F.col("started_at").cast("timestamp") + F.expr(f"INTERVAL {_WAIT} SECONDS")
    still = E.await_result(v.event_store, timeout_s=_WAIT, cap_s=_WAIT).filter(deadline >= F.lit(final_watermark(ended)).cast("timestamp"))
    names = ["execution_id", "start_id", "result_id", "status"]
    lost = behind.select("execution_id", F.col("event_id").alias("result_id"), F.lit("LATE").alias("status"))
    return answers.select(*names).unionByName(still.select(*names)).unionByName(lost, allowMissingColumns=True)


@query("bounded_intake", sql=f"""
SELECT part // 3 AS batch_id, count(DISTINCT part) AS files, count(*) AS messages, min(msg_id) AS first_id, max(msg_id) AS last_id
FROM ({part_sql('messages', 'delivered_at', 'msg_id')}) GROUP BY 1""")
def bounded_intake(v: Inputs) -> DataFrame:
    """A backlog of files taken three at a time, whatever has piled up."""
    out = scratch_dir(v.spark, "intake")
    backlog = feed_stream(v, "messages", "delivered_at", "msg_id", slots=3)
    replay(v, backlog.select("msg_id", F.col("_metadata.file_path").alias("file")), each=batch_writer(out))
    return v.spark.read.parquet(out).groupBy(F.col("batch_id").cast("bigint").alias("batch_id")).agg(
        F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("messages"),
        F.min("msg_id").alias("first_id"), F.max("msg_id").alias("last_id"),
    )


@query("stream_notify", sql=FANOUT_SQL)
def stream_notify(v: Inputs) -> DataFrame:
    ended = event_stream(v, "event_store").filter(
        F.col("event_type").isin("WorkflowExecutionCompleted", "WorkflowExecutionFailed"))
    results = ended.select("id", "execution_id", "organization_id", "error_type",
                           (F.col("retry_count") >= 2).alias("is_last_retry"))
    out = scratch_dir(v.spark, "notify")
    replay(v, SR.notify_finished(results, v.webhooks), path=out)
    return v.spark.read.parquet(out).select("id", "execution_id", "webhook_id", "url")


@query("stream_reclaim", sql=f"""
WITH w AS (SELECT max(delivered_at) AS newest FROM messages)
SELECT CAST(msg_id AS VARCHAR) AS msg_id,
  CASE WHEN NOT over THEN 'open' WHEN retries + 1 > 3 THEN 'dlq' ELSE 'requeue' END AS route,
  CASE WHEN over AND retries + 1 > 3 THEN 'max_retries_exceeded' END AS reason,
  CASE WHEN over AND retries + 1 <= 3 THEN retries + 1 END AS next_retries
FROM (SELECT *, epoch_ms(delivered_at) + 300001 < epoch_ms(w.newest) - 600000 AS over FROM messages, w) WHERE outcome <> 'success'""")
def stream_reclaim(v: Inputs) -> DataFrame:
    seen = event_stream(v, "messages")
    deliveries = seen.select(
        "msg_id", F.col("delivered_at").alias("at"),
        F.when(F.col("outcome") == "success", "acked").otherwise("delivered").alias("kind"),
        "retries", "data",
    )
    out = scratch_dir(v.spark, "reclaim")
    replay(v, SS.reclaim_stream(deliveries, late_s=600), path=out, settings=SS.ROCKSDB)
    done = v.spark.read.parquet(out).select("msg_id", "route", "reason", "next_retries")
    # messages neither acknowledged nor idle for long enough when the stream ends
    waiting = v.messages.filter("outcome <> 'success'").select(F.col("msg_id").cast("string").alias("msg_id"))
    still = waiting.join(done.select("msg_id"), "msg_id", "left_anti").withColumn("route", F.lit("open"))
    return done.unionByName(still, allowMissingColumns=True)


@query("stream_trim", sql="SELECT msg_id FROM messages ORDER BY delivered_at DESC, msg_id DESC LIMIT 1000")
def stream_trim(v: Inputs) -> DataFrame:
    out = scratch_dir(v.spark, "trim")
    replay(v, event_stream(v, "messages"), each=SR.trim_batch(out))
    versions = v.spark.read.parquet(out)
    newest = versions.agg(F.max("version")).scalar()
    return versions.filter(F.col("version") == newest).select("msg_id")


def pipeline_messages(v: Inputs) -> DataFrame:
    """Every event as a message that asks to run its execution; some are unreadable."""
    e = event_stream(v, "event_store")
    request = F.to_json(F.struct(F.col("execution_id").alias("workflow_execution_id")))
    return e.select(
        F.col("id").alias("msg_id"),
        F.when(F.col("id") % 17 == 0, "{bad").otherwise(request).alias("data"),
        F.col("retry_count").alias("retries"),
    )


def step_runner():
    class RetryableException(Exception):
        pass

    def run(row: dict) -> dict:
        if row["id"] % 5 == 0:
            raise RetryableException("later")
        if row["id"] % 5 == 1:
            raise ValueError("broken")
        return {"total_processing_time_ms": 5.0, "properties": [{"name": "steps", "value": len(row["steps"])}]}

    return run


_PIPELINE = f"""
WITH todo AS ({event_log._resumable_sql('DESC')}),
m AS (SELECT e.id AS msg_id, e.retry_count AS retries, e.organization_id, t.id AS start_id, w.id AS workflow_id,
  CASE WHEN e.id % 17 = 0 THEN 'bad' WHEN t.id IS NULL THEN 'NoEventAttachedToExecutionException'
    WHEN w.id IS NULL THEN 'WorkflowNotFoundException' WHEN t.id % 5 = 0 THEN 'RetryableException'
    WHEN t.id % 5 = 1 THEN 'ValueError' ELSE 'none' END AS what
  FROM event_store e LEFT JOIN todo t ON t.execution_id = e.execution_id
  LEFT JOIN event_store s ON s.id = t.id LEFT JOIN workflow_rows w ON w.id = s.workflow_id),
r AS (SELECT *, CASE WHEN what = 'bad' THEN 'dlq' WHEN what = 'none' THEN 'ack'
    WHEN what = 'RetryableException' AND retries < 2 THEN 'requeue' ELSE 'dlq' END AS route,
  CASE WHEN what = 'bad' THEN 'decode_error' WHEN what = 'none' THEN NULL WHEN what = 'RetryableException' AND retries < 2 THEN NULL
    WHEN what = 'RetryableException' THEN 'max_retries_exceeded' ELSE 'not_retryable_error' END AS reason FROM m)
"""


@query("stream_pipeline", sql=_PIPELINE + """
SELECT r.msg_id, r.route, r.reason,
  CASE WHEN r.what = 'none' THEN 'WorkflowExecutionCompleted' WHEN r.workflow_id IS NOT NULL AND r.what <> 'bad' THEN 'WorkflowExecutionFailed' END AS emitted,
  CASE WHEN r.what = 'bad' OR r.start_id IS NULL OR r.route = 'requeue' THEN 0 ELSE
    (SELECT count(*) FROM webhooks h WHERE h.organization_id = r.organization_id) END AS notifications
FROM r""")
def stream_pipeline(v: Inputs) -> DataFrame:
    out = scratch_dir(v.spark, "pipeline")
    run = SP.pipeline_batch(out, lambda: v.event_store, v.workflows, v.webhooks, step_runner(), "worker-1")
    replay(v, pipeline_messages(v), each=run)
    read = v.spark.read.parquet
    emitted = read(f"{out}/events").select(F.col("msg_id").alias("m1"), F.col("event_type").alias("emitted"))
    sent = read(f"{out}/notifications").groupBy(F.col("msg_id").alias("m2")).agg(F.count(F.lit(1)).alias("n"))
    routes = read(f"{out}/routes")
    return (
        routes.join(emitted, routes["msg_id"] == emitted["m1"], "left")
        .join(sent, routes["msg_id"] == sent["m2"], "left")
        .select("msg_id", "route", "reason", "emitted", F.coalesce("n", F.lit(0)).alias("notifications"))
    )
