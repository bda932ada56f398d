"""OCR pages, prompts, barcodes, logs and completed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import logs as L
from ..operators import pages as P
from ..operators import prompts as R
from ..operators.slices import header_and_items
from .registry import query
from .views import Inputs, at, r6, sql_at


@query("user_prompts", sql="""
SELECT execution_id, 0 AS chunk, string_agg(coalesce(text, 'None') || chr(10) || chr(10), '' ORDER BY page_number) AS user_prompt
FROM ocr_pages GROUP BY 1""")
def user_prompts(v: Inputs) -> DataFrame:
    return P.assemble_user_prompt(v.ocr_pages)


@query("page_concat", sql="""
SELECT execution_id, 0 AS chunk, string_agg('Page : ' || page_number || ' ' || chr(10) || ' ' || text || ' ' || chr(10), '' ORDER BY page_number) AS content
FROM ocr_pages GROUP BY 1""")
def page_concat(v: Inputs) -> DataFrame:
    return P.page_concat(v.ocr_pages)


_KEYED = """k AS (SELECT *, CASE type WHEN 'QR' THEN 'qr:' ELSE 'dm:' END || raw_data AS key FROM {src})"""
_FIRST = """SELECT doc_id, page_number, key, pass, pos, tie FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, key ORDER BY pass, pos, tie, type, raw_data) AS rn FROM k) WHERE rn = 1"""


@query("barcode_dedupe", sql=f"WITH {_KEYED.format(src='barcodes')} {_FIRST}")
def barcode_dedupe(v: Inputs) -> DataFrame:
    return P.dedupe_barcodes(v.barcodes).select("doc_id", "page_number", "key", "pass", "pos", "tie")


_SECOND = """s AS (SELECT DISTINCT doc_id, page_number FROM barcodes WHERE pass = 1 AND type = '2D_DOC'),
u AS (SELECT * FROM barcodes WHERE pass = 1 UNION ALL SELECT b.* FROM barcodes b ANTI JOIN s
  ON s.doc_id = b.doc_id AND s.page_number = b.page_number WHERE b.pass = 2)"""


@query("barcode_second_pass", sql=f"WITH {_SECOND}, {_KEYED.format(src='u')} {_FIRST}")
def barcode_second_pass(v: Inputs) -> DataFrame:
    return P.merged_passes(v.barcodes).select("doc_id", "page_number", "key", "pass", "pos", "tie")


@query("pages_to_rescan", sql="""
SELECT DISTINCT doc_id, page_number FROM barcodes b ANTI JOIN
  (SELECT DISTINCT doc_id, page_number FROM barcodes WHERE pass = 1 AND type = '2D_DOC') s
  ON s.doc_id = b.doc_id AND s.page_number = b.page_number""")
def pages_to_rescan(v: Inputs) -> DataFrame:
    pages = v.barcodes.select("doc_id", "page_number").distinct()
    return P.needs_second_pass(pages, v.barcodes)


@query("barcode_flatten", sql="""
SELECT doc_id, 0 AS chunk, string_agg(page_number || '/' || pass || '/' || pos || '/' || raw_data, ',' ORDER BY page_number, pass, pos, type, raw_data) AS codes
FROM barcodes GROUP BY 1""")
def barcode_flatten(v: Inputs) -> DataFrame:
    flat = P.flatten_barcodes(v.barcodes)
    text = F.transform("barcodes", lambda b: F.concat_ws(
        "/", b["page_number"].cast("string"), b["pass"].cast("string"), b["pos"].cast("string"), b["raw_data"]))
    return flat.select("doc_id", "chunk", F.array_join(text, ",").alias("codes"))


def hour(column: str) -> Column:
    return F.date_trunc("hour", column)


def _prompts(v: Inputs) -> DataFrame:
    return v.event_store.select(
        "id", F.col("created_at").alias("ts"), F.col("workflow_id").alias("document_type"),
        F.concat(F.lit("prompt-"), (F.col("retry_count") % 2).cast("string")).alias("prompt"),
    )


@query("prompt_changes", sql=f"""
WITH p AS (SELECT id, created_at AS ts, workflow_id AS document_type, 'prompt-' || (retry_count % 2) AS prompt FROM event_store),
q AS (SELECT *, lag(prompt) OVER (PARTITION BY document_type ORDER BY ts, id) AS previous_prompt FROM p)
SELECT id, {sql_at('ts')} AS ts, document_type, prompt, previous_prompt FROM q WHERE prompt IS DISTINCT FROM previous_prompt""")
def prompt_changes(v: Inputs) -> DataFrame:
    return R.prompt_changes(_prompts(v), hour("ts")).withColumn("ts", at("ts"))


def _runs(v: Inputs) -> DataFrame:
    return v.event_store.select(
        (F.col("id") % 500).alias("task_id"),
        F.when(F.col("id") % 11 != 0, F.col("execution_id")).alias("execution_id"),
        "workflow_id", F.col("created_at").alias("updated_at"),
        F.col("organization_id").alias("project_id"),
        F.when(F.col("id") % 2 == 0, "cni").alias("document_type"),
    )


_LATEST = """r AS (SELECT id % 500 AS task_id, execution_id, workflow_id, created_at AS updated_at, organization_id AS project_id,
  CASE WHEN id % 2 = 0 THEN 'cni' END AS document_type FROM event_store WHERE id % 11 <> 0),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY updated_at DESC, execution_id DESC) AS rn FROM r) WHERE rn = 1)"""


@query("latest_inference", sql=f"""WITH {_LATEST}
SELECT task_id, execution_id, workflow_id, {sql_at('updated_at')} AS updated_at, project_id FROM latest""")
def latest_inference(v: Inputs) -> DataFrame:
    return R.latest_inference(_runs(v)).select(
        "task_id", "execution_id", "workflow_id", at("updated_at").alias("updated_at"), "project_id")


@query("inference_files", sql=f"""WITH {_LATEST}
SELECT l.task_id, l.execution_id, t.pdf AS file_ref,
  CASE WHEN t.pdf IS NULL THEN 'unknown' ELSE regexp_extract(t.pdf, '([^/]*)$', 1) END AS filename
FROM latest l LEFT JOIN task_flags t ON t.task_id = l.task_id""")
def inference_files(v: Inputs) -> DataFrame:
    out = R.inference_to_task(R.latest_inference(_runs(v)), v.label_tasks)
    return out.select("task_id", "execution_id", "file_ref", "filename")


def _replays(v: Inputs) -> DataFrame:
    return v.event_store.filter(F.col("event_type") == K.STARTED).groupBy("execution_id").agg(
        F.lit("passeport").alias("document_type"), F.lit("albert-large").alias("model"),
        F.min("metadata").alias("system_prompt"), F.lit("user").alias("user_prompt"),
    )


_REPLAY = "p AS (SELECT execution_id, min(metadata) AS system_prompt FROM event_store WHERE event_type = 'WorkflowExecutionStarted' GROUP BY 1)"


@query("inference_replay", sql=f"""WITH {_LATEST}, {_REPLAY}
SELECT l.task_id, l.execution_id, 'passeport' AS document_type, p.system_prompt FROM latest l JOIN p ON p.execution_id = l.execution_id""")
def inference_replay(v: Inputs) -> DataFrame:
    found, _ = R.inference_with_replay(R.latest_inference(_runs(v)), _replays(v))
    return found.select("task_id", "execution_id", "document_type", "system_prompt")


@query("inference_replay_missing", sql=f"""WITH {_LATEST}, {_REPLAY}
SELECT l.task_id, l.execution_id FROM latest l WHERE l.execution_id NOT IN (SELECT execution_id FROM p)""")
def inference_replay_missing(v: Inputs) -> DataFrame:
    _, missing = R.inference_with_replay(R.latest_inference(_runs(v)), _replays(v))
    return missing.select("task_id", "execution_id")


@query("sorted_entries", sql=f"""WITH {_LATEST}
SELECT task_id, execution_id FROM latest WHERE project_id = 1 ORDER BY updated_at DESC, task_id""")
def sorted_entries(v: Inputs) -> DataFrame:
    return R.sorted_entries(R.latest_inference(_runs(v)), 1).select("task_id", "execution_id")


@query("execution_log", sql=f"""
WITH h AS (SELECT execution_id, arg_min(workflow_id, created_at) AS workflow_id, min(created_at) AS s, max(created_at) AS f,
  arg_max(event_type, created_at) AS last_type,
  coalesce(max(retry_count) FILTER (WHERE event_type = 'WorkflowExecutionFailed'), 0) AS retry_count,
  arg_max(error_type, created_at) FILTER (WHERE event_type = 'WorkflowExecutionFailed') AS error_type,
  arg_max(step_name, created_at) FILTER (WHERE event_type = 'WorkflowExecutionFailed') AS failed_step,
  count(*) AS log_lines FROM event_store GROUP BY 1)
SELECT execution_id, workflow_id, CASE WHEN last_type = 'WorkflowExecutionFailed' THEN 'failed' ELSE 'succeeded' END AS status, retry_count,
  CAST(floor((epoch_us(f) - epoch_us(s)) / 1000) AS BIGINT) AS elapsed_time_ms,
  CASE WHEN last_type = 'WorkflowExecutionFailed' THEN error_type END AS error_type,
  CASE WHEN last_type = 'WorkflowExecutionFailed' THEN failed_step END AS failed_step, log_lines FROM h""")
def execution_log(v: Inputs) -> DataFrame:
    return L.execution_log(v.event_store).select(
        "execution_id", "workflow_id", "status", "retry_count", "elapsed_time_ms", "error_type", "failed_step", "log_lines")


@query("execution_log_lines", sql=f"""
SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY created_at, id) AS position,
  {sql_at('created_at')} AS created_at, event_type, step_name FROM event_store""")
def execution_log_lines(v: Inputs) -> DataFrame:
    out = L.execution_log_lines(v.event_store, hour("created_at"))
    return out.withColumns({"created_at": at("created_at"), "position": F.col("position").cast("bigint")})


@query("request_log", sql=f"""
WITH l AS (SELECT conv_id AS request_id, turn AS id, TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INT)) AS ts, role, text FROM conversations)
SELECT request_id, arg_min(role, id) AS method, 200 + max(id) AS status_code,
  CAST((max(id) - min(id)) * 60000 AS BIGINT) AS elapsed_ms, count(*) AS log_lines FROM l GROUP BY 1""")
def request_log(v: Inputs) -> DataFrame:
    return L.request_log(_request_lines(v)).select("request_id", "method", "status_code", "elapsed_ms", "log_lines")


@query("request_log_lines", sql="""
SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, turn || ':' || length(text) AS message
FROM conversations""")
def request_log_lines(v: Inputs) -> DataFrame:
    out = L.request_log_lines(_request_lines(v), hour("ts"))
    return out.select("request_id", F.col("position").cast("bigint").alias("position"), "message")


def _request_lines(v: Inputs) -> DataFrame:
    return v.conversations.select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("turn") * 60).alias("ts"),
        F.col("role").alias("method"), F.lit("/v1").alias("path"),
        F.lit(1).alias("organization_id"), (200 + F.col("turn")).alias("status_code"),
        F.concat_ws(":", F.col("turn").cast("string"), F.length("text").cast("string")).alias("message"),
    )


def _completed(v: Inputs) -> DataFrame:
    """Completed executions with their step metadata as they are stored."""
    step = F.struct(
        F.col("step_name"), (F.col("execution_time_ms") / 1000).alias("execution_time"),
        F.col("retry_count").cast("bigint").alias("request_tokens"),
        (F.col("retry_count") + 1).cast("bigint").alias("response_tokens"),
    )
    ocr = F.struct(F.lit("ocr").alias("step_name"), F.lit(1.0).alias("execution_time"),
                   F.lit(None).cast("bigint").alias("request_tokens"),
                   F.lit(None).cast("bigint").alias("response_tokens"))
    return v.event_store.filter(F.col("event_type") == K.COMPLETED).select(
        F.concat_ws("-", "execution_id", F.col("id").cast("string")).alias("execution_id"),
        F.array(ocr, step).alias("workflow_metadata"),
    )


@query("step_facts", sql="""
SELECT execution_id || '-' || id AS execution_id, p.position, CASE p.position WHEN 0 THEN 'ocr' ELSE step_name END AS step_name,
  round(CASE p.position WHEN 0 THEN 1.0 ELSE execution_time_ms / 1000.0 END, 6)::DOUBLE AS execution_time,
  CASE p.position WHEN 1 THEN CAST(retry_count AS BIGINT) END AS request_tokens
FROM event_store JOIN (SELECT CAST(0 AS INT) AS position UNION ALL SELECT 1) p ON event_type = 'WorkflowExecutionCompleted'""")
def step_facts(v: Inputs) -> DataFrame:
    out = L.step_facts(_completed(v))
    return out.select("execution_id", "position", "step_name",
                      r6("execution_time").alias("execution_time"), "request_tokens")


@query("step_lists", sql="""
SELECT execution_id || '-' || id AS execution_id, 0 AS chunk, 'ocr,' || step_name AS steps
FROM event_store WHERE event_type = 'WorkflowExecutionCompleted'""")
def step_lists(v: Inputs) -> DataFrame:
    facts = L.step_facts(_completed(v))
    out = L.collect_step_metadata(facts, F.floor(F.col("position") / 1000))
    names = F.transform("workflow_metadata", lambda m: m["step_name"])
    return out.select("execution_id", "chunk", F.array_join(names, ",").alias("steps"))


@query("completed_results", sql="""
WITH x AS (SELECT execution_id, min(created_at) AS s, max(created_at) AS f FROM event_store GROUP BY 1),
c AS (SELECT execution_id, arg_min(step_name, created_at) AS document_type FROM event_store WHERE event_type = 'WorkflowExecutionStarted' GROUP BY 1),
e AS (SELECT execution_id, arg_min(metadata, created_at) AS properties FROM event_store WHERE event_type = 'WorkflowExecutionCompleted' GROUP BY 1),
b AS (SELECT execution_id, count(*) AS n FROM event_store WHERE event_type = 'WorkflowExecutionFailed' GROUP BY 1),
n AS (SELECT execution_id, count(*) AS steps_executed FROM event_store WHERE event_type = 'WorkflowExecutionStepCompleted' GROUP BY 1)
SELECT x.execution_id, c.document_type, e.properties, b.n AS barcodes,
  CAST(floor((epoch_us(x.f) - epoch_us(x.s)) / 1000) AS BIGINT) AS total_processing_time_ms,
  coalesce(n.steps_executed, 0) + 1 AS steps_completed
FROM x LEFT JOIN c ON c.execution_id = x.execution_id LEFT JOIN e ON e.execution_id = x.execution_id
LEFT JOIN b ON b.execution_id = x.execution_id LEFT JOIN n ON n.execution_id = x.execution_id""")
def completed_results(v: Inputs) -> DataFrame:
    e = v.event_store
    order = F.struct("created_at", "id")

    def of(kind: str) -> DataFrame:
        return e.filter(F.col("event_type") == kind).groupBy("execution_id")

    out = L.completed_results(
        e.groupBy("execution_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at")),
        of(K.STARTED).agg(F.min_by("step_name", order).alias("document_type")),
        of(K.COMPLETED).agg(F.min_by("metadata", order).alias("properties")),
        of(K.FAILED).agg(F.count(F.lit(1)).alias("barcodes")),
        of(K.STEP_COMPLETED).agg(F.count(F.lit(1)).alias("steps_executed")),
    )
    return out.select("execution_id", "document_type", "properties", "barcodes",
                      "total_processing_time_ms", "steps_completed")


_PARTS = """
WITH p AS (SELECT execution_id, page_number, {0} AS part FROM ocr_pages)
SELECT execution_id, count(*) OVER w AS items, CAST(sum(length(part)) OVER w AS BIGINT) AS chars, page_number, part,
  row_number() OVER (PARTITION BY execution_id ORDER BY page_number, part) AS position
FROM p WINDOW w AS (PARTITION BY execution_id)"""


@query("user_prompt_parts", sql=_PARTS.format("coalesce(text, 'None') || chr(10) || chr(10)"))
def user_prompt_parts(v: Inputs) -> DataFrame:
    header, items = P.prompt_parts(v.ocr_pages)
    return items.join(header, "execution_id")


@query("page_concat_parts", sql=_PARTS.format("'Page : ' || page_number || ' ' || chr(10) || ' ' || coalesce(text, 'None') || ' ' || chr(10)"))
def page_concat_parts(v: Inputs) -> DataFrame:
    header, items = P.page_concat_parts(v.ocr_pages)
    return items.join(header, "execution_id")


@query("barcode_items", sql="""
SELECT doc_id, count(*) OVER w AS items, max(page_number) OVER w AS last_page, page_number, pass, pos, type, raw_data,
  row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pass, pos, type, raw_data) AS position
FROM barcodes WINDOW w AS (PARTITION BY doc_id)""")
def barcode_items(v: Inputs) -> DataFrame:
    header, items = P.barcode_items(v.barcodes)
    return items.join(header, "doc_id")


@query("step_items", sql="""
SELECT execution_id || '-' || id AS execution_id, CAST(2 AS BIGINT) AS items, round(1.0 + execution_time_ms / 1000.0, 6)::DOUBLE AS execution_time,
  p.position, CASE p.position WHEN 1 THEN 'ocr' ELSE step_name END AS step_name
FROM event_store JOIN (SELECT CAST(1 AS BIGINT) AS position UNION ALL SELECT 2) p ON event_type = 'WorkflowExecutionCompleted'""")
def step_items(v: Inputs) -> DataFrame:
    header, items = L.step_items(L.step_facts(_completed(v)), F.floor(F.col("step") / 1000))
    return items.select("execution_id", "position", "step_name").join(header, "execution_id").withColumn("execution_time", r6("execution_time"))


_OF = "SELECT execution_id, id, {0}, row_number() OVER (PARTITION BY execution_id ORDER BY created_at, id) AS position FROM event_store WHERE event_type = '{1}'"


@query("result_lists", sql=f"""
WITH c AS ({_OF.format("error_type || '/' || retry_count AS t", K.FAILED)}), s AS ({_OF.format("step_name || '/' || execution_time_ms AS t", K.STEP_COMPLETED)}),
b AS (SELECT execution_id, string_agg(t, ',' ORDER BY position) AS barcodes, count(*) AS n FROM c GROUP BY 1),
m AS (SELECT execution_id, string_agg(t, ',' ORDER BY position) AS workflow_metadata, count(*) AS n FROM s GROUP BY 1)
SELECT x.execution_id, b.barcodes, m.workflow_metadata, coalesce(m.n, 0) + 1 AS steps_completed,
  CAST(floor((epoch_us(x.f) - epoch_us(x.s)) / 1000) AS BIGINT) AS total_processing_time_ms
FROM (SELECT execution_id, min(created_at) AS s, max(created_at) AS f FROM event_store GROUP BY 1) x
LEFT JOIN b ON b.execution_id = x.execution_id LEFT JOIN m ON m.execution_id = x.execution_id""")
def result_lists(v: Inputs) -> DataFrame:
    """Final records with their lists of codes (here: failures) and steps."""
    e = v.event_store

    def of(kind: str, *columns: str) -> DataFrame:
        rows = e.filter(F.col("event_type") == kind)
        _, items = header_and_items(rows, ["execution_id"], [F.col("created_at"), F.col("id")], F.date_trunc("hour", "created_at"))
        return items.select("execution_id", "position", *columns)

    lists = L.result_lists(of(K.FAILED, "error_type", "retry_count"), of(K.STEP_COMPLETED, "step_name", "execution_time_ms"))
    counted = lists.withColumn("steps_executed", F.coalesce(F.size("workflow_metadata"), F.lit(0)))
    spans = e.groupBy("execution_id").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("finished_at"))
    none = lists.select("execution_id")
    out = L.completed_results(spans, none, none, none, counted)
    text = lambda name, *members: F.array_join(F.transform(name, lambda x: F.concat_ws("/", *[x[m].cast("string") for m in members])), ",")
    return out.select(
        "execution_id", text("barcodes", "error_type", "retry_count").alias("barcodes"),
        text("workflow_metadata", "step_name", "execution_time_ms").alias("workflow_metadata"),
        F.col("steps_completed").cast("bigint").alias("steps_completed"), "total_processing_time_ms",
    )
