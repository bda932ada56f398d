"""What the sinks write, read back by the sources and compared value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels
from ..operators import evaluation as E
from ..operators import files as O
from ..operators import logs as L
from ..operators import prompts as R
from ..plans import jobs
from ..session import scratch_dir
from ..sources import sinks as S
from ..sources import tables as T
from . import event_log, pages_and_logs
from .evaluation import _OBS
from .registry import query
from .views import Inputs, at, r6, sql_at


def _log(v: Inputs, purpose: str) -> str:
    """The event view appended to a log, as two appends."""
    path = scratch_dir(v.spark, purpose)
    events = event_log.payload_events(v).withColumns({
        "created_at": F.col("created_at").cast("timestamp"),
        "id": F.col("id").cast("string"), "organization_id": F.col("organization_id").cast("string"),
    })
    for part in (0, 1):
        S.append_events(events.filter(F.col("id").cast("bigint") % 2 == part), path)
    return path


_EVENT = """CAST(id AS VARCHAR) AS id, workflow_id, execution_id, CAST(organization_id AS VARCHAR) AS organization_id, event_type"""


@query("stored_events", sql=f"""
SELECT {_EVENT}, {sql_at('created_at')} AS created_at, anonymization_status,
  CASE WHEN event_type = 'WorkflowExecutionFailed' THEN error_type END AS error_type,
  CASE WHEN event_type = 'WorkflowExecutionStarted' THEN s3_file_info END AS filename FROM event_store""")
def stored_events(v: Inputs) -> DataFrame:
    back = T.scan_event_store(v.spark, _log(v, "log"))
    return back.select(
        "id", "workflow_id", "execution_id", "organization_id", "event_type", at("created_at").alias("created_at"), "anonymization_status",
        F.get_json_object("event", "$.error_type").alias("error_type"),
        F.get_json_object("event", "$.s3_file_info.filename").alias("filename"),
    )


@query("stored_retention", sql=f"""
SELECT {_EVENT}, CASE WHEN event_type = 'WorkflowExecutionStarted' AND NOT due THEN s3_file_info END AS filename,
  CASE WHEN event_type = 'WorkflowExecutionStepCompleted' THEN step_name END AS step_name,
  CASE WHEN due THEN 'DONE' ELSE anonymization_status END AS anonymization_status
FROM (SELECT *, anonymization_status = 'PENDING' AND created_at <= TIMESTAMP '2024-01-20' AS due FROM event_store)""")
def stored_retention(v: Inputs) -> DataFrame:
    path = _log(v, "retention-log")
    jobs.retention(v.spark, path, F.lit("2024-01-27").cast("timestamp"))
    back = T.scan_event_store(v.spark, path)
    return back.select(
        "id", "workflow_id", "execution_id", "organization_id", "event_type",
        F.get_json_object("event", "$.s3_file_info.filename").alias("filename"),
        F.get_json_object("event", "$.step_name").alias("step_name"), "anonymization_status",
    )


_TASK_VALUES = """
SELECT '{0}' AS sink, lp.task_id, t.project, t.pdf, t.document_type, lp.prediction_id, lp.model_version, lp.field, lp.predicted AS value
FROM label_pairs lp JOIN task_flags t ON t.task_id = lp.task_id
WHERE t.has_predictions AND lp.predicted IS NOT NULL"""


@query("stored_tasks", sql=_TASK_VALUES.format("pages") + " UNION ALL " + _TASK_VALUES.format("dataset"))
def stored_tasks(v: Inputs) -> DataFrame:
    """Tasks exported as two pages and read as one scan, and tasks of a written dataset."""
    root = scratch_dir(v.spark, "tasks")
    for part in (0, 1):
        S.export_tasks(v.label_tasks.filter(F.col("id") % 2 == part), f"{root}/export/page-{part}")
    S.write_dataset(v.label_tasks, f"{root}/dataset")
    sinks = {"pages": f"{root}/export/*", "dataset": f"{root}/dataset/tasks"}
    parts = []
    for sink, path in sinks.items():
        p = F.explode("predictions").alias("p")
        rows = T.scan_label_tasks(v.spark, path).select(
            F.lit(sink).alias("sink"), F.col("id").alias("task_id"), "project", "data.pdf", "data.document_type", p)
        parts.append(rows.select(
            "sink", "task_id", "project", "pdf", "document_type", F.col("p.id").alias("prediction_id"), "p.model_version",
            F.explode(labels.results_to_map("p.result")).alias("field", "value"),
        ))
    return parts[0].unionByName(parts[1])


@query("stored_annotations", sql="""
SELECT DISTINCT lp.task_id, lp.field, lp.expected AS value FROM label_pairs lp JOIN task_flags t ON t.task_id = lp.task_id
WHERE t.has_truth""")
def stored_annotations(v: Inputs) -> DataFrame:
    root = scratch_dir(v.spark, "annotations")
    S.write_dataset(v.label_tasks, root)
    tasks = T.scan_label_tasks(v.spark, f"{root}/tasks").withColumn("truth", labels.first_ground_truth("annotations"))
    return tasks.filter(F.col("truth").isNotNull()).select(
        F.col("id").alias("task_id"), F.explode(labels.results_to_map("truth")).alias("field", "value"))


def _save(v: Inputs, purpose: str) -> str:
    path = scratch_dir(v.spark, purpose)
    observed = v.observations.withColumn("observation", F.to_json(F.struct("error")))
    S.save_experiment(observed, path, "run-1", 7, K.FIELD_METRIC_NAME, notes="first")
    return path


@query("stored_observations", sql="""
SELECT 'run-1' AS experiment_id, task_id, CAST(prediction_id AS BIGINT) AS prediction_id, model_version, round(score, 6) AS score, processing_time_ms, error
FROM observations""")
def stored_observations(v: Inputs) -> DataFrame:
    back = T.scan_observations(v.spark, f"{_save(v, 'observed')}/observations")
    return back.select("experiment_id", "task_id", "prediction_id", "model_version", r6("score").alias("score"), "processing_time_ms",
                       F.get_json_object("metric_results", "$.error").alias("error"))


@query("stored_experiment", sql="""
WITH h AS (SELECT count(DISTINCT task_id)::INT AS n, round(avg(score), 6) AS average_score FROM observations),
m AS (SELECT model_version, round(avg(processing_time_ms), 6) AS mean_ms, count(*) AS samples FROM observations
  WHERE processing_time_ms IS NOT NULL GROUP BY 1)
SELECT 'run-1' AS id, CAST(7 AS BIGINT) AS label_project_id, n AS total_tasks, n AS processed_count, average_score, 'completed' AS status,
  'first' AS notes, model_version, mean_ms, samples FROM h, m""")
def stored_experiment(v: Inputs) -> DataFrame:
    back = T.scan_experiments(v.spark, f"{_save(v, 'experiment')}/experiments")
    stats = F.from_json("model_version_stats", "map<string,struct<mean_processing_time_ms:double,sample_count:bigint>>")
    return back.select(
        "id", "label_project_id", "total_tasks", "processed_count", r6("average_score").alias("average_score"), "status", "notes",
        F.explode(stats).alias("model_version", "s"),
    ).select("*", r6("s.mean_processing_time_ms").alias("mean_ms"), F.col("s.sample_count").alias("samples")).drop("s")


@query("experiment_history_pages", sql="""
WITH r AS (SELECT 'run-' || (task_id % 5) AS id, task_id % 5 AS n, task_id, score FROM observations),
s AS (SELECT id, n, count(DISTINCT task_id)::INT AS processed_count, count(DISTINCT task_id)::INT AS total_tasks,
  round(avg(score), 6) AS average_score, count(*) AS observation_count FROM r GROUP BY ALL),
l AS (SELECT 'project 1' AS listing, * FROM s WHERE n % 2 = 1
  UNION ALL SELECT 'metric b', * FROM s WHERE n >= 3
  UNION ALL SELECT 'page', * FROM (SELECT * FROM s ORDER BY n DESC LIMIT 2 OFFSET 1)
  UNION ALL SELECT 'none', * FROM s WHERE n > 5)
SELECT listing, id, processed_count, total_tasks, average_score, observation_count FROM l""")
def experiment_history_pages(v: Inputs) -> DataFrame:
    """Five runs of two projects and two metrics, saved one after the other, then listed."""
    path = scratch_dir(v.spark, "history")
    observed = v.observations.withColumn("observation", F.to_json(F.struct("error")))
    for n in range(5):
        run = {"experiment_id": f"run-{n}", "project_id": n % 2, "metric_name": "b" if n >= 3 else "a"}
        S.save_experiment(observed.filter(F.col("task_id") % 5 == n), path, **run)
    asked = {"project 1": {"project_id": 1}, "metric b": {"metric_name": "b"}, "page": {"limit": 2, "offset": 1},
             "none": {"project_id": 1, "metric_name": "c"}}
    lists = [
        jobs.experiment_history(None, path, v.spark, **given).select(
            F.lit(name).alias("listing"), "id", "processed_count", "total_tasks", r6("average_score").alias("average_score"),
            "observation_count")
        for name, given in asked.items()
    ]
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


@query("stored_messages", sql="""
SELECT CAST(msg_id AS VARCHAR) AS msg_id, outcome, CAST(0 AS INT) AS retries, true AS stamped FROM messages""")
def stored_messages(v: Inputs) -> DataFrame:
    path = scratch_dir(v.spark, "published")
    S.publish_messages(v.messages, path, "msg_id", "outcome")
    back = v.spark.read.schema("data string, timestamp string, retries int").json(path)
    return back.select(F.get_json_object("data", "$.msg_id").alias("msg_id"), F.get_json_object("data", "$.outcome").alias("outcome"),
                       "retries", F.col("timestamp").cast("timestamp").isNotNull().alias("stamped"))


@query("stored_execution_log", sql="""
SELECT execution_id, arg_min(workflow_id, created_at) AS workflow_id, CAST(count(*) AS VARCHAR) AS log_lines,
  CASE WHEN arg_max(event_type, created_at) = 'WorkflowExecutionFailed' THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN arg_max(event_type, created_at) = 'WorkflowExecutionFailed' THEN arg_max(error_type, created_at) END AS error_type
FROM event_store GROUP BY 1""")
def stored_execution_log(v: Inputs) -> DataFrame:
    path = scratch_dir(v.spark, "lines")
    S.write_execution_log(L.execution_log(v.event_store), path)
    member = lambda name: F.get_json_object("value", f"$.{name}").alias(name)
    return v.spark.read.text(path).select(member("execution_id"), member("workflow_id"), member("log_lines"), "status", member("error_type"))


_LINES = """
WITH p AS (SELECT execution_id, min(metadata) AS system_prompt FROM event_store WHERE event_type = 'WorkflowExecutionStarted' GROUP BY 1)
"""


@query("stored_replays", sql=_LINES + """
SELECT execution_id, 'passeport' AS document_type, 'albert-large' AS model, system_prompt, 'user' AS user_prompt, NULL::VARCHAR AS reason, NULL::VARCHAR AS record FROM p
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'unreadable', '{bad ' || event_id FROM events WHERE event_id % 17 = 0
UNION ALL SELECT 'x' || event_id, NULL, NULL, NULL, NULL, 'missing document_type, system_prompt', NULL FROM events WHERE event_id % 13 = 0""")
def stored_replays(v: Inputs) -> DataFrame:
    """Replay payloads with unreadable and incomplete lines among them: both tables."""
    path = scratch_dir(v.spark, "replays")
    S.write_replay_payloads(pages_and_logs._replays(v), path)
    number = F.col("event_id").cast("string")
    v.events.filter("event_id % 17 = 0").select(F.concat(F.lit("{bad "), number)).write.mode("append").text(path)
    part = F.struct(F.concat(F.lit("x"), number).alias("execution_id"), F.lit("m").alias("model"), F.lit("u").alias("user_prompt"))
    v.events.filter("event_id % 13 = 0").select(F.to_json(part)).write.mode("append").text(path)
    good, rejected = T.split_replay_payloads(v.spark, path)
    return good.unionByName(rejected.drop("file"), allowMissingColumns=True)


@query("stored_prompts", sql=f"""
WITH q AS (SELECT id, created_at AS ts, workflow_id AS document_type, 'prompt-' || (retry_count % 2) AS prompt,
  lag('prompt-' || (retry_count % 2)) OVER (PARTITION BY workflow_id ORDER BY created_at, id) AS previous_prompt FROM event_store)
SELECT id, {sql_at('ts')} AS ts, document_type, prompt, previous_prompt, document_type AS folder FROM q WHERE prompt IS DISTINCT FROM previous_prompt""")
def stored_prompts(v: Inputs) -> DataFrame:
    path = scratch_dir(v.spark, "prompts")
    changes = R.prompt_changes(pages_and_logs._prompts(v), pages_and_logs.hour("ts")).withColumn("ts", at("ts"))
    S.write_prompt_history(changes, path)
    schema = "id bigint, ts string, document_type string, prompt string, previous_prompt string, document_type_key string"
    return v.spark.read.schema(schema).json(path).withColumnRenamed("document_type_key", "folder")


@query("workflow_catalog_scan", sql="""
SELECT CAST(n_nationkey AS BIGINT) AS position, n_name AS id, n_nationkey % 4 <> 3 AS valid,
  CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE 'albert-large' END AS llm_model, CAST(n_regionkey + 1 AS BIGINT) AS steps FROM nation""")
def workflow_catalog_scan(v: Inputs) -> DataFrame:
    """A catalog file, one JSON array; every fourth record lacks its model."""
    path = scratch_dir(v.spark, "catalog")
    n = F.col("n_nationkey")
    record = F.struct(
        F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("d").alias("description"), F.lit("1").alias("version"),
        F.lit(True).alias("enabled"), F.array(F.lit("application/pdf")).alias("supported_file_types"),
        F.array_repeat("n_name", F.col("n_regionkey").cast("int") + 1).alias("steps"), F.when(n % 4 != 3, "albert-large").alias("llm_model"),
        F.lit(5).alias("max_file_size_mb"), F.lit(9).alias("processing_timeout_minutes"), F.lit("t").alias("created_at"), F.lit("t").alias("updated_at"),
    )
    listed = v.nation.agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), F.to_json(record).alias("t")))).alias("r"))
    text = F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["t"]), ",\n"), F.lit("]"))
    listed.select(text).coalesce(1).write.text(path)
    good, bad = T.scan_workflow_catalog(v.spark, path)
    both = good.withColumn("valid", F.lit(True)).unionByName(bad.drop("_corrupt_record").withColumn("valid", F.lit(False)))
    return both.select("position", "id", "valid", "llm_model", F.size("steps").cast("bigint").alias("steps"))


@query("tenancy_scan", sql="""
SELECT 'organization' AS kind, CAST(id AS VARCHAR) AS id, NULL::VARCHAR AS organization_id, name AS text, platform_role AS state FROM organizations
UNION ALL SELECT 'key', CAST(id AS VARCHAR), CAST(organization_id AS VARCHAR), prefix, status FROM api_keys
UNION ALL SELECT 'webhook', CAST(id AS VARCHAR), CAST(organization_id AS VARCHAR), url, 'x-org=' || organization_id FROM webhooks""")
def tenancy_scan(v: Inputs) -> DataFrame:
    root, text = scratch_dir(v.spark, "tenancy"), lambda c: F.col(c).cast("string").alias(c)
    v.organizations.select(text("id"), "name", "platform_role").write.parquet(f"{root}/organizations")
    v.api_keys.select(text("id"), text("organization_id"), "prefix", "status").write.parquet(f"{root}/keys")
    headers = F.create_map(F.lit("x-org"), F.col("organization_id").cast("string")).alias("headers")
    v.webhooks.select(text("id"), text("organization_id"), "url", headers).write.parquet(f"{root}/webhooks")
    none = F.lit(None).cast("string").alias("organization_id")
    return (
        T.scan_organizations(v.spark, f"{root}/organizations")
        .select(F.lit("organization").alias("kind"), "id", none, F.col("name").alias("text"), F.col("platform_role").alias("state"))
        .unionByName(T.scan_api_keys(v.spark, f"{root}/keys").select(
            F.lit("key").alias("kind"), "id", "organization_id", F.col("prefix").alias("text"), F.col("status").alias("state")))
        .unionByName(T.scan_webhooks(v.spark, f"{root}/webhooks").select(
            F.lit("webhook").alias("kind"), "id", "organization_id", F.col("url").alias("text"),
            F.concat(F.lit("x-org="), F.col("headers")["x-org"]).alias("state")))
    )


@query("file_ids_scan", sql="""
SELECT 'file-' || doc_id AS file_id FROM documents WHERE doc_id % 5 < 3""")
def file_ids_scan(v: Inputs) -> DataFrame:
    path, n = scratch_dir(v.spark, "ids"), F.col("doc_id")
    name = F.concat(F.lit("file-"), n.cast("string"))
    value = (
        F.when(n % 5 == 0, name).when(n % 5 == 1, F.concat(F.lit("  "), name, F.lit(" \t")))
        .when(n % 5 == 2, F.concat(name, F.lit(" "))).when(n % 5 == 3, F.lit("   "))
    )
    written = v.documents.select(n.alias("row"), value.alias("file_id"))
    written.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return T.scan_file_ids_csv(v.spark, path)


def _texts(v: Inputs, purpose: str) -> str:
    """The documents as text files, one folder per language."""
    path = scratch_dir(v.spark, purpose)
    v.documents.select("lang", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("lang").text(path)
    return path


_FOLDER = r"lang=([^/]*)/"


@query("binary_documents_scan", sql="""
SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length,
  sum(strlen(coalesce(text, '')) + 1)::BIGINT AS content_bytes,
  sum(len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS lines FROM documents GROUP BY 1""")
def binary_documents_scan(v: Inputs) -> DataFrame:
    files = T.scan_documents_binary(v.spark, _texts(v, "raw"), "*.txt")
    body = F.decode("content", "UTF-8")
    return files.groupBy(F.regexp_extract("path", _FOLDER, 1).alias("lang")).agg(
        F.sum("length").alias("length"), F.sum(F.octet_length("content")).cast("bigint").alias("content_bytes"),
        F.sum(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).cast("bigint").alias("lines"),
    )


@query("object_inventory_scan", sql="""
SELECT coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS size,
  'application/octet-stream' AS content_type, true AS dated FROM documents GROUP BY 1""")
def object_inventory_scan(v: Inputs) -> DataFrame:
    listed = O.object_inventory(T.scan_documents_binary(v.spark, _texts(v, "objects"), "*.txt"))
    return listed.groupBy(F.regexp_extract("key", _FOLDER, 1).alias("lang"), "content_type").agg(
        F.sum("size").alias("size"), F.bool_and(F.col("last_modified").isNotNull()).alias("dated"))


@query("ocr_pages_scan", sql="""
SELECT CAST(page_number AS INT) AS page_number, text, has_failed, count(*) AS n FROM ocr_pages GROUP BY ALL""")
def ocr_pages_scan(v: Inputs) -> DataFrame:
    path = scratch_dir(v.spark, "ocr")
    page = F.struct(F.col("page_number").cast("int").alias("page_number"), "text", "has_failed")
    results = v.ocr_pages.groupBy("execution_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    results.select("pages").write.json(path)
    pages = T.scan_ocr_pages(v.spark, path, multiline=False)
    return pages.groupBy("page_number", "text", "has_failed").agg(F.count(F.lit(1)).alias("n"))


@query("split_tables_join", sql="""
SELECT lp.task_id, lp.prediction_id, lp.model_version, lp.field, lp.expected, lp.predicted FROM label_pairs lp
JOIN task_flags t ON t.task_id = lp.task_id WHERE t.has_truth AND t.has_predictions""")
def split_tables_join(v: Inputs) -> DataFrame:
    """Truths and predictions in two tables of equal buckets, joined bucket by bucket."""
    root = scratch_dir(v.spark, "split")
    name = root.rsplit("-", 1)[-1]
    tasks = v.label_tasks.withColumn("gold", labels.first_ground_truth("annotations"))
    truths = tasks.filter(F.col("gold").isNotNull()).select(F.col("id").alias("task_id"), labels.results_to_map("gold").alias("truth"))
    predictions = tasks.select(F.col("id").alias("task_id"), F.explode("predictions").alias("p")).select(
        "task_id", F.col("p.id").alias("prediction_id"), "p.model_version", labels.results_to_map("p.result").alias("prediction"))
    S.write_bucketed(truths, f"truths_{name}", f"{root}/truths", buckets=8)
    S.write_bucketed(predictions, f"predictions_{name}", f"{root}/predictions", buckets=8)
    pairs = E.join_split_tables(v.spark.table(f"predictions_{name}"), v.spark.table(f"truths_{name}"))
    return pairs.select("task_id", "prediction_id", "model_version", "prediction", F.explode("truth").alias("field", "expected")).select(
        "task_id", "prediction_id", "model_version", "field", "expected", F.try_element_at("prediction", F.col("field")).alias("predicted"))


@query("report_tables", sql=f"""WITH {_OBS},
models AS (SELECT DISTINCT model_version FROM obs),
cells AS (SELECT field, metric, model_version, avg(score) AS mean FROM long GROUP BY ALL)
SELECT 'summary' AS part, model_version, NULL AS field, NULL AS metric, count(*) AS n, round(avg(score), 6) AS mean, NULL AS low,
  round(avg(processing_time_ms), 6) AS high, CAST(count(*) FILTER (WHERE error IS NOT NULL) AS VARCHAR) AS text FROM obs GROUP BY 2
UNION ALL SELECT 'times', model_version, NULL, NULL, count(processing_time_ms), round(avg(processing_time_ms), 6),
  min(processing_time_ms)::DOUBLE, max(processing_time_ms)::DOUBLE, CAST(CAST(quantile_cont(processing_time_ms, 0.5) * 10 AS BIGINT) AS VARCHAR)
  FROM obs WHERE processing_time_ms IS NOT NULL GROUP BY 2
UNION ALL SELECT 'fields', model_version, field, metric, count(*), round(avg(score), 6), round(min(score), 6), round(max(score), 6), 'false'
  FROM long GROUP BY ALL
UNION ALL SELECT 'table', model_version, field, metric, NULL, NULL, NULL, NULL, printf('%.3f', mean) FROM cells
UNION ALL SELECT 'errors', model_version, NULL, NULL, prediction_id, score, NULL, NULL, NULL FROM obs WHERE error IS NOT NULL""")
def report_tables(v: Inputs) -> DataFrame:
    tables = jobs.report_by_model(v.label_tasks)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("field", "string"), ("metric", "string"), ("n", "bigint"), ("mean", "double"),
                                                         ("low", "double"), ("high", "double"), ("text", "string"))}

    def part(name: str, df: DataFrame, **given) -> DataFrame:
        named = {c: e.alias(c) for c, e in given.items()}
        return df.select(F.lit(name).alias("part"), "model_version", *[named.get(c, none[c]) for c in none])

    wide = tables["field_metric_by_model"]
    models = [c for c in wide.columns if c not in ("field", "metric")]
    cells = wide.select("field", "metric", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_version"), F.col(f"`{m}`").alias("cell")) for m in models])).alias("c")).select("field", "metric", "c.*")
    c = F.col
    return (
        part("summary", tables["model_summary"], n=c("total_items"), mean=r6("overall_score"), high=r6("mean_time_ms"), text=c("errors").cast("string"))
        .unionByName(part("times", tables["processing_time_stats"], n=c("sample_count"), mean=r6("mean_ms"), low=c("min_ms"), high=c("max_ms"),
                          text=(c("median_ms") * 10).cast("bigint").cast("string")))
        .unionByName(part("fields", tables["field_metric_stats"], field=c("field"), metric=c("metric"), n=c("count"), mean=r6("mean"),
                          low=r6("min"), high=r6("max"), text=c("is_skipped").cast("string")))
        .unionByName(part("table", cells, field=c("field"), metric=c("metric"), text=c("cell")))
        .unionByName(part("errors", tables["error_observations"], n=c("prediction_id"), mean=c("score")))
    )
