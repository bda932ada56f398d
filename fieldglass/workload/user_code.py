"""Jobs that run user functions, and a write-and-read-back of every sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels
from ..operators import custom as C
from ..operators import evaluation as E
from ..operators import logs as L
from ..operators import messages as M
from ..operators import prompts as R
from ..plans import jobs
from ..session import scratch_dir
from ..sources import sinks as S
from ..sources import tables as T
from . import event_log, pages_and_logs
from .registry import query
from .views import Inputs


def page_extractor():
    """Example extractor: reads a page text, fails on system pages."""

    def extract(row: dict) -> dict:
        if row["has_failed"]:
            raise ValueError("page failed")
        text = row["text"] or ""
        return {
            "execution_id": f"run-{row['page_key']}",
            "total_processing_time_ms": 12.0,
            "properties": [
                {"name": "first_word", "value": text.split(" ")[0], "type": "string"},
                {"name": "chars", "value": len(text), "type": "number"},
                {"name": "empty", "value": "", "type": "string"},
            ],
        }

    return extract


def _pages(v: Inputs) -> DataFrame:
    key = F.concat_ws("-", F.col("execution_id").cast("string"), F.col("page_number").cast("string"))
    return v.ocr_pages.select(key.alias("page_key"), "text", "has_failed")


@query("predict_batch", sql="""
SELECT execution_id || '-' || page_number AS page_key, NOT has_failed AS success,
  CASE WHEN has_failed THEN 'page failed' END AS error,
  CASE WHEN NOT has_failed THEN CASE WHEN length(text) = 0 THEN 1 WHEN string_split(text, ' ')[1] = '' THEN 2 ELSE 3 END END AS results,
  'wf-demo' AS model_version FROM ocr_pages""")
def predict_batch(v: Inputs) -> DataFrame:
    out = C.predict(_pages(v), page_extractor(), key="page_key", n_partitions=8, workflow_id="wf-demo")
    return out.select("page_key", "success", "error", F.size("result").alias("results"), "model_version")


@query("success_counts", sql="""
SELECT count(*) FILTER (WHERE NOT has_failed) AS success_count, count(*) AS total_count,
  round(count(*) FILTER (WHERE NOT has_failed)::DOUBLE / count(*), 6) AS success_rate FROM ocr_pages""")
def success_counts(v: Inputs) -> DataFrame:
    out = C.predict(_pages(v), page_extractor(), key="page_key")
    return E.success_counts(out).withColumn("success_rate", F.round("success_rate", 6))


@query("failed_tasks", sql="""
SELECT execution_id || '-' || page_number AS page_key, 'page failed' AS error FROM ocr_pages WHERE has_failed""")
def failed_tasks(v: Inputs) -> DataFrame:
    return E.failed(C.predict(_pages(v), page_extractor(), key="page_key")).select("page_key", "error")


@query("custom_metric", sql="""
WITH p AS (SELECT lp.prediction_id, lp.task_id, lp.model_version, t.document_type,
  count(*) FILTER (WHERE lp.predicted IS NOT NULL AND lp.expected = lp.predicted) AS hits
  FROM label_pairs lp JOIN task_flags t ON t.task_id = lp.task_id WHERE t.has_truth AND t.has_predictions GROUP BY ALL)
SELECT task_id, model_version, prediction_id, CASE WHEN document_type IS NULL THEN 0.0::DOUBLE ELSE round(hits / 4.0::DOUBLE, 6) END AS score,
  document_type IS NULL AS failed FROM p""")
def custom_metric(v: Inputs) -> DataFrame:
    def exact_share(prediction: dict, truth: dict, document_type: str | None):
        if document_type is None:
            raise ValueError("no document type")
        hits = sum(1 for k, x in truth.items() if prediction.get(k) == x)
        return hits / len(truth), "{}", prediction

    out = C.evaluate_custom(E.pair_predictions(v.label_tasks), exact_share)
    return out.select("task_id", "model_version", "prediction_id", F.round("score", 6).alias("score"), "failed")


@query("build_dataset", sql="""
SELECT execution_id || '-' || page_number AS page_key, NOT has_failed AS success,
  CASE WHEN NOT has_failed THEN execution_id || '-' || page_number END AS pdf,
  CASE WHEN NOT has_failed THEN CASE WHEN length(text) = 0 THEN 0 WHEN string_split(text, ' ')[1] = '' THEN 1 ELSE 2 END END AS fields
FROM ocr_pages""")
def build_dataset(v: Inputs) -> DataFrame:
    out = C.build_dataset(_pages(v), page_extractor(), url="page_key")
    gold = labels.first_ground_truth("task.annotations")
    fields = F.coalesce(F.greatest(F.size(gold), F.lit(0)), F.lit(0))
    return out.select("page_key", "success", F.col("task.data.pdf").alias("pdf"),
                      F.when(F.col("success"), fields).alias("fields"))


@query("execution_pipeline", sql=f"""
WITH todo AS ({event_log._resumable_sql('DESC')})
SELECT t.execution_id, w.id IS NOT NULL AND t.id % 5 <> 0 AS success,
  CASE WHEN w.id IS NULL THEN 'Workflow not found' WHEN t.id % 5 = 0 THEN 'step failed' END AS error
FROM todo t JOIN event_store e ON e.id = t.id LEFT JOIN workflow_rows w ON w.id = e.workflow_id""")
def execution_pipeline(v: Inputs) -> DataFrame:
    def run_steps(row: dict) -> dict:
        if row["id"] % 5 == 0:
            raise RuntimeError("step failed")
        return {"properties": [{"name": s, "value": "done"} for s in row["steps"]]}

    out = jobs.execution_pipeline(v.event_store, v.workflows, run_steps)
    return out.select("execution_id", "success", "error")


@query("sink_roundtrip", sql="""
SELECT 'append_events' AS sink, (SELECT count(*) FROM events) AS n
UNION ALL SELECT 'export_tasks', (SELECT count(*) FROM customer)
UNION ALL SELECT 'write_dataset', (SELECT count(*) FROM customer)
UNION ALL SELECT 'experiments', 1
UNION ALL SELECT 'observations', (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'publish_messages', (SELECT count(*) FROM events)
UNION ALL SELECT 'write_dead_letters', (SELECT count(*) FROM messages WHERE msg_id % 17 = 0 OR outcome = 'fatal' OR (outcome = 'retryable' AND retries >= 2))
UNION ALL SELECT 'write_execution_log', (SELECT count(DISTINCT execution_id) FROM event_store)
UNION ALL SELECT 'write_replay_payloads', (SELECT count(DISTINCT execution_id) FROM event_store WHERE event_type = 'WorkflowExecutionStarted')
UNION ALL SELECT 'write_prompt_history', (SELECT count(*) FROM (SELECT retry_count % 2 AS p, lag(retry_count % 2) OVER (PARTITION BY workflow_id ORDER BY created_at, id) AS q FROM event_store) WHERE p IS DISTINCT FROM q)
UNION ALL SELECT 'retention_done', (SELECT count(*) FROM event_store WHERE created_at <= TIMESTAMP '2024-01-20' OR anonymization_status = 'DONE')""")
def sink_roundtrip(v: Inputs) -> DataFrame:
    spark, root = v.spark, scratch_dir(v.spark, "sinks")
    stamped = event_log.payload_events(v).withColumns({
        "created_at": F.col("created_at").cast("timestamp"),
        "id": F.col("id").cast("string"), "organization_id": F.col("organization_id").cast("string"),
    })
    S.append_events(stamped, f"{root}/events")
    S.export_tasks(v.label_tasks, f"{root}/export")
    S.write_dataset(v.label_tasks, f"{root}/dataset")
    observed = v.observations.withColumn("observation", F.to_json(F.struct("error")))
    S.save_experiment(observed, f"{root}/runs", "run-1", 7, K.FIELD_METRIC_NAME)
    S.publish_messages(v.messages, f"{root}/messages", "msg_id", "outcome")
    routed = M.route_outcomes(M.decoded(v.messages, ("k",)))
    S.write_dead_letters(M.dead_letters(routed, "consumer-1"), f"{root}/dlq")
    S.write_execution_log(L.execution_log(v.event_store), f"{root}/log")
    S.write_replay_payloads(pages_and_logs._replays(v), f"{root}/replay")
    S.write_prompt_history(
        R.prompt_changes(pages_and_logs._prompts(v), pages_and_logs.hour("ts")), f"{root}/prompts")
    written = T.scan_event_store(spark, f"{root}/events").count()
    jobs.retention(spark, f"{root}/events", F.lit("2024-01-27").cast("timestamp"))
    done = T.scan_event_store(spark, f"{root}/events").filter(F.col("anonymization_status") == "DONE")
    tables = {
        "export_tasks": T.scan_label_tasks(spark, f"{root}/export"),
        "write_dataset": T.scan_label_tasks(spark, f"{root}/dataset/tasks"),
        "experiments": T.scan_experiments(spark, f"{root}/runs/experiments"),
        "observations": T.scan_observations(spark, f"{root}/runs/observations"),
        "publish_messages": spark.read.schema("data string, timestamp string, retries int").json(f"{root}/messages"),
        "write_dead_letters": T.scan_dead_letters(spark, f"{root}/dlq"),
        "write_execution_log": spark.read.text(f"{root}/log"),
        "write_replay_payloads": T.scan_replay_payloads(spark, f"{root}/replay"),
        "write_prompt_history": spark.read.json(f"{root}/prompts"),
        "retention_done": done,
    }
    out = spark.range(1).select(F.lit("append_events").alias("sink"), F.lit(written).cast("bigint").alias("n"))
    for name, table in tables.items():
        out = out.unionByName(table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "n"))
    return out


@query("experiment_history", sql="""
SELECT 'run-1' AS id, count(DISTINCT task_id)::INT AS total_tasks, count(DISTINCT task_id)::INT AS processed_count,
  round(avg(score), 6) AS average_score, count(*) AS observation_count FROM observations""")
def experiment_history(v: Inputs) -> DataFrame:
    observed = v.observations.withColumn("observation", F.to_json(F.struct("error")))
    root = scratch_dir(v.spark, "history")
    run = {"experiment_id": "run-1", "project_id": 7, "metric_name": K.FIELD_METRIC_NAME}
    out = jobs.experiment_history(observed, root, v.spark, project_id=7, run=run)
    return out.select("id", "total_tasks", "processed_count", F.round("average_score", 6).alias("average_score"),
                      "observation_count")
