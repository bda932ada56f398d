"""Experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import experiments as X
from .registry import query
from .views import Inputs, at, r6, sql_at


@query("experiment_rollup", sql="""
SELECT o.experiment_id, round(avg(o.score), 6) + 0.0 AS average_score, count(DISTINCT o.task_id) AS processed_count,
  CAST(CASE WHEN e.total_tasks > 0 THEN e.total_tasks ELSE count(DISTINCT o.task_id) END AS BIGINT) AS total_tasks
FROM observations o JOIN experiment_runs e ON e.id = o.experiment_id GROUP BY o.experiment_id, e.total_tasks""")
def experiment_rollup(v: Inputs) -> DataFrame:
    rolled = X.experiment_rollup(v.observations)
    given = v.experiment_runs.select(F.col("id").alias("experiment_id"), F.col("total_tasks").alias("given"))
    total = F.when(F.col("given") > 0, F.col("given")).otherwise(F.col("processed_count"))
    return rolled.join(given, "experiment_id").select(
        "experiment_id", r6("average_score").alias("average_score"), "processed_count",
        total.cast("bigint").alias("total_tasks"),
    )


@query("experiment_list", sql=f"""
WITH c AS (SELECT experiment_id, count(*) AS n FROM observations GROUP BY 1),
p AS (SELECT * FROM experiment_runs WHERE metric_name = '1-URGENT' ORDER BY created_at DESC, id DESC LIMIT 50)
SELECT p.id, p.label_project_id, p.metric_name, {sql_at('p.created_at')} AS created_at, p.status,
  round(CASE WHEN p.total_tasks = 0 THEN 0.0 ELSE p.processed_count::DOUBLE / p.total_tasks END, 6) AS success_rate,
  p.total_tasks - p.processed_count AS skipped_count, coalesce(c.n, 0) AS observation_count
FROM p LEFT JOIN c ON c.experiment_id = p.id""")
def experiment_list(v: Inputs) -> DataFrame:
    out = X.experiment_list(v.experiment_runs, v.observations, metric_name="1-URGENT")
    return out.select("id", "label_project_id", "metric_name", at("created_at").alias("created_at"),
                      "status", r6("success_rate").alias("success_rate"), "skipped_count",
                      "observation_count")


@query("experiment_summaries", sql="""
SELECT e.id, round(CASE WHEN e.total_tasks = 0 THEN 0.0 ELSE e.processed_count::DOUBLE / e.total_tasks END, 6) AS success_rate,
  e.total_tasks - e.processed_count AS skipped_count, coalesce(c.n, 0) AS observation_count
FROM experiment_runs e LEFT JOIN (SELECT experiment_id, count(*) AS n FROM observations GROUP BY 1) c ON c.experiment_id = e.id""")
def experiment_summaries(v: Inputs) -> DataFrame:
    out = X.experiment_list(v.experiment_runs, v.observations, limit=None)
    return out.select("id", r6("success_rate").alias("success_rate"), "skipped_count", "observation_count")


@query("experiment_detail", sql="""
SELECT e.id, e.metric_name, e.status, o.task_id, o.prediction_id, o.model_version, round(o.score, 6) AS score
FROM experiment_runs e LEFT JOIN observations o ON o.experiment_id = e.id""")
def experiment_detail(v: Inputs) -> DataFrame:
    out = X.experiment_with_observations(v.experiment_runs, v.observations)
    return out.select("id", "metric_name", "status", "task_id", "prediction_id", "model_version",
                      r6("score").alias("score"))


@query("experiment_export", sql="""
SELECT e.id, e.metric_name, o.task_id, o.model_version, coalesce(o.error, '') AS error
FROM experiment_runs e LEFT JOIN observations o ON o.experiment_id = e.id""")
def experiment_export(v: Inputs) -> DataFrame:
    results = F.to_json(F.struct("error"))
    out = X.export_experiments(v.experiment_runs, v.observations, results)
    o = F.col("observation")
    inner = F.get_json_object(o, "$.observation")
    return out.select(
        "id", "metric_name",
        F.get_json_object(o, "$.task_id").try_cast("bigint").alias("task_id"),
        F.get_json_object(o, "$.model_version").alias("model_version"),
        F.coalesce(F.get_json_object(inner, "$.error"), F.lit("")).alias("error"),
    )


@query("experiment_delete", sql="""
SELECT 'experiment' AS kind, id, NULL::BIGINT AS task_id FROM experiment_runs WHERE status <> 'failed'
UNION ALL
SELECT 'observation', o.experiment_id, o.task_id FROM observations o
WHERE o.experiment_id NOT IN (SELECT id FROM experiment_runs WHERE status = 'failed')""")
def experiment_delete(v: Inputs) -> DataFrame:
    gone = v.experiment_runs.filter(F.col("status") == "failed").select("id")
    parents, children = X.delete_cascade(v.experiment_runs, v.observations, gone)
    return parents.select(
        F.lit("experiment").alias("kind"), "id", F.lit(None).cast("bigint").alias("task_id")
    ).unionByName(
        children.select(F.lit("observation").alias("kind"), F.col("experiment_id").alias("id"), "task_id")
    )


@query("experiment_filter", sql="""
SELECT id, status FROM experiment_runs WHERE label_project_id = 3 AND metric_name = '2-HIGH'""")
def experiment_filter(v: Inputs) -> DataFrame:
    return X.filter_experiments(v.experiment_runs, 3, "2-HIGH").select("id", "status")


@query("experiment_save_private", sql="""
SELECT task_id, prediction_id, model_version, round(score, 6) AS score,
  round(score, 6) AS stored_score, false AS leaks, error FROM observations""")
def experiment_save_private(v: Inputs) -> DataFrame:
    secret = F.concat(F.lit("secret-"), F.col("task_id").cast("string"))
    detail = F.struct(
        secret.alias("expected"), secret.alias("predicted"),
        F.array("metric").alias("metrics"), F.create_map("metric", "score").alias("scores"),
    )
    observation = F.to_json(F.struct(
        F.create_map("field", F.create_map("metric", "score")).alias("field_scores"),
        F.create_map("field", detail).alias("field_details"), "error",
    ))
    stored = X.private_observations(
        v.observations.withColumn("observation", observation), "run-1")
    kept = F.from_json("metric_results", "field_scores map<string,map<string,double>>, error string")
    return stored.withColumn("kept", kept).select(
        "task_id", "prediction_id", "model_version", r6("score").alias("score"),
        F.round(F.map_values(F.map_values("kept.field_scores")[0])[0], 6).alias("stored_score"),
        F.col("metric_results").contains("secret").alias("leaks"), "kept.error",
    )
