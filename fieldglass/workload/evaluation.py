"""Evaluation of labelled tasks and the reports on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import reports as R
from ..plans import jobs
from .registry import query
from .views import Inputs, r6, sql_distance_text, sql_number, sql_similarity

_EXP, _PRED = sql_distance_text("expected"), sql_distance_text("predicted")

# Scores of the declared 'cni' fields: four have values, the other five are missing on
# both sides, where edit distance scores 1 and dates score 0.
_LONG = f"""
base AS (
  SELECT lp.task_id, lp.model_version, lp.prediction_id, lp.field, lp.expected, lp.predicted
  FROM label_pairs lp JOIN task_flags t ON t.task_id = lp.task_id
  WHERE t.has_truth AND t.has_predictions AND t.document_type = 'cni'),
given AS (
  SELECT task_id, model_version, prediction_id, field,
    CASE WHEN field = 'numero_document' THEN 'compare_number' ELSE 'levenshtein_distance' END AS metric,
    CASE WHEN field = 'numero_document'
      THEN CASE WHEN {sql_number('expected')} IS NOT DISTINCT FROM {sql_number('predicted')} THEN 1.0 ELSE 0.0 END
      ELSE {sql_similarity(_EXP, _PRED)} END AS score,
    CASE WHEN field <> 'numero_document' THEN CAST(levenshtein({_EXP}, {_PRED}) AS INT) END AS distance
  FROM base),
absent AS (
  SELECT DISTINCT b.task_id, b.model_version, b.prediction_id, x.field, x.metric, x.score, x.distance
  FROM base b JOIN (VALUES ('prenom', 'levenshtein_distance', 1.0, 0),
    ('bande_mrz', 'levenshtein_distance', 1.0, 0), ('date_delivrance', 'string_date_equality', 0.0, NULL),
    ('date_expiration', 'string_date_equality', 0.0, NULL),
    ('date_naissance', 'string_date_equality', 0.0, NULL)) x(field, metric, score, distance) ON true),
long AS (SELECT * FROM given UNION ALL SELECT * FROM absent)
"""
_OBS = f"""{_LONG},
flagged AS (
  SELECT DISTINCT lp.task_id, lp.model_version, lp.prediction_id, t.document_type, lp.processing_time_ms
  FROM label_pairs lp JOIN task_flags t ON t.task_id = lp.task_id WHERE t.has_truth AND t.has_predictions),
obs AS (
  SELECT f.*, coalesce(s.score, 0.0) AS score,
    CASE WHEN f.document_type IS DISTINCT FROM 'cni' THEN 'error' END AS error
  FROM flagged f LEFT JOIN (SELECT prediction_id, avg(score) AS score FROM long GROUP BY 1) s
    ON s.prediction_id = f.prediction_id)
"""


@query("model_summary", sql=f"""WITH {_OBS}
SELECT model_version, round(avg(score), 6) AS overall_score, count(*) AS total_items,
  count(*) FILTER (WHERE error IS NOT NULL) AS errors,
  round(avg(processing_time_ms), 6) AS mean_time_ms FROM obs GROUP BY 1""")
def model_summary(v: Inputs) -> DataFrame:
    return jobs.model_report(v.label_tasks).select(
        "model_version", r6("overall_score").alias("overall_score"), "total_items", "errors",
        r6("mean_time_ms").alias("mean_time_ms"),
    )


@query("field_scores_long", sql=f"""WITH {_LONG}
SELECT task_id, model_version, prediction_id, field, metric, round(score, 6) AS score, distance FROM long""")
def field_scores_long(v: Inputs) -> DataFrame:
    scores = E.field_scores(E.pair_predictions(v.label_tasks))
    return scores.select("task_id", "model_version", "prediction_id", "field", "metric",
                         r6("score").alias("score"), "distance")


@query("observation_scores", sql=f"""WITH {_OBS}
SELECT task_id, model_version, prediction_id, round(score, 6) AS score,
  CASE WHEN document_type = 'cni' THEN 9 ELSE 0 END AS evaluated_fields, 0 AS skipped_fields,
  CASE WHEN document_type IS NULL THEN 'Could not infer document_type for task ' || task_id
    WHEN document_type <> 'cni' THEN 'Failed to load schema for document_type ''' || document_type || '''' END AS error,
  CAST(processing_time_ms AS DOUBLE) AS processing_time_ms FROM obs""")
def observation_scores(v: Inputs) -> DataFrame:
    observations, _ = jobs.evaluate_project(v.label_tasks)
    return observations.select("task_id", "model_version", "prediction_id", r6("score").alias("score"),
                               "evaluated_fields", "skipped_fields", "error", "processing_time_ms")


@query("overall_scores", sql=f"""WITH {_LONG}
SELECT task_id, model_version, prediction_id, round(avg(score), 6) AS overall_score,
  count(*) AS evaluated_fields, CAST(0 AS BIGINT) AS skipped_fields FROM long GROUP BY 1, 2, 3""")
def overall_scores(v: Inputs) -> DataFrame:
    out = E.overall_scores(E.field_scores(E.pair_predictions(v.label_tasks)))
    return out.withColumn("overall_score", r6("overall_score"))


@query("evaluation_counters", sql="""
SELECT count(*) AS total_tasks,
  CAST(sum(CASE WHEN has_truth AND has_predictions AND document_type IS NOT NULL THEN 2 ELSE 0 END) AS BIGINT) AS processed_count,
  CAST(sum(CASE WHEN NOT has_truth OR NOT has_predictions THEN 1 WHEN document_type IS NULL THEN 2 ELSE 0 END) AS BIGINT) AS skipped_count
FROM task_flags""")
def evaluation_counters(v: Inputs) -> DataFrame:
    return E.evaluation_counters(v.label_tasks)


@query("skipped_tasks", sql="""
SELECT task_id, CASE WHEN NOT has_truth THEN 'no ground truth' ELSE 'no predictions' END AS reason
FROM task_flags WHERE NOT has_truth OR NOT has_predictions""")
def skipped_tasks(v: Inputs) -> DataFrame:
    return E.skipped_tasks(v.label_tasks)


@query("dataset_stats", sql="""
SELECT count(*) AS total_tasks, count(*) FILTER (WHERE has_truth) AS annotated_tasks,
  count(*) FILTER (WHERE has_truth AND completed) AS completed_tasks FROM task_flags""")
def dataset_stats(v: Inputs) -> DataFrame:
    return E.dataset_stats(v.label_tasks)


@query("project_task_counts", sql="""
SELECT t.project, CASE WHEN t.project % 2 = 0 THEN n.n_name ELSE 'Project ' || t.project END AS title,
  count(*) AS task_count
FROM task_flags t JOIN nation n ON n.n_nationkey = t.project GROUP BY 1, 2""")
def project_task_counts(v: Inputs) -> DataFrame:
    titles = v.nation.select(
        F.col("n_nationkey").cast("bigint").alias("project"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("title"),
    )
    return E.project_task_counts(v.label_tasks, titles)


@query("task_preview", sql="""
SELECT task_id, pdf, document_type FROM task_flags ORDER BY task_id LIMIT 3""")
def task_preview(v: Inputs) -> DataFrame:
    flat = v.label_tasks.select(F.col("id").alias("task_id"), "data.pdf", "data.document_type")
    return flat.orderBy("task_id").limit(3)


@query("processing_time_stats", sql="""
SELECT model_version, round(avg(processing_time_ms), 6) AS mean_ms,
  round(quantile_cont(processing_time_ms, 0.5), 6) AS median_ms,
  round(stddev_pop(processing_time_ms), 6) AS std_dev_ms, min(processing_time_ms) AS min_ms,
  max(processing_time_ms) AS max_ms, count(processing_time_ms) AS sample_count
FROM observations WHERE processing_time_ms IS NOT NULL GROUP BY 1""")
def processing_time_stats(v: Inputs) -> DataFrame:
    return R.processing_time_stats(v.observations).select(
        "model_version", r6("mean_ms").alias("mean_ms"), r6("median_ms").alias("median_ms"),
        r6("std_dev_ms").alias("std_dev_ms"), "min_ms", "max_ms", "sample_count",
    )


@query("model_version_stats", sql="""
SELECT experiment_id, model_version, round(avg(processing_time_ms), 6) AS mean_processing_time_ms,
  count(*) AS sample_count FROM observations WHERE processing_time_ms IS NOT NULL GROUP BY 1, 2""")
def model_version_stats(v: Inputs) -> DataFrame:
    stats = R.model_version_stats(v.observations, "experiment_id")
    return stats.select(
        "experiment_id", F.explode("model_version_stats").alias("model_version", "s")
    ).select("experiment_id", "model_version",
             r6("s.mean_processing_time_ms").alias("mean_processing_time_ms"), "s.sample_count")


@query("field_metric_stats", sql="""
SELECT model_version, field, metric,
  CASE WHEN NOT bool_and(score = -1) THEN round(avg(score), 6) END AS mean,
  CASE WHEN NOT bool_and(score = -1) THEN round(stddev_pop(score), 6) END AS std_dev,
  CASE WHEN NOT bool_and(score = -1) THEN round(min(score), 6) END AS min,
  CASE WHEN NOT bool_and(score = -1) THEN round(max(score), 6) END AS max,
  count(*) AS count, bool_and(score = -1) AS is_skipped
FROM observations GROUP BY 1, 2, 3""")
def field_metric_stats(v: Inputs) -> DataFrame:
    out = R.field_metric_stats(v.observations)
    return out.withColumns({c: r6(c) for c in ("mean", "std_dev", "min", "max")})


@query("field_metric_pivot", sql="""
WITH m AS (SELECT field, metric, model_version, avg(score) AS mean, bool_and(score = -1) AS skipped
  FROM observations GROUP BY 1, 2, 3),
c AS (SELECT field, metric, model_version, CASE WHEN skipped THEN 'SKIPPED' ELSE printf('%.3f', mean) END AS cell FROM m)
SELECT field, metric, coalesce(max(cell) FILTER (WHERE model_version = 'model-A'), 'SKIPPED') AS "model-A",
  coalesce(max(cell) FILTER (WHERE model_version = 'model-N'), 'SKIPPED') AS "model-N",
  coalesce(max(cell) FILTER (WHERE model_version = 'model-R'), 'SKIPPED') AS "model-R"
FROM c GROUP BY 1, 2 ORDER BY 1, 2""")
def field_metric_pivot(v: Inputs) -> DataFrame:
    table = R.field_metric_by_model(v.observations, ["model-A", "model-N", "model-R"])
    return table.orderBy("field", "metric")


@query("observation_model_summary", sql="""
SELECT model_version, round(avg(score), 6) AS overall_score, count(*) AS total_items,
  count(error) AS errors, round(avg(processing_time_ms), 6) AS mean_time_ms
FROM observations GROUP BY 1""")
def observation_model_summary(v: Inputs) -> DataFrame:
    out = R.model_summary(v.observations)
    return out.withColumns({c: r6(c) for c in ("overall_score", "mean_time_ms")})


def _stored(v: Inputs) -> DataFrame:
    """Observations as a saved run holds them; every thirteenth text is damaged."""
    result = F.to_json(F.struct(
        "score", "error", F.create_map("field", F.create_map("metric", "score")).alias("field_scores")
    ))
    text = F.when(F.col("task_id") % 13 == 0, F.substring(result, 1, 9)).otherwise(result)
    return R.read_stored(v.observations.withColumn("metric_results", text))


@query("report_from_stored", sql="""
SELECT model_version, round(avg(score) FILTER (WHERE task_id % 13 <> 0), 6) AS overall_score, count(*) AS total_items,
  count(*) FILTER (WHERE task_id % 13 = 0 OR error IS NOT NULL) AS errors, round(avg(processing_time_ms), 6) AS mean_time_ms
FROM observations GROUP BY 1""")
def report_from_stored(v: Inputs) -> DataFrame:
    out = R.stored_summary(_stored(v))
    return out.withColumns({c: r6(c) for c in ("overall_score", "mean_time_ms")})


@query("stored_field_scores", sql="""
SELECT model_version, field, metric, round(avg(score), 6) AS mean, count(*) AS n
FROM observations WHERE task_id % 13 <> 0 GROUP BY 1, 2, 3""")
def stored_field_scores(v: Inputs) -> DataFrame:
    scores = R.stored_scores(_stored(v))
    return scores.groupBy("model_version", "field", "metric").agg(
        r6(F.avg("score")).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("distinct_field_metric", sql="SELECT DISTINCT field, metric FROM observations")
def distinct_field_metric(v: Inputs) -> DataFrame:
    return R.distinct_field_metric(v.observations)


@query("distinct_models", sql="SELECT DISTINCT model_version FROM observations")
def distinct_models(v: Inputs) -> DataFrame:
    return R.distinct_models(v.observations)


@query("error_observations", sql="""
SELECT experiment_id, task_id, prediction_id, model_version, error FROM observations
WHERE error IS NOT NULL""")
def error_observations(v: Inputs) -> DataFrame:
    return R.error_observations(v.observations).select(
        "experiment_id", "task_id", "prediction_id", "model_version", "error")


@query("flagged_results", sql="""
SELECT experiment_id, prediction_id, error IS NOT NULL AS has_error FROM observations""")
def flagged_results(v: Inputs) -> DataFrame:
    stored = v.observations.withColumn("metric_results", F.to_json(F.struct("score", "error")))
    return stored.select("experiment_id", "prediction_id",
                         R.has_error(F.col("metric_results")).alias("has_error"))
