"""Reports per model version, field and metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SKIP_SCORE
from .slices import exact_median

SKIPPED = "SKIPPED"


def processing_time_stats(observations: DataFrame, median: bool = True) -> DataFrame:
    """Mean, median, population deviation, min, max and count of known times per model."""
    timed = observations.filter(F.col("processing_time_ms").isNotNull())
    t = F.col("processing_time_ms").cast("double")
    stats = timed.groupBy("model_version").agg(
        F.avg(t).alias("mean_ms"),
        F.stddev_pop(t).alias("std_dev_ms"),
        F.min(t).alias("min_ms"),
        F.max(t).alias("max_ms"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    if not median:
        return stats
    middle = exact_median(timed, ["model_version"], "processing_time_ms", "median_ms")
    return stats.join(
        middle.withColumnRenamed("model_version", "m"), F.col("model_version").eqNullSafe(F.col("m"))
    ).drop("m")


def model_version_stats(observations: DataFrame, *keys: str) -> DataFrame:
    """Mean time and sample count per model version, as one map per group of ``keys``.

    The map holds one entry per model version, after the rows are aggregated.
    """
    per = (
        observations.filter(F.col("processing_time_ms").isNotNull())
        .groupBy(*keys, F.coalesce("model_version", F.lit("Unknown")).alias("mv"))
        .agg(
            F.avg(F.col("processing_time_ms").cast("double")).alias("mean_processing_time_ms"),
            F.count(F.lit(1)).alias("sample_count"),
        )
    )
    entry = F.struct("mv", F.struct("mean_processing_time_ms", "sample_count"))
    return per.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("model_version_stats")
    )


def _unless_skipped(value: Column) -> Column:
    return F.when(~F.bool_and(F.col("score") == SKIP_SCORE), value)


def field_metric_stats(scores: DataFrame) -> DataFrame:
    """Statistics per (model, field, metric). All-skipped groups keep only their count.

    A skip mark among real scores takes part in the mean, as in the original report.
    """
    s = F.col("score")
    return scores.groupBy("model_version", "field", "metric").agg(
        _unless_skipped(F.avg(s)).alias("mean"),
        _unless_skipped(F.stddev_pop(s)).alias("std_dev"),
        _unless_skipped(F.min(s)).alias("min"),
        _unless_skipped(F.max(s)).alias("max"),
        F.count(F.lit(1)).alias("count"),
        F.bool_and(s == SKIP_SCORE).alias("is_skipped"),
    )


#: Columns of a comparison table, at most.
MOST_MODELS = 10_000


def field_metric_by_model(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Rows (field, metric), one column per model: mean with 3 digits (ties to even), or SKIPPED.

    Aggregates first and pivots the few aggregated rows. Without ``models`` Spark
    looks the versions up and refuses more than ``spark.sql.pivotMaxValues``.
    """
    means = scores.groupBy("field", "metric", "model_version").agg(
        F.avg("score").alias("mean"), F.bool_and(F.col("score") == SKIP_SCORE).alias("all_skipped")
    )
    cell = F.when(F.col("all_skipped"), SKIPPED).otherwise(F.format_string("%.3f", F.bround("mean", 3)))
    table = (
        means.withColumn("cell", cell)
        .groupBy("field", "metric")
        .pivot("model_version", models)
        .agg(F.first("cell"))
    )
    return table.fillna(SKIPPED, subset=[c for c in table.columns if c not in ("field", "metric")])


def model_summary(observations: DataFrame) -> DataFrame:
    """Per model: mean overall score, items, errors, mean time in ms."""
    return observations.groupBy("model_version").agg(
        F.avg("score").alias("overall_score"),
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.coalesce(F.col("error") != "", F.lit(False))).alias("errors"),
        F.avg(F.col("processing_time_ms").cast("double")).alias("mean_time_ms"),
    )


STORED = "score double, error string, field_scores map<string,map<string,double>>"


def read_stored(observations: DataFrame) -> DataFrame:
    """Stored observations with their result text read back: ``result`` and ``unreadable``.

    A text without a score cannot be used; a missing text is no error.
    """
    text = F.nullif(F.col("metric_results"), F.lit(""))
    return observations.withColumn("result", F.from_json(text, STORED)).withColumn(
        "unreadable", text.isNotNull() & F.col("result.score").isNull()
    )


def stored_summary(stored: DataFrame) -> DataFrame:
    """Per model: mean score of the readable results, items, errors with the unreadable ones, mean time."""
    failed = F.coalesce(F.col("result.error") != "", F.lit(False)) | F.col("unreadable")
    return stored.groupBy(F.coalesce("model_version", F.lit("Unknown")).alias("model_version")).agg(
        F.avg("result.score").alias("overall_score"),
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(failed).alias("errors"),
        F.avg(F.col("processing_time_ms").cast("double")).alias("mean_time_ms"),
    )


def stored_scores(stored: DataFrame) -> DataFrame:
    """Long scores (model_version, field, metric, score) of the readable results."""
    return (
        stored.filter(~F.col("unreadable"))
        .select(F.coalesce("model_version", F.lit("Unknown")).alias("model_version"), F.explode("result.field_scores").alias("field", "by_metric"))
        .select("model_version", "field", F.explode("by_metric").alias("metric", "score"))
    )


def distinct_field_metric(scores: DataFrame) -> DataFrame:
    return scores.select("field", "metric").distinct()


def distinct_models(observations: DataFrame) -> DataFrame:
    return observations.select(F.coalesce("model_version", F.lit("Unknown")).alias("model_version")).distinct()


def error_observations(observations: DataFrame) -> DataFrame:
    """Observations with an error text."""
    return observations.filter(F.coalesce(F.col("error") != "", F.lit(False)))


def has_error(metric_results: Column) -> Column:
    """Error flag of a stored observation (its results are JSON text)."""
    return F.get_json_object(metric_results, "$.error").isNotNull()


#: A fact of the report: an observation with the scores of its fields.
FACT = ("model_version", "score", "error", "processing_time_ms", "field_scores")


def report_aggregates(facts: DataFrame) -> DataFrame:
    """Everything the report sums up, from one pass over the facts.

    A fact gives one row of its own and one per scored field; grouping sets aggregate the
    first by model and the others by model, field and metric in the same shuffle.
    """
    own = F.struct(
        F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("metric"), F.col("score").alias("s"),
        F.col("error").alias("e"), F.col("processing_time_ms").cast("double").alias("t"), F.lit(0).alias("part"),
    )
    fields = F.transform(F.coalesce("field_scores", F.array().cast("array<struct<field:string,metric:string,score:double>>")), lambda f: F.struct(
        f["field"].alias("field"), f["metric"].alias("metric"), f["score"].alias("s"), F.lit(None).cast("string").alias("e"),
        F.lit(None).cast("double").alias("t"), F.lit(1).alias("part"),
    ))
    rows = facts.select("model_version", F.inline(F.concat(F.array(own), fields)))
    sets = rows.groupingSets(
        [[F.col("model_version"), F.col("part")], [F.col("model_version"), F.col("part"), F.col("field"), F.col("metric")]],
        F.col("model_version"), F.col("part"), F.col("field"), F.col("metric"),
    )
    made = sets.agg(
        F.grouping("field").alias("whole"), F.avg("s").alias("mean"), F.stddev_pop("s").alias("std_dev"), F.min("s").alias("min"),
        F.max("s").alias("max"), F.count(F.lit(1)).alias("count"), F.bool_and(F.col("s") == SKIP_SCORE).alias("is_skipped"),
        F.count_if(F.coalesce(F.col("e") != "", F.lit(False))).alias("errors"), F.avg("t").alias("mean_time_ms"),
    )
    # of the two sets, each part needs one
    return made.filter((F.col("part") == 0) == (F.col("whole") == 1))


def report_from_facts(facts: DataFrame, aggregates: DataFrame, models: list[str] | None = None) -> dict[str, DataFrame]:
    """The whole report: comparison table, summary, times, field statistics, errors.

    ``aggregates`` are those of the facts, a small table; facts themselves are read for exact
    medians and for the rows with an error. The comparison table has a column for every model
    observed, also one with errors only.
    """
    of_models, of_fields = aggregates.filter("part = 0"), aggregates.filter("part = 1")
    if models is None:
        seen = of_models.select(F.coalesce("model_version", F.lit("Unknown")).alias("m")).distinct().orderBy("m").limit(MOST_MODELS + 1).collect()
        if len(seen) > MOST_MODELS:
            raise ValueError(f"more than {MOST_MODELS} models; name those to compare")
        models = [r["m"] for r in seen]
    cell = F.when(F.col("is_skipped"), SKIPPED).otherwise(F.format_string("%.3f", F.bround("mean", 3)))
    table = of_fields.withColumn("cell", cell).groupBy("field", "metric").pivot("model_version", models).agg(F.first("cell"))
    table = table.fillna(SKIPPED, subset=[c for c in table.columns if c not in ("field", "metric")])
    known = {c: F.when(~F.col("is_skipped"), F.col(c)) for c in ("mean", "std_dev", "min", "max")}
    return {
        "field_metric_by_model": table.orderBy("field", "metric"),
        "model_summary": of_models.select(
            "model_version", F.col("mean").alias("overall_score"), F.col("count").alias("total_items"), "errors", "mean_time_ms",
        ).orderBy("model_version"),
        "processing_time_stats": processing_time_stats(facts).orderBy("model_version"),
        "field_metric_stats": of_fields.select(
            "model_version", "field", "metric", *[v.alias(c) for c, v in known.items()], "count", "is_skipped"
        ).orderBy("model_version", "field", "metric"),
        "error_observations": error_observations(facts),
    }


def report_by_model(observations: DataFrame, scores: DataFrame, models: list[str] | None = None,
                    ) -> dict[str, DataFrame]:
    """The whole report: comparison table, summary, times, field statistics, errors.

    The comparison table has a column for every model observed, also one with errors only.
    """
    if models is None:
        seen = distinct_models(observations).orderBy("model_version").limit(MOST_MODELS + 1).collect()
        if len(seen) > MOST_MODELS:
            raise ValueError(f"more than {MOST_MODELS} models; name those to compare")
        models = [r["model_version"] for r in seen]
    return {
        "field_metric_by_model": field_metric_by_model(scores, models).orderBy("field", "metric"),
        "model_summary": model_summary(observations).orderBy("model_version"),
        "processing_time_stats": processing_time_stats(observations).orderBy("model_version"),
        "field_metric_stats": field_metric_stats(scores).orderBy("model_version", "field", "metric"),
        "error_observations": error_observations(observations),
    }
