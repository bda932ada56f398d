"""Field-by-field evaluation of predictions against ground truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import checks_by_type, default_checks
from ..constants import SKIP_SCORE
from ..functions import labels, metrics, text
from ..session import scratch_dir

UNKNOWN_MODEL = "Unknown"


def pair_predictions(
    tasks: DataFrame, document_type: str | None = None, require_non_empty: bool = False
) -> DataFrame:
    """Each prediction of a task with the task's first ground truth.

    Truth and predictions sit in the same row, so this is an explode, not a join.
    """
    truth = labels.first_ground_truth("annotations", require_non_empty)
    pairs = (
        tasks.withColumn("truth_results", truth)
        .filter(F.col("truth_results").isNotNull())
        .withColumn("truth", labels.results_to_map("truth_results"))
        .select(
            F.col("id").alias("task_id"),
            F.col("data.document_type").alias("task_type"),
            "truth",
            F.explode("predictions").alias("p"),
        )
        .withColumn("prediction", labels.results_to_map("p.result"))
    )
    return pairs.select(
        "task_id",
        F.coalesce("p.model_version", F.lit(UNKNOWN_MODEL)).alias("model_version"),
        F.col("p.id").alias("prediction_id"),
        labels.infer_document_type(
            document_type,
            F.try_element_at("prediction", F.lit("type")),
            F.try_element_at("truth", F.lit("type")),
            F.col("task_type"),
        ).alias("document_type"),
        "truth",
        "prediction",
        labels.processing_time("p.result").alias("processing_time_ms"),
    )


def join_split_tables(predictions: DataFrame, truths: DataFrame, key: str = "task_id") -> DataFrame:
    """The same pairing when truth and predictions are stored apart.

    Tables written by ``write_bucketed`` on the key join bucket by bucket, without a shuffle.
    """
    return predictions.join(truths, key)


def align_fields(pairs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Adds ``checks``: one struct per declared field and metric with both values.

    Driven by the catalog: a missing value is null, undeclared fields are ignored.
    ``checks`` is null when the document type has no declared fields.
    """
    checks = default_checks(pairs.sparkSession) if catalog is None else checks_by_type(catalog)
    by_type = checks.withColumnRenamed("document_type", "catalog_type")
    joined = pairs.join(
        F.broadcast(by_type), F.lower(pairs["document_type"]) == by_type["catalog_type"], "left"
    )
    return joined.withColumn(
        "checks",
        F.transform(
            "checks",
            lambda c: F.struct(
                c["field"].alias("field"),
                c["metric"].alias("metric"),
                F.try_element_at("truth", c["field"]).alias("expected"),
                F.try_element_at("prediction", c["field"]).alias("predicted"),
            ),
        ),
    ).drop("catalog_type")


def field_scores(pairs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Long fact table: one row per prediction, declared field and metric."""
    flat = align_fields(pairs, catalog).select(
        "task_id", "model_version", "prediction_id", "document_type", F.inline("checks")
    )
    edit = F.col("metric") == "levenshtein_distance"
    compared = flat.withColumn("edit", F.when(edit, text.edit_comparison("expected", "predicted")))
    others = metrics.score(F.col("metric"), "expected", "predicted", without=("levenshtein_distance",))
    return compared.withColumns(
        {
            "score": F.when(edit, F.col("edit.similarity")).otherwise(others),
            "distance": F.col("edit.distance"),
        }
    ).drop("edit")


def deep_json_scores(pairs: DataFrame, expected: str = "expected", predicted: str = "predicted",
                     levels: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``score``: deep equality of two JSON columns of any depth, list order ignored.

    Unless ``levels`` is given, one pass over the pairs that differ finds how deep they nest,
    so that the comparison opens every level there is. The same pass counts the patterns of
    short pairs. Where they recur, each is compared once and its pairs look the score up; all
    other pairs are compared in their row. ``keep`` names the columns wanted beside the score:
    few ones are written with the patterns, so that no pattern is made twice. Without it all
    columns are returned and only the counts are written.
    """
    e, p = F.col(expected), F.col(predicted)
    kept = pairs.columns if keep is None else keep
    if levels is not None:
        return _deep_compared(pairs, levels, lambda compare: compare(e, p)).select(*kept, "score")
    spark, path = pairs.sparkSession, scratch_dir(pairs.sparkSession, "json-patterns")
    named = pairs.withColumn("_pattern", metrics.json_pattern(e, p))
    # texts of one shape have the same brackets, which are walked through once
    brackets = F.concat_ws(metrics.PATTERN_BREAK, metrics.json_brackets(e), metrics.json_brackets(p))
    alone = F.when(F.col("_pattern").isNull() & ~e.eqNullSafe(p), brackets)
    rows = named.select(*kept, "_pattern", alone.alias("_brackets"))
    if keep is not None:
        rows.write.parquet(f"{path}/rows")
        rows = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    counts = rows.groupBy("_pattern", "_brackets").agg(F.count(F.lit(1)).alias("pairs"))
    counts.filter(F.coalesce("_pattern", "_brackets").isNotNull()).write.parquet(f"{path}/counts")
    found = spark.read.schema("_pattern string, _brackets string, pairs long").parquet(f"{path}/counts")
    sides = F.explode(F.split(F.coalesce("_pattern", "_brackets"), metrics.PATTERN_BREAK))
    shapes = found.select(sides.alias("text")).select(metrics.json_brackets("text").alias("shape")).distinct()
    levels = shapes.agg(F.max(metrics.json_depth("shape")).alias("depth")).first()["depth"] or 0
    seen = found.agg(
        F.count("_pattern").alias("patterns"), F.count("_brackets").alias("alone"),
        F.sum(F.when(F.col("_pattern").isNotNull(), F.col("pairs"))).alias("pairs"),
    ).first()
    if not seen["patterns"] or seen["patterns"] * 4 > seen["pairs"]:
        return _deep_compared(pairs, levels, lambda compare: compare(e, p)).select(*kept, "score")
    texts = F.split("_pattern", metrics.PATTERN_BREAK)
    recurring = found.filter(F.col("_pattern").isNotNull()).select("_pattern", texts.alias("texts"))
    known = _deep_compared(recurring, levels, lambda compare: compare(F.col("texts")[0], F.col("texts")[1]))
    known = known.select(F.col("_pattern").alias("_known"), F.col("score").alias("_known_score"))
    if keep is not None and not seen["alone"]:  # a pair without a pattern is one of equal texts
        scored = rows.join(known, rows["_pattern"] == known["_known"], "left")
        return scored.select(*kept, F.coalesce("_known_score", F.lit(1.0)).alias("score"))
    joined = named.join(known, named["_pattern"] == known["_known"], "left")
    scored = _deep_compared(joined, levels, lambda compare: F.coalesce("_known_score", compare(e, p)))
    return scored.select(*kept, "score")


def _deep_compared(table: DataFrame, levels: int, score: Callable[[Callable], Column]) -> DataFrame:
    """Adds ``score``, made with a deep comparison that opens so many levels of nesting."""
    spark, setting = table.sparkSession, "spark.sql.analyzer.maxIterations"
    # names of a level are resolved after those of the level around it
    before = spark.conf.get(setting)
    spark.conf.set(setting, max(int(before), 8 * levels + 50))
    try:
        return table.withColumn("score", score(lambda e, p: metrics.compare_deep_json(e, p, levels + 1)))
    finally:
        spark.conf.set(setting, before)


def fold_scores(scores: Column) -> tuple[Column, Column, Column]:
    """(overall score, evaluated, skipped) of an array of score structs."""
    evaluated = F.filter(scores, lambda s: s["score"] != SKIP_SCORE)
    n = F.size(evaluated)
    total = F.aggregate(evaluated, F.lit(0.0), lambda acc, s: acc + s["score"])
    overall = F.when(n > 0, total / n).otherwise(0.0)
    return overall, n, F.size(scores) - n


def observations(pairs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One observation per prediction with its overall score, computed inside the row.

    A missing document type gives an error observation that counts as skipped; a
    type without declared fields gives an error observation that counts as processed.
    No shuffle: the fields of one prediction never leave their row.
    """
    aligned = align_fields(pairs, catalog)
    scored = aligned.withColumn(
        "field_scores",
        F.transform(
            "checks",
            lambda c: F.struct(
                c["field"].alias("field"),
                c["metric"].alias("metric"),
                metrics.score(c["metric"], c["expected"], c["predicted"]).alias("score"),
            ),
        ),
    )
    overall, evaluated, skipped = fold_scores(F.col("field_scores"))
    known = F.col("field_scores").isNotNull()
    error = F.when(
        F.col("document_type").isNull(),
        F.concat(F.lit("Could not infer document_type for task "), F.col("task_id").cast("string")),
    ).when(
        ~known,
        F.concat(F.lit("Failed to load schema for document_type '"), "document_type", F.lit("'")),
    )
    return scored.select(
        "task_id",
        "model_version",
        "prediction_id",
        "document_type",
        F.when(known, overall).otherwise(0.0).alias("score"),
        "field_scores",
        F.when(known, evaluated).otherwise(0).alias("evaluated_fields"),
        F.when(known, skipped).otherwise(0).alias("skipped_fields"),
        error.alias("error"),
        F.col("document_type").isNull().alias("skipped"),
        "processing_time_ms",
    )


def overall_scores(long_scores: DataFrame) -> DataFrame:
    """The overall score from the long table, for scores that were stored that way."""
    counted = F.col("score") != SKIP_SCORE
    return long_scores.groupBy("task_id", "model_version", "prediction_id").agg(
        F.coalesce(F.avg(F.when(counted, F.col("score"))), F.lit(0.0)).alias("overall_score"),
        F.count_if(counted).alias("evaluated_fields"),
        F.count_if(~counted).alias("skipped_fields"),
    )


def skipped_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that cannot be evaluated, with the reason."""
    no_truth = labels.first_ground_truth("annotations").isNull()
    no_predictions = F.coalesce(F.size("predictions"), F.lit(0)) <= 0
    reason = F.when(no_truth, "no ground truth").when(no_predictions, "no predictions")
    return tasks.select(F.col("id").alias("task_id"), reason.alias("reason")).filter(
        F.col("reason").isNotNull()
    )


def evaluation_counters(tasks: DataFrame, document_type: str | None = None) -> DataFrame:
    """Run totals: tasks, processed predictions, and skips of tasks and predictions mixed."""
    truth = labels.first_ground_truth("annotations")

    def typed(results: Column) -> Column:
        return F.exists(
            results, lambda r: (r["from_name"] == "type") & (F.size(r["value"]["text"]) > 0)
        )

    known_for_all = (
        F.lit(document_type is not None)
        | F.col("data.document_type").isNotNull()
        | F.coalesce(typed(truth), F.lit(False))
    )
    n = F.greatest(F.coalesce(F.size("predictions"), F.lit(0)), F.lit(0))
    own_type = F.size(F.filter("predictions", lambda p: F.coalesce(typed(p["result"]), F.lit(False))))
    processed = (
        F.when(truth.isNull() | (n == 0), 0).when(known_for_all, n).otherwise(own_type)
    )
    skipped = F.when(truth.isNull() | (n == 0), 1).otherwise(n - processed)
    return tasks.select(processed.alias("p"), skipped.alias("s")).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("processed_count"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("skipped_count"),
    )


def dataset_stats(tasks: DataFrame) -> DataFrame:
    """Tasks, tasks with annotations, tasks with an annotation somebody completed."""
    annotated = F.coalesce(F.size("annotations"), F.lit(0)) > 0
    completed = F.exists("annotations", lambda a: F.coalesce(a["completed_by"] != "", F.lit(False)))
    return tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(annotated).alias("annotated_tasks"),
        F.count_if(F.coalesce(completed, F.lit(False))).alias("completed_tasks"),
    )


def project_task_counts(tasks: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Tasks per project; a project without a title is called ``Project {id}``."""
    counts = tasks.groupBy("project").agg(F.count(F.lit(1)).alias("task_count"))
    if projects is not None:
        counts = counts.join(projects.select("project", "title"), "project", "left")
    else:
        counts = counts.withColumn("title", F.lit(None).cast("string"))
    named = F.coalesce(
        F.nullif(F.col("title"), F.lit("")),
        F.concat(F.lit("Project "), F.col("project").cast("string")),
    )
    return counts.select("project", named.alias("title"), "task_count")


def success_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Successes, total and exact rate."""
    good = F.count_if(F.coalesce(F.col("success"), F.lit(False)))
    total = F.count(F.lit(1))
    return results.groupBy(*keys).agg(
        good.alias("success_count"),
        total.alias("total_count"),
        F.when(total > 0, good / total).otherwise(0.0).alias("success_rate"),
    )


def failed(results: DataFrame) -> DataFrame:
    return results.filter(~F.coalesce(F.col("success"), F.lit(False)))
