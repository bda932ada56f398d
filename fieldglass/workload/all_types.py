"""Evaluation of every declared document type: all metrics, skips and fields with two metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..catalog import FIELDS
from ..operators import evaluation as E
from ..operators import reports as R
from ..sources.tables import spread
from .registry import query
from .scalars import _tokens
from .views import Inputs, r6, sql_date, sql_distance_text, sql_number, sql_similarity

_TYPES = list(FIELDS)
#: What kind of value a field gets, by its first metric.
_KINDS = {"compare_number": "number", "string_date_equality": "date", "token_set_equality": "names", "levenshtein_distance": "name"}


def _kind(metrics: tuple[str, ...]) -> str:
    return _KINDS.get(metrics[0] if metrics else K.DEFAULT_METRIC, "other")


def _values(kind: str, pos: int) -> tuple[str, str]:
    """(expected, predicted) of a field as SQL over ``customer``, the same in both engines."""
    n, case = "c_custkey", f"(c_custkey + {pos}) % 5"
    balance, month, day = "CAST(c_acctbal AS STRING)", f"lpad(CAST({n} % 12 + 1 AS STRING), 2, '0')", f"lpad(CAST({n} % 28 + 1 AS STRING), 2, '0')"
    given = {
        "number": (balance, [f"replace({balance}, '.', ',')", f"concat(' ', {balance}, ' €')", "NULL", "'7'", "'1.2.3'"]),
        "date": (f"concat('2021-', {month}, '-', {day})",
                 [f"concat({day}, '/', {month}, '/2021')", f"concat({day}, {month}, '2021')", "NULL", "'31/02/2021'", f"concat('2021-', {month}, '-28')"]),
        "names": ("concat(c_name, ' ', c_mktsegment)",
                  ["concat(lower(c_mktsegment), '-', c_name)", "c_name", "NULL", "'Élodie Martin'", "concat(c_name, ' / ', c_mktsegment)"]),
        "name": ("c_name", ["lower(c_name)", "replace(c_name, '#', '-')", "NULL", "substr(c_name, 1, 12)", "'Élodie Martin'"]),
        "other": ("c_mktsegment", ["c_mktsegment", "lower(c_mktsegment)", "NULL", "c_mktsegment", "'x'"]),
    }[kind]
    whens = " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(given[1]))
    expected = f"CASE WHEN c_custkey % 7 = {pos % 7} THEN NULL ELSE {given[0]} END"
    return expected, f"CASE {case} {whens} END"


def _fields_sql() -> str:
    """Long values of all declared fields: one SELECT per type and field."""
    parts = []
    for t, (name, fields) in enumerate(FIELDS.items()):
        for pos, (field, _, metrics) in enumerate(fields):
            expected, predicted = _values(_kind(metrics), pos)
            for metric in metrics or (K.DEFAULT_METRIC,):
                parts.append(f"SELECT c_custkey AS task_id, '{name}' AS document_type, '{field}' AS field, '{metric}' AS metric,"
                             f" {expected} AS expected, {predicted} AS predicted FROM customer WHERE c_custkey % {len(_TYPES)} = {t}")
    return " UNION ALL ".join(parts)


_EXP, _PRED = sql_distance_text("expected"), sql_distance_text("predicted")
_SCORED = f"""
v AS ({_fields_sql()}),
s AS (SELECT *, CASE metric WHEN 'skip' THEN -1.0::DOUBLE
  WHEN 'compare_number' THEN CASE WHEN {sql_number('expected')} IS NOT DISTINCT FROM {sql_number('predicted')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN 'string_date_equality' THEN CASE WHEN {sql_date('expected')} = {sql_date('predicted')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN 'token_set_equality' THEN CASE WHEN {_tokens('expected')} = {_tokens('predicted')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  WHEN 'levenshtein_distance' THEN {sql_similarity(_EXP, _PRED)}
  ELSE CASE WHEN expected IS NOT DISTINCT FROM predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS score,
  CASE WHEN metric = 'levenshtein_distance' THEN CAST(levenshtein({_EXP}, {_PRED}) AS INT) END AS distance FROM v)
"""


def typed_pairs(v: Inputs) -> DataFrame:
    """A prediction per customer, its document type by number, with all declared fields as maps."""
    kinds, truths, predictions = [], [], []
    for t, (name, fields) in enumerate(FIELDS.items()):
        sides: tuple[list[str], list[str]] = ([], [])
        for pos, (field, _, metrics) in enumerate(fields):
            for side, value in zip(sides, _values(_kind(metrics), pos)):
                side.append(f"named_struct('k', '{field}', 'v', {value})")
        when = f"WHEN {t} THEN "
        kinds.append(f"{when}'{name}'")
        for made, side in zip((truths, predictions), sides):
            made.append(f"{when}map_from_entries(filter(array({', '.join(side)}), e -> e.v IS NOT NULL))")
    chosen = lambda whens: F.expr(f"CASE c_custkey % {len(_TYPES)} {' '.join(whens)} END")
    return spread(v.customer, "c_custkey").select(
        F.col("c_custkey").alias("task_id"), F.concat(F.lit("model-"), (F.col("c_custkey") % 3).cast("string")).alias("model_version"),
        F.col("c_custkey").alias("prediction_id"), chosen(kinds).alias("document_type"), chosen(truths).alias("truth"),
        chosen(predictions).alias("prediction"), F.lit(None).cast("double").alias("processing_time_ms"),
    )


@query("typed_field_scores", sql=f"WITH {_SCORED} SELECT task_id, document_type, field, metric, round(score, 6) AS score, distance FROM s")
def typed_field_scores(v: Inputs) -> DataFrame:
    return E.field_scores(typed_pairs(v)).select("task_id", "document_type", "field", "metric", r6("score").alias("score"), "distance")


@query("typed_observations", sql=f"""WITH {_SCORED}
SELECT task_id, document_type, round(coalesce(avg(score) FILTER (WHERE score <> -1), 0.0), 6) AS score,
  CAST(count(*) FILTER (WHERE score <> -1) AS INT) AS evaluated_fields, CAST(count(*) FILTER (WHERE score = -1) AS INT) AS skipped_fields,
  count(*) - count(DISTINCT field) AS second_metrics FROM s GROUP BY 1, 2""")
def typed_observations(v: Inputs) -> DataFrame:
    found = E.observations(typed_pairs(v))
    fields = F.array_distinct(F.transform("field_scores", lambda f: f["field"]))
    return found.select("task_id", "document_type", r6("score").alias("score"), "evaluated_fields", "skipped_fields",
                        (F.size("field_scores") - F.size(fields)).cast("bigint").alias("second_metrics"))


@query("typed_field_stats", sql=f"""WITH {_SCORED}
SELECT 'model-' || (task_id % 3) AS model_version, field, metric, CASE WHEN NOT bool_and(score = -1) THEN round(avg(score), 6) END AS mean,
  count(*) AS count, bool_and(score = -1) AS is_skipped FROM s GROUP BY ALL""")
def typed_field_stats(v: Inputs) -> DataFrame:
    stats = R.field_metric_stats(E.field_scores(typed_pairs(v)))
    return stats.select("model_version", "field", "metric", r6("mean").alias("mean"), "count", "is_skipped")
