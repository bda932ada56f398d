"""Labelling results: list-of-results form to field maps and back, task building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import METADATA_FIELD, TIME_KEY
from .numbers import ColumnOrName, _c
from .text import last_wins_map

RESULT_TYPE = (
    "struct<value:struct<text:array<string>>,from_name:string,to_name:string,"
    "type:string,readonly:boolean>"
)


def _filled(results: Column) -> Column:
    """Results that carry a field name and at least one text."""
    return F.filter(
        results, lambda r: (r["from_name"] != "") & (F.size(r["value"]["text"]) > 0)
    )


def results_to_map(results: ColumnOrName) -> Column:
    """Annotation results to map field -> first text; a repeated field keeps the last."""
    fields = F.filter(_filled(_c(results)), lambda r: r["from_name"] != METADATA_FIELD)
    pairs = F.transform(
        fields,
        lambda r: F.struct(r["from_name"].alias("key"), r["value"]["text"][0].alias("value")),
    )
    return F.coalesce(last_wins_map(pairs), F.create_map().cast("map<string,string>"))


def results_metadata(results: ColumnOrName) -> Column:
    """JSON text of the metadata result, or null."""
    found = F.filter(_filled(_c(results)), lambda r: r["from_name"] == METADATA_FIELD)
    return F.try_element_at(found, F.lit(-1))["value"]["text"][0]


def processing_time(results: ColumnOrName) -> Column:
    """Processing time stored in the metadata result, in milliseconds."""
    return F.get_json_object(results_metadata(results), f"$.{TIME_KEY}").try_cast("double")


def _result(name: Column, text: Column, readonly: bool) -> Column:
    return F.struct(
        F.struct(F.array(text).alias("text")).alias("value"),
        name.alias("from_name"),
        F.lit("pdf").alias("to_name"),
        F.lit("textarea").alias("type"),
        F.lit(readonly).alias("readonly"),
    )


def map_to_results(fields: ColumnOrName, metadata: Column | None = None) -> Column:
    """Map of values to annotation results; null values are left out.

    ``metadata`` is a JSON text; when not null it becomes a read-only last result.
    """
    present = F.filter(F.map_entries(_c(fields)), lambda e: e["value"].isNotNull())
    results = F.transform(
        present, lambda e: _result(e["key"], e["value"].cast("string"), False)
    ).cast(f"array<{RESULT_TYPE}>")
    if metadata is None:
        return results
    extra = F.array(_result(F.lit(METADATA_FIELD), metadata, True)).cast(f"array<{RESULT_TYPE}>")
    return F.when(metadata.isNotNull(), F.concat(results, extra)).otherwise(results)


def create_task(url: ColumnOrName, truth: ColumnOrName) -> Column:
    """Task struct; the ground-truth annotation is there only when truth has fields."""
    fields = _c(truth)
    annotation = F.struct(map_to_results(fields).alias("result"), F.lit(True).alias("ground_truth"))
    return F.struct(
        F.struct(_c(url).alias("pdf")).alias("data"),
        F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, F.array(annotation)).alias("annotations"),
    )


def first_ground_truth(annotations: ColumnOrName, require_non_empty: bool = False) -> Column:
    """Results of the first annotation flagged as ground truth.

    A flagged annotation without results counts as an empty truth unless
    ``require_non_empty`` asks for the first one that has results.
    """

    def flagged(a: Column) -> Column:
        hit = F.coalesce(a["ground_truth"], F.lit(False))
        return hit & (F.coalesce(F.size(a["result"]), F.lit(0)) > 0) if require_non_empty else hit

    chosen = F.try_element_at(F.filter(_c(annotations), flagged), F.lit(1))
    empty = F.array().cast(f"array<{RESULT_TYPE}>")
    return F.when(chosen.isNotNull(), F.coalesce(chosen["result"], empty))


def task_url(base: str, project: ColumnOrName, task: ColumnOrName) -> Column:
    return F.concat(project_url(base, project), F.lit("?task="), _c(task).cast("string"))


def project_url(base: str, project: ColumnOrName) -> Column:
    root = F.lit(base.rstrip("/"))
    return F.concat(root, F.lit("/projects/"), _c(project).cast("string"), F.lit("/data"))


def infer_document_type(explicit: str | None, *candidates: Column) -> Column:
    """First available type: the explicit one, then the candidates in order."""
    given = [F.lit(explicit)] if explicit else []
    return F.coalesce(*given, *candidates, F.lit(None).cast("string"))
