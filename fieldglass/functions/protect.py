"""Masking, redaction and other removals of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .numbers import ColumnOrName, _c


def mask_value(value: Column, dtype: T.DataType, rule) -> Column:
    """Apply a mask rule: ``True`` hides the value, a dict of rules goes into structs.

    Lists apply the rule to each item. A hidden value becomes the mask text, null
    stays null. Members without a rule are kept as they are.
    """
    if rule is True:
        return F.when(value.isNotNull(), F.lit(K.MASK))
    if not isinstance(rule, dict):
        return value
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: mask_value(x, dtype.elementType, rule))
    if isinstance(dtype, T.StructType):
        members = [
            mask_value(value[f.name], f.dataType, rule.get(f.name)).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*members))
    if isinstance(dtype, T.MapType):
        # A map has one value type, so a masked entry needs text values.
        return F.transform_values(
            value,
            lambda k, v: F.when(k.isin([n for n, r in rule.items() if r is True] or [""])
                                & v.isNotNull(), F.lit(K.MASK)).otherwise(v),
        )
    return value


def mask(df: DataFrame, rules: dict) -> DataFrame:
    """Mask columns of ``df`` as described by ``rules`` (column -> rule)."""
    return df.select(
        *[
            mask_value(df[f.name], f.dataType, rules.get(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def drop_sensitive_headers(headers: ColumnOrName) -> Column:
    """Header map without credentials; names compare without case."""
    return F.map_filter(_c(headers), lambda k, _: ~F.lower(k).isin(*K.SENSITIVE_HEADERS))


def merge_headers(custom: ColumnOrName) -> Column:
    """Custom headers with the JSON content type forced on top."""
    fixed = "Content-Type"
    kept = F.map_filter(_c(custom), lambda k, _: k != fixed)
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(
        F.coalesce(kept, empty), F.create_map(F.lit(fixed), F.lit("application/json"))
    )


# Members cleared per event type. "payload" clears what events really carry;
# "reference" clears the member names of the original job.
REDACTION_RULES = {
    "payload": {
        K.STARTED: ("s3_file_info", "file_url", "metadata"),
        K.STEP_COMPLETED: ("step_result", "output_data"),
        K.COMPLETED: ("final_result",),
    },
    "reference": {
        K.STARTED: ("file_info", "metadata"),
        K.STEP_COMPLETED: ("final_result",),
    },
}


def redaction_by_column(rules: str = "payload") -> dict[str, list[str]]:
    """Member name -> event types that clear it, for events stored as flat columns."""
    cleared: dict[str, list[str]] = {}
    for event_type, members in REDACTION_RULES[rules].items():
        for member in members:
            cleared.setdefault(member, []).append(event_type)
    return cleared


def redact_payload(event: ColumnOrName, event_type: ColumnOrName, rules: str = "payload") -> Column:
    """Clear members of a JSON payload text; other members keep their place and value.

    Returns null for a payload that is not a JSON object, which the retention job
    turns into the status ERROR.
    """
    members = F.try_variant_get(F.try_parse_json(_c(event)), "$", "map<string,variant>")

    def clear(names: tuple[str, ...]) -> Column:
        empty = F.parse_json(F.lit("{}"))
        return F.transform_values(members, lambda k, v: F.when(k.isin(*names), empty).otherwise(v))

    out = None
    for kind, names in REDACTION_RULES[rules].items():
        hit = _c(event_type) == kind
        out = F.when(hit, clear(names)) if out is None else out.when(hit, clear(names))
    return F.to_json(out.otherwise(members))


def observation_without_values(observation: ColumnOrName) -> Column:
    """Observation JSON reduced to scores: expected and predicted values never parsed.

    The parse schema simply has no member for raw values, so pruning is the redaction.
    """
    schema = (
        "field_scores map<string,map<string,double>>, document_type string, model_type string,"
        " evaluated_fields int, skipped_fields int,"
        " field_details map<string,struct<metrics:array<string>,scores:map<string,double>,"
        "distances:map<string,int>>>, error string"
    )
    parsed = F.from_json(_c(observation), schema)
    return F.to_json(
        F.struct(
            F.coalesce(
                parsed["field_scores"], F.create_map().cast("map<string,map<string,double>>")
            ).alias("field_scores"),
            *[
                parsed[m].alias(m)
                for m in (
                    "document_type", "model_type", "evaluated_fields", "skipped_fields",
                    "field_details", "error",
                )
            ],
        )
    )
