"""Typed properties: structs to (name, value, type) lists, filters, typed parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import FIELDS, properties_ddl
from ..constants import OTHER_TYPE
from .numbers import ColumnOrName, _c


def infer_ui_type(dtype: T.DataType) -> str:
    """Display type of a declared type."""
    if isinstance(dtype, T.ArrayType):
        return "list"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "object"


def _value_text(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(dtype, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(dtype, T.TimestampType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssxxx")
    if isinstance(dtype, T.DecimalType):
        return value.cast("double").cast("string")
    if isinstance(dtype, T.StructType):
        return F.when(value.isNotNull(), F.to_json(to_properties(value, dtype)))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value), lambda e: property_struct(e["key"], e["value"], "string")
        )
        return F.when(value.isNotNull(), F.to_json(entries))
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, T.StructType):
            items = F.transform(
                value,
                lambda x: property_struct(F.lit("item"), F.to_json(to_properties(x, inner)), "object"),
            )
            return F.when(value.isNotNull(), F.to_json(items))
        return F.when(value.isNotNull(), F.to_json(value))
    return value.cast("string")


def property_struct(name: Column, value: Column, ui_type: str) -> Column:
    return F.struct(
        name.alias("name"), value.cast("string").alias("value"), F.lit(ui_type).alias("type")
    )


def to_properties(value: Column, dtype: T.StructType) -> Column:
    """Struct to an array of (name, value text, type), in declared order.

    Nested structs become JSON property lists typed ``object``; lists of structs
    become lists of ``item`` objects. Depth follows the declared type. Maps must
    have text values.
    """
    for f in dtype.fields:
        if isinstance(f.dataType, T.MapType) and not isinstance(f.dataType.valueType, T.StringType):
            raise TypeError(f"map field '{f.name}' must have string values")
    return F.array(
        *[
            property_struct(
                F.lit(f.name), _value_text(value[f.name], f.dataType), infer_ui_type(f.dataType)
            )
            for f in dtype.fields
        ]
    )


def truthy_properties(properties: ColumnOrName) -> Column:
    """Keep properties whose name and value are both set; zero, false and empty are not."""

    def falsy(p: Column) -> Column:
        value, ui_type = p["value"], p["type"]
        return (
            value.isNull()
            | (value == "")
            | ((ui_type == "number") & (value.try_cast("double") == 0))
            | ((ui_type == "boolean") & (F.lower(value) == "false"))
            | (ui_type.isin("list", "object") & value.isin("[]", "{}"))
        )

    return F.filter(
        _c(properties),
        lambda p: F.coalesce((p["name"] != "") & ~F.coalesce(falsy(p), F.lit(False)), F.lit(False)),
    )


def typed_extraction(document_type: ColumnOrName, properties: ColumnOrName) -> Column:
    """JSON properties re-read under the schema of their document type.

    Unknown types, the catch-all type and unreadable texts keep the raw text.
    Null fields disappear on output.
    """
    kind, raw = _c(document_type), _c(properties)
    typed = F.when(kind == OTHER_TYPE, raw)
    for name in FIELDS:
        parsed = F.from_json(raw, properties_ddl(name), {"mode": "PERMISSIVE"})
        readable = F.try_parse_json(raw).isNotNull()
        typed = typed.when((kind == name) & readable, F.to_json(parsed))
    return typed.otherwise(raw)
