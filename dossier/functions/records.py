"""Flattening of JSON and XML records to readable text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip


def _typed_entries(raw: Column) -> Column:
    """Entries of a JSON object in document order: ``struct(key, text, kind)``.

    The text comes from a string map, the kind from the same map read as
    variants, so the string ``"0"`` and the number ``0`` stay apart.
    """
    as_text = F.map_entries(F.from_json(raw, "map<string,string>"))
    as_kind = F.transform(
        F.map_entries(F.from_json(raw, "map<string,variant>")),
        lambda e: F.schema_of_variant(e["value"]),
    )
    return F.zip_with(
        as_text,
        as_kind,
        lambda e, kind: F.struct(e["key"].alias("key"), e["value"].alias("text"), kind.alias("kind")),
    )


def _is_object(kind: Column) -> Column:
    return kind.startswith("OBJECT")


def _truthy(text: Column, kind: Column) -> Column:
    number = text.try_cast("double")
    return (
        F.when(text.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "STRING", text != "")
        .when(kind == "BOOLEAN", text == "true")
        .when(_is_object(kind), kind != "OBJECT<>")
        .when(kind.startswith("ARRAY"), text != "[]")
        .otherwise(F.coalesce(number != 0.0, F.lit(True)))
    )


def _shown(text: Column, kind: Column) -> Column:
    """How a scalar prints: booleans and null are capitalised words."""
    return (
        F.when(kind == "BOOLEAN", F.initcap(text))
        .when(F.coalesce(kind, F.lit("VOID")) == "VOID", F.lit("None"))
        .otherwise(text)
    )


def _join_entries(entries: Column) -> Column:
    kept = F.filter(entries, lambda e: _truthy(e["text"], e["kind"]))
    parts = F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), _shown(e["text"], e["kind"])))
    return F.array_join(parts, " ")


def flatten_json(raw: Column) -> Column:
    """``k: v k: v`` of a JSON object, falsy values left out; nested values print as JSON."""
    return _join_entries(_typed_entries(raw))


def flatten_columns(columns: Sequence[str], schema: T.StructType) -> Column:
    """``k: v k: v`` of known columns, falsy values (null, empty, zero, false) left out."""
    parts = []
    for name in columns:
        kind = schema[name].dataType
        value = F.col(name)
        if isinstance(kind, T.BooleanType):
            keep, shown = value, F.lit("True")
        elif isinstance(kind, T.NumericType):
            keep, shown = value != 0, value.cast("string")
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            keep, shown = F.size(value) > 0, F.to_json(value)
        elif isinstance(kind, T.StructType):
            keep, shown = value.isNotNull(), F.to_json(value)
        else:
            keep, shown = value.cast("string") != "", value.cast("string")
        parts.append(F.when(keep, F.concat(F.lit(f"{name}: "), shown)))
    return F.concat_ws(" ", *parts)


def json_texts(raw: Column) -> Column:
    """Record texts of one JSON document of unknown shape.

    A list gives one text per item, an object of objects one per value, any
    other object or scalar a single text. An empty object gives none.
    """
    item_text = F.from_json(raw, "array<string>")
    item_kind = F.transform(F.from_json(raw, "array<variant>"), lambda v: F.schema_of_variant(v))
    from_list = F.zip_with(
        item_text,
        item_kind,
        lambda text, kind: F.when(_is_object(F.coalesce(kind, F.lit("VOID"))), flatten_json(text)).otherwise(
            _shown(text, kind)
        ),
    )
    entries = _typed_entries(raw)
    from_object = F.when(
        F.forall(entries, lambda e: _is_object(F.coalesce(e["kind"], F.lit("VOID")))),
        F.transform(entries, lambda e: flatten_json(e["text"])),
    ).otherwise(F.array(_join_entries(entries)))
    value = F.try_parse_json(raw)
    scalar = F.array(_shown(value.cast("string"), F.schema_of_variant(value)))
    opening = F.substring(strip(raw), 1, 1)
    return F.when(opening == "[", from_list).when(opening == "{", from_object).when(value.isNotNull(), scalar)


def xml_text(columns: Sequence[str], body: str = "_VALUE") -> Column:
    """Element text followed by `` tag: text`` for each child, in the given order.

    An empty child reads as ``""`` and is kept as ``tag: ``; an absent one is
    null and leaves no trace.
    """
    parts = [F.coalesce(F.col(body), F.lit(""))]
    for name in columns:
        parts.append(F.coalesce(F.concat(F.lit(f" {name}: "), F.col(name).cast("string")), F.lit("")))
    return strip(F.concat(*parts))
