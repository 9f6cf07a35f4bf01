"""Inputs of decisions as text: one expression built from the schema, no Python per row.

A struct (but a media one) gives one field a child; anything else one field. Nested values are rendered as
``{'a': 1}``, ``[1, 2]`` and ``{k=v}``; what holds media as ``{a: …}`` and ``[…]`` with the media's reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semweave.functions.media import has_media, is_media, reference

RESERVED = ("question", "condition", "")


def field_name(df: DataFrame, value: str | Column) -> str:
    """Column name, alias, or ``document`` where there is none or it is reserved."""
    if isinstance(value, str):
        name = value.split(".")[-1]
    else:
        name = df.select(value).columns[0]
        if not name.replace("_", "").isalnum():
            name = "document"
    return "document" if name in RESERVED else name


def text_of(value: Column, kind: T.DataType, media: bool = False) -> Column:
    """Text of a value of any type."""
    if is_media(kind):
        return reference(value)
    if isinstance(kind, T.StructType):
        name = (lambda n: n) if media else (lambda n: f"'{n}'")
        parts = [F.concat(F.lit(f"{name(f.name)}: "), shown(value.getField(f.name), f.dataType, media)) for f in kind.fields]
        return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: shown(x, kind.elementType, media)), ", "), F.lit("]"))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.concat(shown(e["key"], kind.keyType, media), F.lit("="), shown(e["value"], kind.valueType, media))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), entry), ", "), F.lit("}"))
    return value.cast("string")


def shown(value: Column, kind: T.DataType, media: bool) -> Column:
    return F.coalesce(text_of(value, kind, media), F.lit("NULL"))


def fields_of(df: DataFrame, value: str | Column) -> list[tuple[str, Column]]:
    """(name, text) of an input; null where the input, or a field of a struct, is null."""
    col = F.col(value) if isinstance(value, str) else value
    kind = df.select(col).schema[0].dataType
    if isinstance(kind, T.StructType) and not is_media(kind):
        bad = [f.name for f in kind.fields if f.name in RESERVED]
        if bad:
            raise ValueError(f"a field must not be named {bad[0]!r}")
        return [(f.name, text_of(col.getField(f.name), f.dataType, has_media(f.dataType))) for f in kind.fields]
    return [(field_name(df, value), text_of(col, kind, has_media(kind)))]


def record(df: DataFrame, value: str | Column) -> Column:
    """array<struct<name,value>>, or null if any part is null."""
    parts = fields_of(df, value)
    missing = parts[0][1].isNull()
    for _, text in parts[1:]:
        missing = missing | text.isNull()
    filled = F.array(*(F.struct(F.lit(n).alias("name"), t.alias("value")) for n, t in parts))
    return F.when(~missing, filled)


def side_text(df: DataFrame, value: str | Column) -> Column:
    """One side of a pair: the bare value of one field, ``name: value; name: value`` of several."""
    parts = fields_of(df, value)
    if len(parts) == 1:
        return parts[0][1]
    joined = [x for n, t in parts for x in (F.lit(f"{n}: "), t, F.lit("; "))][:-1]
    return F.concat(*joined)
