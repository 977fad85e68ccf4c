"""References to stored files inside records of any shape, moved to another home by expressions that follow the schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields by which a struct is known as a reference to an artifact.
REFERENCE = {"kind", "uri", "media_type"}


def is_reference(kind: T.StructType) -> bool:
    return REFERENCE <= set(kind.fieldNames())


def holds(kind: T.DataType, marked: Callable[[T.StructType], bool]) -> bool:
    """Whether a type has a marked struct anywhere, map keys left out."""
    if isinstance(kind, T.StructType):
        return marked(kind) or any(holds(f.dataType, marked) for f in kind)
    if isinstance(kind, T.ArrayType):
        return holds(kind.elementType, marked)
    return isinstance(kind, T.MapType) and holds(kind.valueType, marked)


def rewritten(value: Column, kind: T.DataType, change: Callable[[Column, T.StructType], Column], marked: Callable[[T.StructType], bool] = is_reference) -> Column:
    """The value with ``change`` applied to each marked struct in it, however deep; nulls stay null, all else stays as it is.

    Structs within a marked one are rewritten first. Parts without a marked struct are not taken apart.
    """
    if not holds(kind, marked):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, change, marked))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: rewritten(x, kind.valueType, change, marked))
    inner = F.struct(*[rewritten(value.getField(f.name), f.dataType, change, marked).alias(f.name) for f in kind])
    return F.when(value.isNotNull(), change(inner, kind) if marked(kind) else inner)


def rewrite_references(rows: DataFrame, change: Callable[[Column, T.StructType], Column], marked: Callable[[T.StructType], bool] = is_reference) -> DataFrame:
    return rows.select(*[rewritten(F.col(f"`{f.name}`"), f.dataType, change, marked).alias(f.name) for f in rows.schema])


def moved(old: str, new: str) -> Callable[[Column, T.StructType], Column]:
    """A change that gives references below the folder ``old`` the folder ``new``; others stay."""
    old, new = old.rstrip("/") + "/", new.rstrip("/") + "/"

    def change(ref: Column, kind: T.StructType) -> Column:
        uri = ref.getField("uri")
        return ref.withField("uri", F.when(uri.startswith(old), F.concat(F.lit(new), F.substring(uri, len(old) + 1, 1 << 30))).otherwise(uri))

    return change


def references(rows: DataFrame, key: str, marked: Callable[[T.StructType], bool] = is_reference) -> DataFrame:
    """(key, uri): the references of each record, a row each, found by the schema alone."""

    def found(value: Column, kind: T.DataType) -> Column:
        none = F.array().cast("array<string>")
        if not holds(kind, marked):
            return none
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.flatten(F.transform(value, lambda x: found(x, kind.elementType))), none)
        if isinstance(kind, T.MapType):
            return F.coalesce(F.flatten(F.transform(F.map_values(value), lambda x: found(x, kind.valueType))), none)
        own = F.array(value.getField("uri")) if marked(kind) else none
        parts = [found(value.getField(f.name), f.dataType) for f in kind if holds(f.dataType, marked)]
        return F.when(value.isNotNull(), F.concat(own, *parts)).otherwise(none)

    all_ = [found(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema if holds(f.dataType, marked)]
    return rows.select(key, F.explode(F.concat(*all_)).alias("uri")) if all_ else rows.select(key, F.lit("").alias("uri")).limit(0)
