"""Stable fingerprints of rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolex.functions.text import short_hash

# Fields that change without the content changing.
VOLATILE = frozenset({"last_crawled_at", "last_changed_at", "last_seen", "first_seen"})


def canonical(c: Column, kind: T.DataType, drop: frozenset[str] = VOLATILE) -> Column:
    """The value with struct fields sorted by name and volatile ones left out."""
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return F.transform(c, lambda x: canonical(x, kind.elementType, drop))
        return c
    if isinstance(kind, T.StructType):
        kept = sorted((f for f in kind.fields if f.name not in drop), key=lambda f: f.name)
        inner = F.struct(*[canonical(c[f.name], f.dataType, drop).alias(f.name) for f in kept])
        return F.when(c.isNotNull(), inner)
    return c


def content_hash(df: DataFrame, columns: Iterable[str] | None = None, drop: frozenset[str] = VOLATILE) -> Column:
    """Hash of the row as canonical JSON; NULL fields count as absent."""
    names = sorted(c for c in (columns or df.columns) if c not in drop)
    fields = [canonical(F.col(n), df.schema[n].dataType, drop).alias(n) for n in names]
    return short_hash(F.to_json(F.struct(*fields)))


def json_list(*parts: Column) -> Column:
    """JSON text of a list with members of different types."""
    members = [F.regexp_replace(F.to_json(F.array(p)), r"^\[|\]$", "") for p in parts]
    return F.concat(F.lit("["), F.concat_ws(",", *members), F.lit("]"))


def strip_volatile(df: DataFrame, drop: frozenset[str] = VOLATILE) -> DataFrame:
    return df.drop(*drop)
