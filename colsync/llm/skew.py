"""Joining a table of groups back to its rows when a few groups hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType


def fresh(columns: Iterable[str], name: str) -> str:
    """A name like ``name`` that none of ``columns`` begins with, whatever its case; so ``name_x`` is free as well."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name

#: A group is hot when it holds over one row in this many; so there are fewer hot groups than this.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``groups`` (unique on ``key``, with their row count in ``size``) to ``rows`` of ``total`` rows.

    Groups of more than ``total / HOT_SHARE`` rows are broadcast: by their very
    definition there are fewer than ``HOT_SHARE`` of them, whatever the input.
    Rows of all other groups are shuffled, and none of their keys can fill a task.
    """
    hot = F.col(size) > max(1.0, total / HOT_SHARE)
    found = rows.join(F.broadcast(groups.where(hot).withColumn("_hot", F.lit(True))), key, "left")
    extra = [c for c in groups.columns if c != key]
    first = found.where(F.col("_hot")).select(*rows.columns, *extra)
    rest = found.where(F.col("_hot").isNull()).select(*rows.columns)
    return first.unionByName(rest.join(groups.where(~hot), key, how).select(*rows.columns, *extra))


#: Ids that may be broadcast: some tens of MB in an executor.
MAX_BROADCAST_IDS = 1 << 20


def hashable(value: Column, kind: DataType) -> Column:
    """The value in a form that Spark can hash: maps, at any depth, as lists of their entries in the order they have."""
    if "map<" not in kind.simpleString():
        return value
    if isinstance(kind, MapType):
        entry = StructType([StructField("key", kind.keyType), StructField("value", kind.valueType)])
        return hashable(F.map_entries(value), ArrayType(entry))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: hashable(x, kind.elementType))
    # a null struct stays apart from one of nulls
    return F.when(value.isNotNull(), F.struct(*[hashable(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))


def row_columns(rows: DataFrame) -> list[Column]:
    """All columns of a table, whatever their names and types, for hashing its rows."""
    return [hashable(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema]
