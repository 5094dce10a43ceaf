"""Columns on their way to the destination."""

from __future__ import annotations

from collections.abc import Collection, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Relationship
from . import keys


def null_broken(df: DataFrame, table: str, relationships: Iterable[Relationship], broken: Collection[tuple[str, str]], kept: Collection[tuple[str, str]] = ()) -> DataFrame:
    """Sets columns of broken relationships to null, but for pairs whose values are kept."""
    gone = {c for r in relationships if r.child == table and r.pair in broken and r.pair not in kept for c in r.child_columns}
    return df.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name in gone else keys.col(f.name) for f in df.schema))


def null_dangling(df: DataFrame, columns: tuple[str, ...], parent: DataFrame, parent_columns: tuple[str, ...]) -> DataFrame:
    """Sets the columns to null in rows whose parent isn't there."""
    have = keys.ids(parent, parent_columns, "_n").withColumn("_there", F.lit(True))
    joined = df.join(have, keys.on(columns, "_n"), "left")
    return joined.select(*(F.when(F.col("_there"), keys.col(c)).alias(c) if c in columns else keys.col(c) for c in df.columns))


def without_generated(df: DataFrame, generated: Collection[str]) -> DataFrame:
    return df.drop(*generated)
