"""Set-based upsert with a record of what it did."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConfigError
from . import keys


def dedup(df: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row per identity: the first in the order of all other columns."""
    rest = [keys.col(c).asc_nulls_last() for c in df.columns if c not in identity]
    order = Window.partitionBy(*map(keys.col, identity)).orderBy(*(rest or [F.lit(1)]))
    return df.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")


def _same(identity: Sequence[str], left: str, right: str) -> Column:
    """Equal identities; a null is equal to a null."""
    return reduce(Column.__and__, (keys.col(left + c).eqNullSafe(keys.col(right + c)) for c in identity))


def _renamed(df: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(*(keys.col(c).alias(prefix + c) for c in columns or df.columns))


def _checked(identity: Sequence[str]) -> list[str]:
    if not identity:
        raise ConfigError("a merge needs an identity")
    return list(identity)


def changes(current: DataFrame, incoming: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The incoming rows that ``current`` lacks (``_action`` insert) or has with other values (refresh).

    Work grows with the incoming rows: ``current`` is read once, for the rows that have their identities.
    """
    identity = _checked(identity)
    new = dedup(incoming.select(*map(keys.col, current.columns)), identity)
    named = _renamed(new, "_i_", identity)
    old = _renamed(current, "_c_")
    old = old.join(named, _same(identity, "_c_", "_i_"), "left_semi").withColumn("_old", F.lit(True))
    both = new.join(old, _same(identity, "", "_c_"), "left")
    equal = reduce(Column.__and__, (keys.col(c).eqNullSafe(keys.col(f"_c_{c}")) for c in current.columns if c not in identity), F.lit(True))
    action = F.when(F.col("_old").isNull(), "insert").when(~equal, "refresh")
    return both.select(*map(keys.col, current.columns), action.alias("_action")).where("_action IS NOT NULL")


def without(df: DataFrame, gone: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose identity isn't among those of ``gone``."""
    return df.join(_renamed(gone, "_g_", list(identity)), _same(identity, "", "_g_"), "left_anti")


def merged(current: DataFrame, incoming: DataFrame, identity: Sequence[str]) -> DataFrame:
    """All rows of both with ``_action``: insert, refresh, or keep.

    Incoming values, nulls too, replace others where any differs; ``keep`` rows are as they were.
    """
    identity = _checked(identity)
    rest = [c for c in current.columns if c not in identity]
    new = dedup(incoming.select(*map(keys.col, current.columns)), identity)
    left = _renamed(current, "_c_").withColumn("_old", F.lit(True))
    right = _renamed(new, "_i_").withColumn("_new", F.lit(True))
    both = left.join(right, _same(identity, "_c_", "_i_"), "full_outer")
    equal = reduce(Column.__and__, (keys.col(f"_c_{c}").eqNullSafe(keys.col(f"_i_{c}")) for c in rest), F.lit(True))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull() | equal, "keep").otherwise("refresh")
    take = [F.when(F.col("_new").isNotNull(), keys.col(f"_i_{c}")).otherwise(keys.col(f"_c_{c}")).alias(c) for c in current.columns]
    return both.select(*take, action.alias("_action"))


def delta(actions: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identities written, with ``_inserted``; rows that were kept aren't written."""
    return actions.where("_action <> 'keep'").select(*map(keys.col, identity), (F.col("_action") == "insert").alias("_inserted"))


def latest(phases: Sequence[tuple[DataFrame, bool]], identity: Sequence[str]) -> DataFrame:
    """Rows as the last of several phases' changes left them, with ``_inserted``.

    ``phases``: changes, and whether any of them may be a refresh. A row that any phase inserted stays inserted.
    """
    out = None
    for rows, refreshes in phases:
        rows = rows.withColumn("_inserted", F.col("_action") == "insert").drop("_action")
        if out is not None and refreshes:
            was = out.select(*(keys.col(c).alias(f"_w_{c}") for c in identity), F.col("_inserted").alias("_was"))
            joined = rows.join(was, _same(identity, "", "_w_"), "left").withColumn("_inserted", F.col("_inserted") | F.coalesce("_was", F.lit(False)))
            out, rows = without(out, rows, identity), joined.select(*map(keys.col, rows.columns))
        out = rows if out is None else out.unionByName(rows)
    return out
