"""Sets of key tuples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def ids(df: DataFrame, columns: Sequence[str], prefix: str = "_k") -> DataFrame:
    """Distinct key tuples without nulls, as ``_k0, _k1, ...`` in their own types.

    The new names keep joins with the table that they come from unambiguous.
    """
    named = [col(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)]
    return df.select(*named).na.drop("any").distinct()


def union_ids(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sets).distinct()


def like(ids: DataFrame, df: DataFrame, columns: Sequence[str], prefix: str = "_k") -> DataFrame:
    """An id set in the types of the columns that it is held against; values that have none match nothing."""
    types = {f"{prefix}{i}": df.schema[c].dataType for i, c in enumerate(columns)}
    if all(ids.schema[k].dataType == t for k, t in types.items()):
        return ids
    return ids.select(*(F.col(f.name).try_cast(types[f.name]).alias(f.name) if f.name in types else F.col(f.name) for f in ids.schema))


def on(columns: Sequence[str], prefix: str = "_k", left: DataFrame | None = None) -> Column:
    """Pairwise equality of ``columns`` with an id set's columns."""
    own = (col(c) if left is None else left[c] for c in columns)
    return reduce(Column.__and__, (c == F.col(f"{prefix}{i}") for i, c in enumerate(own)))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(Column.__or__, (col(c).isNull() for c in columns))


def semi(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows whose key is in the set; a bag stays a bag."""
    return df.join(like(keys, df, columns), on(columns), "left_semi")


def absent(df: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """Rows whose key isn't in the set; rows with a null in it are among them."""
    return df.join(like(keys, df, columns), on(columns), "left_anti")


def anti(keys: DataFrame, present: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Tuples of an id set that ``present`` has no row for."""
    have = ids(present, columns, "_p")
    return keys.join(have, reduce(Column.__and__, (F.col(f"_k{i}") == F.col(f"_p{i}") for i in range(len(columns)))), "left_anti")
