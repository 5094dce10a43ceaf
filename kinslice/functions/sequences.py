"""Where sequences go on after a subset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keys


def next_values(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame | None:
    """``table, column, next``: one more than the largest value, or 1; one scan per table."""
    parts = []
    for name, cols in columns.items():
        if name not in tables or not cols or "pgbench" in name:
            continue
        most = tables[name].agg(*((F.coalesce(F.max(keys.col(c)).cast("long"), F.lit(0)) + 1).alias(c) for c in cols))
        parts.append(most.select(F.lit(name).alias("table"), F.posexplode(F.array(*(F.struct(F.lit(c).alias("column"), keys.col(c).alias("next")) for c in cols))).alias("_", "s")).select("table", "s.column", "s.next"))
    return reduce(DataFrame.unionByName, parts) if parts else None
