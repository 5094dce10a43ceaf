"""Counts by table of source and destination."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(source: Mapping[str, DataFrame], selected: Mapping[str, DataFrame]) -> DataFrame:
    """``table, source, dest, ratio`` with a row for each table, in one job; ratio in percent."""
    parts = []
    for name, df in source.items():
        parts.append(df.select(F.lit(name).alias("table"), F.lit(1).alias("s"), F.lit(0).alias("d")))
        if name in selected:
            parts.append(selected[name].select(F.lit(name).alias("table"), F.lit(0).alias("s"), F.lit(1).alias("d")))
        # a table without rows still counts
        parts.append(df.sparkSession.range(1).select(F.lit(name).alias("table"), F.lit(0).alias("s"), F.lit(0).alias("d")))
    every = reduce(DataFrame.unionByName, parts)
    by = every.groupBy("table").agg(F.sum("s").alias("source"), F.sum("d").alias("dest"))
    return by.withColumn("ratio", ratio())


def ratio():
    return F.when(F.col("source") > 0, F.round(F.lit(100.0) * F.col("dest") / F.col("source"), 1)).otherwise(F.lit(0.0))


def totals(report: DataFrame) -> DataFrame:
    both = report.agg(F.sum("source").alias("source"), F.sum("dest").alias("dest"))
    return both.select(F.lit("TOTAL").alias("table"), "source", "dest").withColumn("ratio", ratio())


def tabulate(report: DataFrame, elapsed: float | None = None) -> str:
    """The report as text; negative counts of estimates show as 0."""
    rows = sorted(report.collect(), key=lambda r: r["table"])
    cells = [("Table", "Source", "Dest", "Ratio")]
    total = [0, 0]
    for r in rows:
        s, d = max(0, r["source"]), max(0, r["dest"])
        total = [total[0] + s, total[1] + d]
        cells.append((r["table"], f"{s:,}", f"{d:,}", f"{100 * d / s if s else 0:.1f}%"))
    cells.append(("TOTAL", f"{total[0]:,}", f"{total[1]:,}", f"{100 * total[1] / total[0] if total[0] else 0:.1f}%"))
    width = [max(len(c[k]) for c in cells) for k in range(4)]
    lines = ["  ".join(c[0].ljust(width[0]) if k == 0 else c[k].rjust(width[k]) for k in range(4)) for c in cells]
    if elapsed is not None:
        lines.append(f"Elapsed: {elapsed:.1f}s")
    return "\n".join(lines)
