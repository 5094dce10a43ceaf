"""Integrity of a result: what constraints would have enforced."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Relationship, UniqueKey
from .operators import keys


class IntegrityError(ValueError):
    """A result that breaks declared constraints."""


def orphans(child: DataFrame, relationship: Relationship, parent: DataFrame) -> DataFrame:
    """Rows whose non-null key has no parent."""
    full = child.where(~keys.any_null(relationship.child_columns))
    return full.join(keys.ids(parent, relationship.parent_columns), keys.on(relationship.child_columns), "left_anti")


def duplicates(df: DataFrame, key: UniqueKey) -> DataFrame:
    """Key values, none of them null, with more than one row, and how many."""
    if key.predicate:
        df = df.where(F.expr(key.predicate))
    df = df.where(~keys.any_null(key.columns))
    return df.groupBy(*map(keys.col, key.columns)).agg(F.count("*").alias("rows")).where("rows > 1")


def violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a check is false; unknown passes."""
    return df.where(~F.expr(f"({condition})"))


def enforce(found: DataFrame) -> None:
    """Raises if any constraint of a report is broken."""
    bad = found.where("violations > 0").collect()
    if bad:
        raise IntegrityError("; ".join(f"{b['kind']} {b['table']} ({b['detail']}): {b['violations']}" for b in bad))


def report(spark: SparkSession, catalog: Catalog, tables: Mapping[str, DataFrame], relationships: tuple[Relationship, ...], touched: Mapping[str, DataFrame] | None = None, moved: Collection[str] = ()) -> DataFrame:
    """``kind, table, detail, violations`` of each constraint between tables of the result.

    With ``touched``, the new and changed rows by table, what held before isn't checked again: foreign keys
    of those rows and keys and checks of those tables are, and foreign keys to parents in ``moved``, of which
    earlier rows have changed.
    """
    parts = []

    def add(kind: str, table: str, detail: str, bad: DataFrame) -> None:
        parts.append(bad.agg(F.count("*").alias("violations")).select(F.lit(kind).alias("kind"), F.lit(table).alias("table"), F.lit(detail).alias("detail"), "violations"))

    for r in relationships:
        if r.child in tables and r.parent in tables:
            rows = tables[r.child] if touched is None or r.parent in moved else touched.get(r.child)
            if rows is not None:
                add("foreign key", r.child, f"({', '.join(r.child_columns)}) -> {r.parent}", orphans(rows, r, tables[r.parent]))
    for name, df in tables.items():
        t = catalog.tables.get(name)
        if t is None or (touched is not None and name not in touched):
            continue
        for key in t.keys:
            if not (key.expression or key.exclusion):
                add("primary key" if key.primary else "unique", name, ", ".join(key.columns), duplicates(df, key))
        for condition in t.checks:
            add("check", name, condition, violations(df, condition))
        for column in t.not_null:
            add("not null", name, column, df.where(keys.col(column).isNull()))
    if not parts:
        return spark.createDataFrame([], "kind string, table string, detail string, violations long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
