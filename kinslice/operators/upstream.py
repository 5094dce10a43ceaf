"""Children of selected rows.

With K the relationships of a child to parents that have been processed, a row is selected if each
of K is neutral (a null in its key) or matches a selected parent, at least one matches, and all
upstream filters hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Relationship, TableRef
from ..config import UpstreamFilter
from . import keys


def filters_for(filters: Iterable[UpstreamFilter], table: str, columns: Sequence[str]) -> list[str]:
    """Conditions on the table itself and on any of its columns."""
    return [f.condition for f in filters if f.table == table or (f.column is not None and f.column in columns)]


#: What a condition is read in: literals and quoted names, which are left alone, names and the rest.
_PARTS = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|[A-Za-z_][\w$]*(?:\s*\.\s*[A-Za-z_][\w$]*)*""")


def unqualified(condition: str, table: TableRef) -> str:
    """A condition whose names with schema and table are by table only."""

    def plain(m: re.Match) -> str:
        path = [part.strip() for part in m[0].split(".")] if m[0][0] not in "'\"`" else []
        return ".".join(path[1:]) if len(path) > 2 and path[:2] == [table.schema, table.name] else m[0]

    return _PARTS.sub(plain, condition) if table.schema else condition


def apply_filters(df: DataFrame, table: str, conditions: Iterable[str]) -> DataFrame:
    """Conditions may name columns bare, by table, or by schema and table."""
    ref = TableRef.parse(table)
    df = df.alias(ref.name)
    for condition in conditions:
        df = df.where(F.expr(f"({unqualified(condition, ref)})"))
    return df


def select_children(
    source: DataFrame,
    relationships: Sequence[Relationship],
    parents: Sequence[DataFrame],
    deltas: Sequence[DataFrame | None] | None = None,
) -> DataFrame:
    """Rows of ``source`` that belong to ``parents``, which are in the order of ``relationships``.

    ``deltas``: rows that each parent has gained; at least one match must then be with those.

    One relationship is a semi join. Several are one pass with a marked outer join for each, on
    distinct ids, so no row is duplicated and duplicates in the source stay.
    """
    if len(relationships) == 1 and deltas is None:
        r = relationships[0]
        return keys.semi(source, r.child_columns, keys.ids(parents[0], r.parent_columns))
    out, neutral_or_matched, matched = source, [], []
    for k, (r, parent) in enumerate(zip(relationships, parents, strict=True)):
        out, hit = _marked(out, r, parent, f"_m{k}")
        neutral_or_matched.append(keys.any_null(r.child_columns) | hit)
        if deltas is None:
            matched.append(hit)
        elif deltas[k] is not None:
            out, new = _marked(out, r, deltas[k], f"_d{k}")
            matched.append(new)
    if not matched:
        return source.where(F.lit(False))
    chosen = reduce(Column.__and__, neutral_or_matched) & reduce(Column.__or__, matched)
    return out.where(chosen).select(*(keys.col(c) for c in source.columns))


def _marked(df: DataFrame, r: Relationship, parent: DataFrame, mark: str) -> tuple[DataFrame, Column]:
    have = keys.like(keys.ids(parent, r.parent_columns, f"{mark}_"), df, r.child_columns, f"{mark}_").withColumn(mark, F.lit(True))
    joined = df.join(have, keys.on(r.child_columns, f"{mark}_"), "left")
    return joined.drop(*(f"{mark}_{i}" for i in range(len(r.parent_columns)))), F.col(mark).isNotNull()
