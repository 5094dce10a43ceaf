"""Parents that selected rows need."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Relationship
from . import keys


def missing_parents(relationships: Sequence[Relationship], children: Sequence[DataFrame], present: DataFrame | None) -> dict[tuple[str, ...], DataFrame]:
    """By the parent's key columns: tuples that children hold and ``present`` (None: empty) doesn't."""
    wanted: dict[tuple[str, ...], list[DataFrame]] = defaultdict(list)
    for r, child in zip(relationships, children, strict=True):
        wanted[r.parent_columns].append(keys.ids(child, r.child_columns))
    sets = {columns: keys.union_ids(some) for columns, some in wanted.items()}
    return sets if present is None else {columns: keys.anti(ids, present, columns) for columns, ids in sets.items()}


def fetch_parents(source: DataFrame, missing: dict[tuple[str, ...], DataFrame]) -> DataFrame:
    """Source rows that any of the missing tuples name, each source row once.

    Tuples without a source row are skipped. One key is a semi join; several are one pass.
    """
    if len(missing) == 1:
        ((columns, ids),) = missing.items()
        return keys.semi(source, columns, ids)
    out, hits = source, []
    for k, (columns, ids) in enumerate(missing.items()):
        named = ids.select(*(F.col(f"_k{i}").alias(f"_m{k}_{i}") for i in range(len(columns))), F.lit(True).alias(f"_m{k}"))
        out = out.join(keys.like(named, source, columns, f"_m{k}_"), keys.on(columns, f"_m{k}_"), "left")
        hits.append(F.col(f"_m{k}").isNotNull())
    return out.where(reduce(Column.__or__, hits)).select(*(keys.col(c) for c in source.columns))


def add_parents(source: DataFrame, present: DataFrame, relationships: Sequence[Relationship], children: Sequence[DataFrame]) -> DataFrame:
    """``present`` and the parents that ``children`` need beyond it."""
    return present.unionByName(fetch_parents(source, missing_parents(relationships, children, present)))
