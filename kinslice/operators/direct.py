"""Rows that a run starts from."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Target
from . import keys

#: Buckets of the reproducible sample: the first 32 bits of an md5.
BUCKETS = 1 << 32


def hash_bucket(columns: list[str]) -> Column:
    """A number below BUCKETS that depends on the key's text only."""
    key = F.concat_ws("|", *(keys.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, columns: list[str], percent: float) -> DataFrame:
    """The same rows each time: a deterministic and pushed-down stand-in for a Bernoulli sample."""
    return df.where(hash_bucket(columns) < F.lit(int(percent / 100 * BUCKETS)))


def bernoulli(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """Each row with the same chance. Write the result before it is used twice."""
    return df.where(F.rand(seed) < percent / 100)


def load_pre_filters(spark: SparkSession, config: Config) -> dict[str, DataFrame]:
    """Each query's first column, as distinct values; nulls match nothing."""
    out = {}
    for p in config.pre_filters:
        df = spark.sql(p.query)
        out[p.name] = df.select(keys.col(df.columns[0]).alias("_k0")).na.drop().distinct()
    return out


def select_target(df: DataFrame, targets: list[Target], values: Mapping[str, DataFrame], config: Config) -> DataFrame:
    """Rows of a table that any of its targets wants, each once per source row.

    Targets without pre-filter become one predicate, so they are one scan with everything pushed
    down. The where clause stands in brackets. An empty pre-filter selects nothing, unless
    ``legacy_empty_prefilter`` says that it then doesn't apply.
    """
    columns = {p.name: p.column for p in config.pre_filters}
    flags: list[Column] = []
    seed = config.seed
    for k, t in enumerate(targets):
        wanted = F.expr(f"({t.where})") if t.where is not None else F.rand(seed + k) < t.percent / 100
        if t.pre_filter is not None:
            listed = values[t.pre_filter]
            if not (config.legacy_empty_prefilter and listed.isEmpty()):
                if len(targets) == 1:
                    return keys.semi(df.where(wanted), [columns[t.pre_filter]], listed)
                mark = keys.like(listed, df, [columns[t.pre_filter]]).select(F.col("_k0").alias(f"_f{k}"))
                df = df.join(mark, keys.col(columns[t.pre_filter]) == F.col(f"_f{k}"), "left")
                wanted = wanted & F.col(f"_f{k}").isNotNull()
        flags.append(wanted)
    out = df.where(reduce(Column.__or__, (F.coalesce(f, F.lit(False)) for f in flags)) if len(flags) > 1 else flags[0])
    return out.drop(*(f"_f{k}" for k in range(len(targets))))
