"""Declared keys of the synthetic star schema that queries and benchmarks run on."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..catalog import Catalog
from . import parquet

#: The primary keys and foreign keys of the generated tables.
DECLARED = {
    "tables": {
        "region": {"primary": ["r_regionkey"]},
        "nation": {"primary": ["n_nationkey"]},
        "customer": {"primary": ["c_custkey"], "sequences": ["c_custkey"]},
        "supplier": {"primary": ["s_suppkey"], "sequences": ["s_suppkey"]},
        "part": {"primary": ["p_partkey"], "sequences": ["p_partkey"], "checks": ["p_retailprice >= 0"]},
        "orders": {"primary": ["o_orderkey"], "sequences": ["o_orderkey"]},
        "lineitem": {"unique": [["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]], "checks": ["l_quantity > 0"]},
        "events": {"primary": ["event_id"]},
        "documents": {"primary": ["doc_id"]},
        "embeddings": {"primary": ["vec_id"]},
        "pages": {"primary": ["page_id"]},
        "benchmark": {"primary": ["item_id"]},
        "labels": {"primary": ["doc_id"]},
        "conversations": {"primary": ["conv_id", "turn"]},
    },
    "relationships": [
        {"fk_table": "nation", "fk_columns": ["n_regionkey"], "target_table": "region", "target_columns": ["r_regionkey"]},
        {"fk_table": "customer", "fk_columns": ["c_nationkey"], "target_table": "nation", "target_columns": ["n_nationkey"]},
        {"fk_table": "supplier", "fk_columns": ["s_nationkey"], "target_table": "nation", "target_columns": ["n_nationkey"]},
        {"fk_table": "orders", "fk_columns": ["o_custkey"], "target_table": "customer", "target_columns": ["c_custkey"]},
        {"fk_table": "lineitem", "fk_columns": ["l_orderkey"], "target_table": "orders", "target_columns": ["o_orderkey"]},
        {"fk_table": "lineitem", "fk_columns": ["l_partkey"], "target_table": "part", "target_columns": ["p_partkey"]},
        {"fk_table": "lineitem", "fk_columns": ["l_suppkey"], "target_table": "supplier", "target_columns": ["s_suppkey"]},
    ],
}

#: events.user_id and labels.doc_id refer to other tables without a declared key.
LOGICAL = [
    {"fk_table": "events", "fk_columns": ["user_id"], "target_table": "customer", "target_columns": ["c_custkey"]},
    {"fk_table": "labels", "fk_columns": ["doc_id"], "target_table": "documents", "target_columns": ["doc_id"]},
]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return parquet.catalog(spark, sf_dir, DECLARED)
