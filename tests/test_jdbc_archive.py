"""Archives of Derby databases, and the queries that read them: where names repeat, and on executors of their own."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from kinslice import queries
from kinslice.sources import jdbc

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Customers whose names repeat, are empty or null."""
    top = str(tmp_path_factory.mktemp("named"))
    tables = {
        "nation": ([(k, f"nation {k}", k % 2) for k in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, "same", k % 4) for k in range(9)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(0, "same", 0), (1, "same", 1), (2, "", None), (3, None, 3), (4, ' a,"b"\n c ', 0), (5, "ü\\", 1)], "c_custkey long, c_name string, c_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{top}/{name}.parquet")
    return top


def test_jdbc_keys_of_repeated_names(spark, folder):
    got = {tuple(r) for r in queries.QUERIES["jdbc_keys"](spark, folder).collect()}
    assert len(got) == 6 and ("APP.CUSTOMER", "unique", "C_NAME", "") in got


def test_archive_keeps_rows(spark, folder):
    df = spark.read.parquet(f"{folder}/customer.parquet")
    opts = jdbc.derby_archive(spark, ["CREATE TABLE T (K BIGINT PRIMARY KEY, V VARCHAR(40), N INT)", "CREATE TABLE BARE (K INT)"], {"T": df, "BARE": spark.createDataFrame([], "k int")})
    cat = jdbc.catalog(spark, opts)
    assert sorted(map(tuple, cat.frame("APP.T").collect())) == sorted(map(tuple, df.collect()))
    assert cat.frame("APP.BARE").count() == 0


def test_jdbc_read_of_repeated_names(spark, folder):
    want = spark.read.parquet(f"{folder}/customer.parquet").collect()
    assert sorted(map(tuple, queries.QUERIES["jdbc_read"](spark, folder).collect())) == sorted(map(tuple, want))


def test_jdbc_queries_on_executors_of_their_own(folder, tmp_path):
    code = f"""
from pyspark.sql import SparkSession
import __spark_entry__
s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
print("rows", [__spark_entry__.queries()[n](s, "{folder}").count() for n in ("jdbc_keys", "jdbc_read", "jdbc_subset")])
"""
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_SCALA_VERSION": "2.13"}
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows [6, 6, 4]" in ran.stdout, ran.stderr[-2000:]


def test_jdbc_subset_of_repeated_names(spark, folder):
    got = sorted(r["S_SUPPKEY"] for r in queries.QUERIES["jdbc_subset"](spark, folder).collect())
    assert got == [k for k in range(9) if k % 4 % 2 == 1]
