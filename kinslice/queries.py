"""Queries over the synthetic tables, one or more for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checks, config, engine, graph, incremental, report, storage
from .catalog import Catalog, Relationship, Table, UniqueKey, grouped_keys
from .functions import mask_characters, mask_email, mask_numbers, next_values, null_out
from .operators import direct, downstream, keys, merge, project, upstream
from .sources import jdbc, parquet, testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BUILDING = {"table": "customer", "where": "c_mktsegment = 'BUILDING'"}
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def conf(targets: list[dict[str, Any]], **more: Any) -> config.Config:
    raw = {"db_type": "parquet", "initial_targets": targets, "source_db_connection_info": {}, "destination_db_connection_info": {}}
    return config.parse(raw | {"fk_augmentation": testdata.LOGICAL} | more)


def subset(spark: SparkSession, sf_dir: str, targets: list[dict[str, Any]], only: str | None = None, **more: Any) -> engine.SubsetResult:
    """The whole subset, each step's rows written once; or the plan of one table."""
    keep = None if only else storage.written(spark)
    return engine.select(spark, testdata.catalog(spark, sf_dir), conf(targets, **more), only=only and [only], keep=keep)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rel(child: str, child_columns: str, parent: str, parent_columns: str) -> Relationship:
    return Relationship(child, tuple(child_columns.split()), parent, tuple(parent_columns.split()))


# direct selection

@query("direct_where", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def _(spark, sf):
    t = config.Target("customer", where="c_mktsegment = 'BUILDING' AND c_acctbal > 0")
    return direct.select_target(read(spark, sf, "customer"), [t], {}, conf([BUILDING]))


@query("direct_where_or_prefilter", "SELECT * FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, sf):
    read(spark, sf, "nation").createOrReplaceTempView("kinslice_nation")
    return subset(
        spark, sf, [{"table": "customer", "where": "c_mktsegment = 'BUILDING' OR c_acctbal < 0", "pre_filter": "p"}],
        pre_filters=[{"name": "p", "query": "SELECT n_nationkey FROM kinslice_nation WHERE n_regionkey = 1", "column": "c_nationkey"}],
        only="customer",
    ).tables["customer"]


@query("direct_hash_percent", "SELECT c_custkey FROM customer WHERE CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8) AS BIGINT) < 858993459")
def _(spark, sf):
    return direct.hash_sample(read(spark, sf, "customer"), ["c_custkey"], 20).select("c_custkey")


@query("direct_percent_rand")
def _(spark, sf):
    return direct.bernoulli(read(spark, sf, "orders"), 10, 7)


@query("direct_percent_bounds", "SELECT true AS within, true AS all_known")
def _(spark, sf):
    """A tenth of the orders, as far as chance goes (seven standard deviations), and nothing else."""
    orders = read(spark, sf, "orders")
    drawn = direct.bernoulli(orders, 10, 7).select("o_orderkey").withColumn("drawn", F.lit(1))
    both = orders.select("o_orderkey", F.lit(1).alias("own")).join(drawn, "o_orderkey", "full")
    n, hit, strange = F.count("own"), F.count("drawn"), F.count(F.when(F.col("own").isNull(), 1))
    return both.agg((F.abs(hit - 0.1 * n) <= 7 * F.sqrt(0.09 * n)).alias("within"), (strange == 0).alias("all_known"))


@query("limit_upstream", f"SELECT CAST(least(count(*), 40) AS BIGINT) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    out = subset(spark, sf, [BUILDING], max_rows_per_table=40, limit_upstream=True, only="orders")
    return out.tables["orders"].agg(F.count("*").alias("n"))


@query("prefilter_membership", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("kinslice_customer")
    return subset(
        spark, sf, [{"table": "orders", "where": "true", "pre_filter": "p"}],
        pre_filters=[{"name": "p", "query": "SELECT c_custkey FROM kinslice_customer WHERE c_acctbal > 5000", "column": "o_custkey"}],
        only="orders",
    ).tables["orders"].select("o_orderkey")


@query("prefilter_empty", "SELECT o_orderkey FROM orders WHERE false")
def _(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("kinslice_customer")
    return subset(
        spark, sf, [{"table": "orders", "where": "true", "pre_filter": "p"}],
        pre_filters=[{"name": "p", "query": "SELECT c_custkey FROM kinslice_customer WHERE false", "column": "o_custkey"}],
        only="orders",
    ).tables["orders"].select("o_orderkey")


@query("multi_target_union", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def _(spark, sf):
    return subset(spark, sf, [BUILDING, {"table": "customer", "where": "c_nationkey = 3"}], only="customer").tables["customer"]


# full copies

@query("copy_full", "SELECT * FROM supplier")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], passthrough_tables=["supplier"], only="supplier").tables["supplier"]


@query("passthrough_limit_count", "SELECT CAST(least(count(*), 50) AS BIGINT) AS n FROM part")
def _(spark, sf):
    out = subset(spark, sf, [BUILDING], passthrough_tables=["part"], max_rows_per_table=50, only="part")
    return out.tables["part"].agg(F.count("*").alias("n"))


# upstream

_B = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query("upstream_single_fk", f"SELECT * FROM orders WHERE o_custkey IN ({_B})")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], only="orders").tables["orders"]


@query("upstream_transitive", f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_B}))")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], only="lineitem").tables["lineitem"]


@query("upstream_multi_fk_and", f"SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_B})) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey <= 5)")
def _(spark, sf):
    return subset(spark, sf, [BUILDING, {"table": "supplier", "where": "s_nationkey <= 5"}], only="lineitem").tables["lineitem"]


_LINK = "SELECT o_orderkey AS link_id, o_custkey AS from_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_custkey * 7) % 100 END AS to_id FROM orders"


@query("upstream_two_fk_same_parent", f"SELECT * FROM ({_LINK}) WHERE from_id IN ({_B}) AND (to_id IS NULL OR to_id IN ({_B}))")
def _(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    link = spark.sql(_LINK)
    customers = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    r = [rel("link", "from_id", "customer", "c_custkey"), rel("link", "to_id", "customer", "c_custkey")]
    return upstream.select_children(link, r, [customers, customers])


_NULLS = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS cust, o_orderkey % 30 AS nat FROM orders"


@query("upstream_null_neutral", f"SELECT * FROM ({_NULLS}) WHERE (cust IS NULL OR cust IN ({_B})) AND (nat IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)) ")
def _(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    customers = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    nations = read(spark, sf, "nation").where("n_regionkey < 3")
    r = [rel("o", "cust", "customer", "c_custkey"), rel("o", "nat", "nation", "n_nationkey")]
    return upstream.select_children(spark.sql(_NULLS), r, [customers, nations])


_PARTIAL = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey END AS supp, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_orderkey END AS ord FROM lineitem"
_PAIRS = "SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity > 30"


@query("upstream_composite_partial_null", f"""
WITH t AS ({_PARTIAL}), k AS ({_PAIRS}), o AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000),
f AS (SELECT t.*, k.p IS NOT NULL AS m1, o.o_orderkey IS NOT NULL AS m2 FROM t LEFT JOIN k ON l_partkey = p AND supp = s LEFT JOIN o ON ord = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, supp, ord FROM f WHERE (l_partkey IS NULL OR supp IS NULL OR m1) AND (ord IS NULL OR m2) AND (m1 OR m2)""")
def _(spark, sf):
    read(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    r = [rel("t", "l_partkey supp", "k", "p s"), rel("t", "ord", "orders", "o_orderkey")]
    return upstream.select_children(spark.sql(_PARTIAL), r, [spark.sql(_PAIRS), read(spark, sf, "orders").where("o_totalprice > 100000")])


@query("upstream_filter_table", f"SELECT * FROM orders WHERE o_custkey IN ({_B}) AND (o_orderpriority = '1-URGENT' OR o_totalprice > 200000)")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], upstream_filters=[{"table": "orders", "condition": "orders.o_orderpriority = '1-URGENT' OR o_totalprice > 200000"}], only="orders").tables["orders"]


@query("upstream_filter_column", f"SELECT * FROM events WHERE user_id IN ({_B}) AND value > 50")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], upstream_filters=[{"column": "value", "condition": "value > 50"}], only="events").tables["events"]


@query("upstream_bag_duplicates", f"SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0) WHERE o_custkey IN ({_B})")
def _(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    bag = o.unionByName(o.where("o_orderkey % 2 = 0"))
    c = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return upstream.select_children(bag, [rel("o", "o_custkey", "c", "c_custkey")], [c.unionByName(c)])


# downstream

@query("downstream_parents", f"SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN ({_B})) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_B}))))")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], only="nation").tables["nation"]


@query("downstream_missing_only", "SELECT DISTINCT o_custkey AS c FROM orders WHERE o_totalprice > 150000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, sf):
    have = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    missing = downstream.missing_parents([rel("orders", "o_custkey", "customer", "c_custkey")], [read(spark, sf, "orders").where("o_totalprice > 150000")], have)
    return missing["c_custkey",].select(F.col("_k0").alias("c"))


@query("downstream_mixed_keys", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) OR n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 2)")
def _(spark, sf):
    nation = read(spark, sf, "nation")
    names = nation.where("n_regionkey = 2").select(F.col("n_name").alias("wanted"))
    r = [rel("customer", "c_nationkey", "nation", "n_nationkey"), rel("x", "wanted", "nation", "n_name")]
    out = downstream.add_parents(nation, nation.limit(0), r, [read(spark, sf, "customer").where("c_acctbal > 9000"), names])
    return out.select("n_nationkey", "n_name")


@query("downstream_null_fk_ignored", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END FROM orders WHERE o_totalprice > 200000)")
def _(spark, sf):
    child = read(spark, sf, "orders").where("o_totalprice > 200000").select(F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END").alias("cust"))
    customer = read(spark, sf, "customer")
    return downstream.add_parents(customer, customer.limit(0), [rel("o", "cust", "customer", "c_custkey")], [child]).select("c_custkey")


# relationships and tables

@query("augmented_fk_events", f"SELECT * FROM events WHERE user_id IN ({_B})")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], only="events").tables["events"]


@query("break_nulls_fk", "SELECT c_custkey, CAST(NULL AS INTEGER) AS c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], dependency_breaks=[{"fk_table": "customer", "target_table": "nation"}], only="customer").tables["customer"].select("c_custkey", "c_nationkey")


@query("break_opportunistic", f"SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_B})))) THEN c_nationkey END AS c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    broken = [{"fk_table": "customer", "target_table": "nation", "preserve_fk_opportunistically": True}]
    return subset(spark, sf, [BUILDING], dependency_breaks=broken, only="customer").tables["customer"].select("c_custkey", "c_nationkey")


def _names(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("disconnected_tables", "SELECT * FROM (VALUES ('benchmark'), ('conversations'), ('documents'), ('embeddings'), ('labels'), ('pages')) t(name)")
def _(spark, sf):
    plan = engine.make_plan(testdata.catalog(spark, sf).for_run(conf([BUILDING])), conf([BUILDING]))
    return _names(spark, [(t,) for t in plan.disconnected], "name string")


@query("topo_strata", "SELECT CAST(level AS BIGINT) AS level, name FROM (VALUES (0, 'region'), (0, 'part'), (1, 'nation'), (2, 'customer'), (2, 'supplier'), (3, 'orders'), (3, 'events'), (4, 'lineitem')) t(level, name)")
def _(spark, sf):
    c = conf([BUILDING])
    cat = testdata.catalog(spark, sf).for_run(c)
    return _names(spark, [(k, t) for k, s in enumerate(graph.strata(cat.relationships, STAR)) for t in s], "level long, name string")


@query("excluded_tables", "SELECT * FROM (VALUES ('customer'), ('orders'), ('lineitem'), ('nation'), ('region'), ('supplier'), ('events')) t(name)")
def _(spark, sf):
    return _names(spark, [(t,) for t in subset(spark, sf, [BUILDING], excluded_tables=["part"]).tables], "name string")


@query("kept_disconnected", "SELECT * FROM labels")
def _(spark, sf):
    return subset(spark, sf, [BUILDING], keep_disconnected_tables=True, only="labels").tables["labels"]


@query("catalog_fk_grouping", "SELECT * FROM (VALUES ('fk_ps', 'lineitem', 'partsupp', 'l_partkey,l_suppkey', 'ps_partkey,ps_suppkey'), ('fk_o', 'lineitem', 'orders', 'l_orderkey', 'o_orderkey')) t(name, child, parent, child_columns, parent_columns)")
def _(spark, sf):
    rows = [("fk_ps", "lineitem", "partsupp", 2, "l_suppkey", "ps_suppkey"), ("fk_o", "lineitem", "orders", 1, "l_orderkey", "o_orderkey"), ("fk_ps", "lineitem", "partsupp", 1, "l_partkey", "ps_partkey")]
    found = grouped_keys(_names(spark, rows, "name string, child string, parent string, ord int, child_column string, parent_column string"))
    return found.select("name", "child", "parent", F.array_join("child_columns", ",").alias("child_columns"), F.array_join("parent_columns", ",").alias("parent_columns"))


@query("table_size_facts", "SELECT 'orders' AS name, CAST(count(*) AS BIGINT) AS n, true AS has_bytes FROM orders")
def _(spark, sf):
    some = parquet.size_bytes(spark, f"{sf}/orders.parquet") > 0
    return read(spark, sf, "orders").agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n", F.lit(some).alias("has_bytes"))


_TABLES = [*STAR, "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
_LISTED = ", ".join(f"'{t}'" for t in _TABLES)


@query("folder_tables", f"SELECT DISTINCT table_name AS name, 'r' AS kind FROM information_schema.columns WHERE table_name IN ({_LISTED})")
def _(spark, sf):
    kinds = parquet.open_folder(spark, sf).kinds()
    return _names(spark, list(kinds.items()), "name string, kind string").where(F.col("name").isin(*_TABLES))


@query("folder_columns", f"SELECT table_name AS name, CAST(ordinal_position AS BIGINT) AS ord, column_name AS col FROM information_schema.columns WHERE table_name IN ({_LISTED})")
def _(spark, sf):
    cat = parquet.open_folder(spark, sf)
    rows = [(t, k, c[0]) for t in _TABLES for k, c in enumerate(cat.datatypes(t), 1)]
    return _names(spark, rows, "name string, ord long, col string")


_DDL = (
    "CREATE TABLE NATION (N_NATIONKEY INT PRIMARY KEY, N_NAME VARCHAR(40), N_REGIONKEY INT)",
    "CREATE TABLE SUPPLIER (S_SUPPKEY BIGINT PRIMARY KEY, S_NAME VARCHAR(40), S_NATIONKEY INT REFERENCES NATION)",
    "CREATE TABLE CUSTOMER (C_CUSTKEY BIGINT PRIMARY KEY, C_NAME VARCHAR(40), C_NATIONKEY INT REFERENCES NATION)",
)


def _derby(spark: SparkSession, sf: str) -> dict[str, str]:
    """A database with some of the tables and the keys that their rows keep."""
    wanted = {"nation": "n_nationkey n_name n_regionkey", "supplier": "s_suppkey s_name s_nationkey", "customer": "c_custkey c_name c_nationkey"}
    return jdbc.derby_archive(spark, _DDL, {t.upper(): read(spark, sf, t).select(*columns.split()) for t, columns in wanted.items()})


@query("jdbc_read", "SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, c_nationkey AS C_NATIONKEY FROM customer")
def _(spark, sf):
    return jdbc.catalog(spark, _derby(spark, sf)).frame("APP.CUSTOMER")


@query("jdbc_subset", "SELECT s_suppkey AS S_SUPPKEY, s_name AS S_NAME, s_nationkey AS S_NATIONKEY FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(spark, sf):
    c = config.parse({"db_type": "jdbc", "initial_targets": [{"table": "APP.NATION", "where": "N_REGIONKEY = 1"}], "source_db_connection_info": {}, "destination_db_connection_info": {}})
    return engine.select(spark, jdbc.catalog(spark, _derby(spark, sf)), c, only=["APP.SUPPLIER"]).tables["APP.SUPPLIER"]


@query("jdbc_keys", """SELECT * FROM (VALUES ('APP.NATION', 'primary', 'N_NATIONKEY', ''), ('APP.SUPPLIER', 'primary', 'S_SUPPKEY', ''), ('APP.CUSTOMER', 'primary', 'C_CUSTKEY', ''),
  ('APP.CUSTOMER', 'unique', 'C_NAME', ''), ('APP.SUPPLIER', 'foreign', 'S_NATIONKEY', 'APP.NATION'), ('APP.CUSTOMER', 'foreign', 'C_NATIONKEY', 'APP.NATION')) t(name, kind, columns, parent)""")
def _(spark, sf):
    """What a database declares; names of customers may repeat in the rows, so its tables have none."""
    cat = jdbc.catalog(spark, jdbc.derby_archive(spark, [*_DDL, "CREATE UNIQUE INDEX CUSTOMER_NAME ON CUSTOMER (C_NAME)"], {}))
    rows = [(t.name, "primary" if k.primary else "unique", ",".join(k.columns), "") for t in cat.tables.values() for k in t.keys]
    rows += [(r.child, "foreign", ",".join(r.child_columns), r.parent) for r in cat.relationships]
    return _names(spark, rows, "name string, kind string, columns string, parent string")


# whole runs

_CTE = """
WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
e AS (SELECT * FROM events WHERE user_id IN (SELECT c_custkey FROM c)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)),
s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l)),
n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c UNION SELECT s_nationkey FROM s)),
r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n))
"""
_ALIAS = {"customer": "c", "orders": "o", "events": "e", "lineitem": "l", "part": "p", "supplier": "s", "nation": "n", "region": "r"}
_ALONE = ("benchmark", "conversations", "documents", "embeddings", "labels", "pages")
_COUNTS = " UNION ALL ".join(
    [f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS source, (SELECT count(*) FROM {a}) AS dest" for t, a in _ALIAS.items()]
    + [f"SELECT '{t}', (SELECT count(*) FROM {t}), 0" for t in _ALONE]
)


@query("middle_out_report", f"{_CTE} SELECT \"table\", CAST(source AS BIGINT) AS source, CAST(dest AS BIGINT) AS dest FROM ({_COUNTS})")
def middle_out_report(spark, sf):
    return subset(spark, sf, [BUILDING]).report.drop("ratio")


@query("report_ratio", f"{_CTE} SELECT \"table\", CASE WHEN source > 0 THEN round(100.0::DOUBLE * dest / source, 1) ELSE 0.0::DOUBLE END AS ratio FROM ({_COUNTS})")
def _(spark, sf):
    return subset(spark, sf, [BUILDING]).report.select("table", "ratio")


@query("report_totals", f"{_CTE} SELECT 'TOTAL' AS \"table\", CAST(sum(source) AS BIGINT) AS source, CAST(sum(dest) AS BIGINT) AS dest FROM ({_COUNTS})")
def _(spark, sf):
    return report.totals(subset(spark, sf, [BUILDING]).report).drop("ratio")


for _table, _alias in _ALIAS.items():
    @query(f"middle_out_{_table}", f"{_CTE} SELECT * FROM {_alias}")
    def _(spark, sf, table=_table):
        return subset(spark, sf, [BUILDING], only=table).tables[table]


# merge and increments

_OLD = "o_orderdate < TIMESTAMP '1998-01-01'"
_POOR = "c_acctbal < 4000"


def _merge_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Older and newer orders, which overlap by two years; every order is in one of them, some newer ones twice."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    old = o.where("o_orderdate < TIMESTAMP '1998-01-01'").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END"))
    new = o.where("o_orderdate >= TIMESTAMP '1996-01-01'").withColumn("o_orderstatus", F.expr("CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END"))
    return old.drop("o_orderdate"), new.unionByName(new.where("o_orderkey % 4 = 0")).drop("o_orderdate")


_MERGE = """
WITH a AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
m AS (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(b.o_custkey, a.o_custkey) AS o_custkey,
  CASE WHEN b.o_orderkey IS NULL THEN a.st ELSE b.st END AS o_orderstatus,
  CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL OR (a.o_custkey IS NOT DISTINCT FROM b.o_custkey AND a.st IS NOT DISTINCT FROM b.st) THEN 'keep' ELSE 'refresh' END AS action
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
"""


@query("merge_upsert_rows", f"{_MERGE} SELECT o_orderkey, o_custkey, o_orderstatus FROM m")
def _(spark, sf):
    return merge.merged(*_merge_inputs(spark, sf), ["o_orderkey"]).drop("_action")


@query("merge_actions", f"{_MERGE} SELECT o_orderkey, action FROM m")
def _(spark, sf):
    return merge.merged(*_merge_inputs(spark, sf), ["o_orderkey"]).select("o_orderkey", F.col("_action").alias("action"))


@query("merge_null_safe", f"{_MERGE} SELECT action, CAST(count(*) AS BIGINT) AS n FROM m WHERE o_orderstatus IS NULL GROUP BY action")
def _(spark, sf):
    m = merge.merged(*_merge_inputs(spark, sf), ["o_orderkey"]).where("o_orderstatus IS NULL")
    return m.groupBy(F.col("_action").alias("action")).agg(F.count("*").alias("n"))


@query("delta_inserted_only", f"{_MERGE} SELECT o_orderkey FROM m WHERE action = 'insert'")
def _(spark, sf):
    return merge.delta(merge.merged(*_merge_inputs(spark, sf), ["o_orderkey"]), ["o_orderkey"]).where("_inserted").select("o_orderkey")


@query("merge_changes", f"{_MERGE} SELECT o_orderkey, o_custkey, o_orderstatus, action FROM m WHERE action <> 'keep'")
def _(spark, sf):
    return merge.changes(*_merge_inputs(spark, sf), ["o_orderkey"]).withColumnRenamed("_action", "action")


@query("merge_read", f"{_MERGE} SELECT o_orderkey, o_custkey, o_orderstatus FROM m")
def _(spark, sf):
    """Earlier rows less the refreshed ones, and the changes."""
    old, new = _merge_inputs(spark, sf)
    changes = merge.changes(old, new, ["o_orderkey"])
    return merge.without(old, changes.where("_action = 'refresh'"), ["o_orderkey"]).unionByName(changes.drop("_action"))


@query("dedup_identity", "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    return merge.dedup(read(spark, sf, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"])


def _rerun(spark: SparkSession, sf: str, mode: str, only: str) -> engine.SubsetResult:
    """A second run after orders from 1998 on have arrived, with lineitem's key configured.

    The first run saw older orders, and customers with a lower balance only.
    """
    cat = testdata.catalog(spark, sf)
    old = dict(cat.tables)
    old["orders"] = Table("orders", lambda: cat.frame("orders").where(_OLD), cat.tables["orders"].keys)
    old["customer"] = Table("customer", lambda: cat.frame("customer").where(_POOR), cat.tables["customer"].keys)
    first = Catalog(old, cat.relationships)
    keyed = [{"table": "lineitem", "columns": ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]}]
    keep = storage.written(spark)
    before = {n: keep(n, df) for n, df in engine.select(spark, first, conf([BUILDING]), only=["customer", "orders", only]).tables.items()}
    return engine.select(spark, cat, conf([BUILDING], destination_mode=mode, incremental_keys=keyed), existing=before, keep=keep, only=[only])


_OLDER = f"""
WITH c0 AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND {_POOR}),
c1 AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'),
o0 AS (SELECT * FROM orders WHERE {_OLD} AND o_custkey IN (SELECT c_custkey FROM c0)),
ot AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c1 WHERE NOT ({_POOR})) UNION SELECT * FROM o0),
og AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c1))
"""


@query("topup_children", f"{_OLDER} SELECT * FROM ot")
def _(spark, sf):
    return _rerun(spark, sf, "topup", "orders").tables["orders"]


@query("grow_children", f"{_OLDER} SELECT * FROM og")
def _(spark, sf):
    return _rerun(spark, sf, "grow", "orders").tables["orders"]


@query("topup_delta", f"{_OLDER} SELECT o_orderkey, true AS inserted FROM ot WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o0)")
def _(spark, sf):
    return _rerun(spark, sf, "topup", "orders").deltas["orders"].select("o_orderkey", F.col("_inserted").alias("inserted"))


@query("topup_grandchildren", f"{_OLDER} SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM ot)")
def _(spark, sf):
    return _rerun(spark, sf, "topup", "lineitem").tables["lineitem"]


@query("topup_pairs", f"SELECT * FROM ({_LINK}) WHERE (from_id IN ({_B}) OR from_id IS NULL) AND (to_id IS NULL OR to_id IN ({_B})) AND (from_id IN ({_B} AND {_POOR}) OR to_id IN ({_B} AND {_POOR}))")
def _(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    customers = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    new = customers.where(_POOR)
    r = [rel("link", "from_id", "customer", "c_custkey"), rel("link", "to_id", "customer", "c_custkey")]
    return upstream.select_children(spark.sql(_LINK), r, [customers, customers], [new, new])


@query("downstream_delta_backfill", f"{_OLDER} SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM ot))")
def _(spark, sf):
    return _rerun(spark, sf, "topup", "supplier").tables["supplier"]


@query("identity_resolution", "SELECT * FROM (VALUES ('primary', 'a'), ('configured', 'b,c'), ('inferred', 'd'), ('override', 'error'), ('ambiguous', 'error'), ('deferrable', 'error'), ('none', 'error')) t(name, identity)")
def _(spark, sf):
    pk, u1, u2 = UniqueKey(("a",), primary=True), UniqueKey(("b", "c")), UniqueKey(("d",))
    cases = [
        ("primary", (pk, u1), None), ("configured", (u1, u2), ("c", "b")), ("inferred", (u2, UniqueKey(("e",), predicate="active")), None),
        ("override", (pk, u1), ("b", "c")), ("ambiguous", (u1, u2), None), ("deferrable", (pk, UniqueKey(("a",), immediate=False)), None), ("none", (), None),
    ]
    rows = []
    for name, own, chosen in cases:
        try:
            rows.append((name, ",".join(incremental.identity(Table(name, lambda: None, own), chosen))))
        except config.ConfigError:
            rows.append((name, "error"))
    return _names(spark, rows, "name string, identity string")


@query("config_hash_stable", "SELECT true AS same_without_password, true AS same_in_other_order, false AS same_with_other_target")
def _(spark, sf):
    def digest(targets=(BUILDING,), **more):
        return incremental.config_hash(conf(list(targets), **more), {"customer": ("c_custkey",)})

    two = [BUILDING, {"table": "supplier", "where": "true"}]
    row = (
        digest(source_db_connection_info={"password": "a"}) == digest(source_db_connection_info={"password": "b"}),
        digest(two, excluded_tables=["a", "b"]) == digest(two[::-1], excluded_tables=["b", "a"]),
        digest() == digest(two),
    )
    return _names(spark, [row], "same_without_password boolean, same_in_other_order boolean, same_with_other_target boolean")


# checks

@query("check_fk_orphans", f"{_CTE} SELECT * FROM (VALUES ('customer', CAST(0 AS BIGINT)), ('events', 0), ('lineitem', 0), ('nation', 0), ('orders', 0), ('supplier', 0)) t(\"table\", violations)")
def _(spark, sf):
    cat = testdata.catalog(spark, sf).for_run(conf([BUILDING]))
    found = checks.report(spark, cat, subset(spark, sf, [BUILDING]).tables, cat.relationships)
    return found.where("kind = 'foreign key'").groupBy("table").agg(F.sum("violations").alias("violations"))


@query("check_pk_duplicates", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return checks.duplicates(read(spark, sf, "lineitem"), UniqueKey(("l_orderkey", "l_linenumber")))


@query("check_partial_unique", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS rows FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1")
def _(spark, sf):
    return checks.duplicates(read(spark, sf, "orders"), UniqueKey(("o_custkey",), predicate="o_orderstatus = 'O'"))


@query("check_condition", "SELECT p_partkey FROM part WHERE NOT (p_size <= 40)")
def _(spark, sf):
    return checks.violations(read(spark, sf, "part"), "p_size <= 40").select("p_partkey")


@query("dangling_fk_nulled", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) THEN o_custkey END AS o_custkey FROM orders")
def _(spark, sf):
    parent = read(spark, sf, "customer").where("c_nationkey < 10")
    return project.null_dangling(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), ("o_custkey",), parent, ("c_custkey",))


@query("copy_absent_keys", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000)")
def _(spark, sf):
    have = keys.ids(read(spark, sf, "customer").where("c_acctbal > 3000"), ["c_custkey"])
    return keys.absent(read(spark, sf, "orders"), ["o_custkey"], have)


@query("hook_replaces_table", f"SELECT c_custkey, 'masked' AS c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0")
def _(spark, sf):
    tables = {"customer": subset(spark, sf, [BUILDING], only="customer").tables["customer"]}
    return engine.apply_hooks(spark, tables, ["customer := SELECT c_custkey, 'masked' AS c_name FROM customer WHERE c_acctbal >= 0"])["customer"]


@query("sequence_next", "SELECT 'customer' AS \"table\", 'c_custkey' AS \"column\", CAST(coalesce(max(c_custkey), 0) + 1 AS BIGINT) AS next FROM customer UNION ALL SELECT 'orders', 'o_orderkey', CAST(coalesce(max(o_orderkey), 0) + 1 AS BIGINT) FROM orders WHERE false")
def _(spark, sf):
    t = {"customer": read(spark, sf, "customer"), "orders": read(spark, sf, "orders").where("false")}
    return next_values(t, {"customer": ["c_custkey"], "orders": ["o_orderkey"]})


# masks

@query("mask_null_out", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", null_out(F.col("c_name")).alias("c_name"))


@query("mask_digits_shape", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '9', 'g') AS shape FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.regexp_replace(mask_numbers(F.col("c_name")), "[0-9]", "9").alias("shape"))


@query("mask_letters_shape", "SELECT c_custkey, regexp_replace(c_name, '[A-Za-z]', 'a', 'g') AS shape FROM customer")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.regexp_replace(mask_characters(F.col("c_name")), "[A-Za-z]", "a").alias("shape"))


@query("mask_email_domain", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'example.com' ELSE 'mail' || (c_custkey % 4) || '.org' END AS domain FROM customer")
def _(spark, sf):
    c = read(spark, sf, "customer")
    address = F.expr("CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat(c_name, '@mail', c_custkey % 4, '.org') END")
    return c.select("c_custkey", F.split(mask_email(address), "@")[1].alias("domain"))


def entry(spark: SparkSession) -> DataFrame:
    return middle_out_report(spark, "/root/testdata/sf0.001")


