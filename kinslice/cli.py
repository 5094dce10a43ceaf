"""Command line: ``python -m kinslice.cli --config config.json`` or through spark-submit."""

from __future__ import annotations

import argparse
import json
import os
import sys

EXAMPLE = {
    "db_type": "parquet",
    "source_db_connection_info": {"path": "/data/source"},
    "destination_db_connection_info": {"path": "/data/subset"},
    "initial_targets": [
        {"table": "customer", "where": "c_mktsegment = 'BUILDING'"},
        {"table": "supplier", "percent": 5},
        {"table": "orders", "where": "o_totalprice > 1000", "pre_filter": "large customers"},
    ],
    "pre_filters": [{"name": "large customers", "query": "SELECT c_custkey FROM parquet.`/data/source/customer.parquet` WHERE c_acctbal > 9000", "column": "o_custkey"}],
    "upstream_filters": [{"table": "orders", "condition": "o_orderstatus = 'O'"}, {"column": "deleted", "condition": "NOT deleted"}],
    "excluded_tables": ["conversations"],
    "passthrough_tables": ["region"],
    "max_rows_per_table": "ALL",
    "keep_disconnected_tables": False,
    "dependency_breaks": [{"fk_table": "customer", "target_table": "nation", "preserve_fk_opportunistically": True}],
    "fk_augmentation": [{"fk_table": "events", "fk_columns": ["user_id"], "target_table": "customer", "target_columns": ["c_custkey"]}],
    "incremental_keys": [{"table": "lineitem", "columns": ["l_orderkey", "l_linenumber"]}],
    "pre_constraint_sql": ["customer := SELECT * EXCEPT (c_name), 'masked' AS c_name FROM customer"],
    "post_subset_sql": [],
    "destination_mode": "recreate",
    "parallel_read_workers": 4,
}

HELP_CONFIG = """Required
  db_type                           postgres, mysql, jdbc or parquet
  source_db_connection_info         user_name, host, db_name, port, ssl_mode, password; or url and driver of any JDBC
  destination_db_connection_info    database; or path of a folder of Parquet tables, with catalog.json for their keys.
                                    Any value may be ${VARIABLE}. A password that is missing is asked for.
  initial_targets                   table with where (SQL) or percent; optionally pre_filter, by name
Selection
  pre_filters                       name, query, column: targets that name it keep rows whose column is in the query's
                                    first column. An empty one selects nothing, unless legacy_empty_prefilter is true
  upstream_filters                  condition with table, or with column: for all tables that have that column
  excluded_tables                   tables that are left out with their relationships
  passthrough_tables                tables that are copied whole; max_rows_per_table (a number or "ALL") limits them
  limit_upstream                    true: max_rows_per_table also limits children
  keep_disconnected_tables          true: tables without a relationship to a target are copied whole
  seed                              of samples by percent
Relationships
  dependency_breaks                 fk_table, target_table; the key's values become null, or with
                                    preserve_fk_opportunistically stay where the parent was selected
  fk_augmentation                   fk_table, fk_columns, target_table, target_columns; fk_schema and target_schema
Destination
  destination_mode                  recreate: a new subset; topup: new rows and their children; grow: also new children
                                    of rows that are there. skip_schema_setup true is an older name of topup
  incremental_keys                  table, columns: the unique key that names a table's rows, if it has no primary key
  pre_constraint_sql                statements before the checks; "table := SELECT ..." replaces a table
  post_subset_sql                   statements after the checks, likewise
  parallel_read_workers             tables of one step that are selected side by side
  use_temp_tables                   accepted; key sets always stay distributed"""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinslice", description="Cuts a referentially intact subset out of a dataset.")
    p.add_argument("--config", default="config.json")
    p.add_argument("-y", "--yes", action="store_true", help="don't ask before a destination is replaced")
    p.add_argument("-v", "--verbose", action="store_true", help="print each step's plan")
    p.add_argument("--no-constraints", action="store_true", help="publish without checking integrity")
    p.add_argument("--help-config", action="store_true")
    p.add_argument("--example-config", action="store_true")
    args = p.parse_args(argv)
    if args.help_config:
        print(HELP_CONFIG)
        return 0
    if args.example_config:
        print(json.dumps(EXAMPLE, indent=2))
        return 0
    if not os.path.exists(args.config):
        print(f"{args.config} doesn't exist", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .config import load
    from .engine import run_subset

    config = load(args.config)
    local = config.destination.host in ("localhost", "127.0.0.1")
    if not args.yes and not local:
        where = config.destination.path or config.destination.url or config.destination.host
        if input(f"Write to {where}? [y/N] ").strip().lower() not in ("y", "yes"):
            return 1
    spark = SparkSession.builder.appName("kinslice").getOrCreate()
    try:
        run_subset(config, spark, no_constraints=args.no_constraints, verbose=args.verbose)
    except KeyboardInterrupt:
        print("interrupted; nothing was published", file=sys.stderr)
        return 130
    return 0


if __name__ == "__main__":
    sys.exit(main())
