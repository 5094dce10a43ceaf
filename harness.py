"""A parent and a child table with two references to it: times a run from scratch, a topup and a grow.

    python harness.py [rows] [repeats] [payload bytes]

A tenth of the rows are parents, a tenth of those are selected, and before a topup or a grow half of the
selected are there already. Then the source gains a child of parents that are there, which only grow
brings in, and a changed payload, which only grow refreshes. Prints one JSON line for each mode.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from kinslice import config, engine  # noqa: E402
from kinslice.catalog import Relationship, UniqueKey, from_frames  # noqa: E402


def shape(total: int) -> tuple[int, int, int, int]:
    """Parents, children, selected parents, and those that are there before an incremental run."""
    parents = total // 10
    return parents, total - parents - 1, parents // 10, parents // 20


def source(spark: SparkSession, total: int, payload: int, late: bool) -> dict[str, DataFrame]:
    parents, children, selected, resident = shape(total)
    parent = spark.range(1, parents + 1).select("id", (F.col("id") <= selected).alias("selected"))
    child = spark.range(1, children + 1).select(
        "id", (F.col("id") % parents + 1).alias("left_id"), ((F.col("id") + resident // 2) % parents + 1).alias("right_id"), F.lit("x" * payload).alias("payload")
    )
    if late:
        child = child.withColumn("payload", F.when(F.col("id") == 1, "updated").otherwise(F.col("payload")))
        child = child.union(spark.sql(f"SELECT {children + 1}L AS id, 1L AS left_id, 2L AS right_id, 'new child' AS payload"))
    return {"parent": parent, "child": child}


def expected(total: int, mode: str) -> int:
    """Child rows that a run ends with."""
    parents, children, selected, resident = shape(total)
    both = sum(i % parents < selected and (i + resident // 2) % parents < selected for i in range(1, children + 1))
    return both + (mode != "topup")


def run(spark: SparkSession, folder: str, total: int, payload: int, mode: str) -> tuple[float, engine.SubsetResult]:
    """Seconds of the run that counts, and its result. ``folder`` must be new."""
    links = [Relationship("child", (c,), "parent", ("id",)) for c in ("left_id", "right_id")]
    catalogs = []
    for late in (False, True):
        frames = {}
        for name, df in source(spark, total, payload, late).items():
            df.write.parquet(f"{folder}/source-{late}/{name}.parquet")
            frames[name] = spark.read.parquet(f"{folder}/source-{late}/{name}.parquet")
        catalogs.append(from_frames(frames, keys={n: [UniqueKey(("id",), primary=True)] for n in frames}, relationships=links))
    raw = {"db_type": "parquet", "source_db_connection_info": {}, "destination_db_connection_info": {"path": f"{folder}/destination"}, "parallel_read_workers": 4}
    if mode != "recreate":
        _, _, _, resident = shape(total)
        before = config.parse(raw | {"initial_targets": [{"table": "parent", "where": f"id <= {resident}"}]})
        engine.run_subset(before, spark, catalog=catalogs[0], with_report=False)
    wanted = config.parse(raw | {"initial_targets": [{"table": "parent", "where": "selected"}], "destination_mode": mode})
    began = time.time()
    out = engine.run_subset(wanted, spark, catalog=catalogs[1], with_report=False)
    return time.time() - began, out


def main(total: int = 100_000, repeats: int = 3, payload: int = 256) -> None:
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory() as top:
        run(spark, f"{top}/warm", 1000, payload, "recreate")
        for mode in ("recreate", "topup", "grow"):
            seconds = []
            for k in range(repeats):
                took, out = run(spark, f"{top}/{mode}-{k}", total, payload, mode)
                rows = out.tables["child"].count()
                if rows != expected(total, mode):
                    raise SystemExit(f"{mode}: {rows} children, not {expected(total, mode)}")
                seconds.append(round(took, 2))
            print(json.dumps({"mode": mode, "rows": total, "payload": payload, "children": rows, "seconds": seconds, "median": median(seconds)}), flush=True)


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
