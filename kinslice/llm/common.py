"""Session, table and checkpoint helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zlib
from contextlib import suppress

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts are cut further by bytes (``text.chunks``) before numpy sees them.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_ready(spark: SparkSession) -> None:
    """Bounds the Arrow batches that cross to Python by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def give_back(spark: SparkSession) -> None:
    """Returns to the system what allocators of the driver's two processes hold of memory that is free.

    glibc's arenas keep it otherwise, some 200 MB in a JVM that has compiled many plans. Only done where the
    allocators and the JVM (17 on) can.
    """
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)
    sc = spark.sparkContext
    with suppress(Py4JError):  # the server's class isn't public, so its interface is called by reflection
        kinds = [sc._jvm.java.lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        of, args = sc._gateway.new_array(sc._jvm.java.lang.Class, 4), sc._gateway.new_array(sc._jvm.java.lang.Object, 4)
        for k, kind in enumerate(kinds):
            of[k] = kind
        args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        sc._jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", of).invoke(server, args)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where it is unset on one machine, a local one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isEmpty() and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that lineage ends there.

    A written table survives lost executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()
    ).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return spark.read.schema(df.schema).parquet(path)


#: Words of 64 bits that a filter of ids has at most, and bits that it has for each id up to there.
FILTER_WORDS, FILTER_BITS = 1 << 19, 16


def _filter(column: str, ids: DataFrame) -> tuple[DataFrame, Column, Column]:
    """A broadcast bitmap of ids, the condition that joins rows with its words, and whether a row's bit is set.

    FILTER_WORDS rows of 16 bytes at most, however many ids there are; beyond about that many ids it lets
    more rows through.
    """
    name = ids.columns[0]
    words = 1 << max(10, min(FILTER_WORDS.bit_length() - 1, (max(ids.count(), 1) * FILTER_BITS // 64).bit_length()))
    hashed = lambda c: F.xxhash64(F.col(c).cast("long"), F.lit(7))
    word = lambda h: F.pmod(h, F.lit(words)).cast("int")
    bit = lambda h: F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
    marks = ids.select(word(hashed(name)).alias("__word"), bit(hashed(name)).alias("__bit"))
    marks = marks.groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    h = hashed(column)
    return F.broadcast(marks), word(h) == F.col("__word"), F.coalesce(F.getbit("__bits", bit(h)) == 1, F.lit(False))


def may_be_among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id may be in ``ids``, a written table of one column; none that is in it is lost.

    Others may be let through, so an exact join must follow.
    """
    marks, same, hit = _filter(column, ids)
    return rows.join(marks, same).where(hit).select(*(F.col(f"`{c}`") for c in rows.columns))


def not_among(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id isn't in ``ids``; null ids stay. Only rows whose id may be in it move to the exact join."""
    ids = cut(ids.select(F.col(ids.columns[0]).cast("long").alias("__id")).distinct())
    marks, same, hit = _filter(column, ids)
    own = [F.col(f"`{c}`") for c in rows.columns]
    marked = rows.join(marks, same, "left").withColumn("__hit", hit)
    exact = marked.where("__hit").select(*own).join(ids, F.col(f"`{column}`").cast("long") == F.col("__id"), "left_anti")
    return marked.where("NOT __hit").select(*own).unionByName(exact)


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids fall in no fold."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % modulus).cast("int")


def fold_of(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus
