"""A corpus pipeline over ``documents``: filter, deduplicate, decontaminate and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's result
to the shared folder and reads it again as the next one's documents. All stages but the last return
the columns of ``documents``. Rows that share a ``doc_id`` stay or go together; rows without one are
only rejected for toxicity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinslice.llm import common, decontam, minhash, packing, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine fitted on this stage's labelled documents doesn't call toxic."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked at a similarity of 0.8."""
    judged = minhash.near_duplicates(docs, percent=80)
    return common.not_among(docs, "doc_id", judged.where("NOT kept").select("doc_id"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids have; n_chars follows the text."""
    kept = substring.remove_repeats(docs, output="documents")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontam.leaks(docs, common.table(spark, sf_dir, "benchmark"))
    return common.not_among(docs, "doc_id", found.select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir))
    return docs
