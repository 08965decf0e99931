"""A training corpus from raw documents: five stages, each written and read again.

Each stage works on all rows that its predecessor kept, with an operator of ``barscope.llm``; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscope.llm import bpe, decontaminate, linededup, minhash, toxicity
from barscope.llm.common import crc_mod, table, written
from barscope.llm.q_bpe import vocabulary
from barscope.plans.registry import Query


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half, learned from the labelled ones among them."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(5) != 0))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds, ``n_chars`` brought up to date."""
    d = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        d = d.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near duplicates."""
    late = minhash.near_duplicates(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(late, F.col("doc_id") == F.col("__id"), "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return bpe.digests(bpe.encoded(docs, vocabulary()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# Learned scores, sampled hashes and subword ids have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None
QUERY = Query(run, ORACLE_SQL)
