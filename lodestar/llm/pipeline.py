"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
A document is a row: rows travel through the operators whole, so each row's own decision
takes effect whether its doc_id is unique, repeated or null, and no row is looked up again.
Null texts count as empty. Columns beyond those of documents are carried along, whatever
their names; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import quality
from lodestar.llm.common import Scratch
from lodestar.llm.decontaminate import contamination
from lodestar.llm.dedup_exact import exact_dedup
from lodestar.llm.packing import pack
from lodestar.llm.simhash import simhash_classes


def _carried(docs: DataFrame) -> dict:
    """How an operator carries whole rows: the text, which it reads anyway, and the other columns under names of their own."""
    return {"keep": [F.col(f"`{c}`").alias(f"carried{i}") for i, c in enumerate(docs.columns) if c != "text"], "keep_text": True}


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col("text") if c == "text" else F.col(f"carried{i}").alias(c) for i, c in enumerate(docs.columns)))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on labelled ones, doesn't reject.

    Labels of the fold that op4 holds out aren't learnt. Empty and very long texts are
    judged by all of their statistics and words; equal rows get equal verdicts.
    """
    learnt = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnt, metadata=[c for c in docs.columns if c == "n_chars"])
    return _restored(quality.classify(docs, model, **_carried(docs)).where("predicted = 1"), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the one with the smallest id, nulls last; of rows that share it, one."""
    return _restored(exact_dedup(docs, **_carried(docs)).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: the one with the smallest id, nulls last; of rows that share it, one.

    Texts without words are one component.
    """
    return _restored(simhash_classes(docs, **_carried(docs)).where("first"), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; rows with equal ids are judged one by one."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), **_carried(docs))
    return _restored(found.where("NOT contaminated"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences; an empty text is its end id."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", filter_quality),
    ("exact-dedup", drop_exact_copies),
    ("near-dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("pack", pack_sequences),
]

#: SQL can't express the classifier, the fingerprints' components and the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages and their operators stored is dropped on the way."""
    results = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = results.folder(name)
        with Scratch.dropping():
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            results.drop(before)
        before = path
    return docs
