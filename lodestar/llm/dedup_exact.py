"""Exact deduplication by content sort, in DataFrame operations only.

Spark samples splitters of a short key (the first PREFIX characters of the normalised text, a
hash of all of it, and a salt), range-partitions by them and sorts each partition externally
by prefix, hash, salt, whole text and id. Equal texts become neighbours there, and the
window over them walks the sorted rows comparing whole neighbouring texts. Texts that only
begin alike are told apart by the hash, so a shared beginning is no hot key.

A text with more rows than RUN_ROWS (and than one in RUNS of all rows) is salted: its rows
are dealt over as many places of the sort as it has RUN_ROWS of them, so even a text that
holds a third of all rows is never gathered in one task. Such texts have fewer than
2 * RUNS + 1 runs in all, whatever the table's size; these meet again by their SHA-256, and
go back to their rows by a broadcast of that bound. Every other text is settled by the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch

RUN_ROWS, RUNS = 256, 100_000
PREFIX = 64
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None, keep_text: bool = False, run_rows: int = RUN_ROWS, runs: int = RUNS, prefix: int = PREFIX, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, then the `keep` columns and, by `keep_text`, text.

    Null texts count as empty, so nulls, empty and blank-free texts form groups as their
    normalised text says. Of equal texts the row with the smallest id is kept; a null id is
    larger than any other, and of rows that repeat an id and its text exactly one is kept.
    Other columns are ignored whatever their names. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession)
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    names = df.select(*(keep or [])).columns
    # a text is exchanged once: normalised, or as it is if it has to be given back
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text") if keep_text else normalised(F.col(text_col)).alias("text"), *kept)
    norm = normalised(F.col("text")) if keep_text else F.col("text")
    rows = rows.withColumn("hash", F.xxhash64(norm))
    counts = scratch.save(rows.groupBy("hash").count(), "counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    per = max(run_rows, -(-total // runs))
    many = counts.where(F.col("count") > per).select("hash", F.ceil(F.col("count") / per).cast("int").alias("salts"))  # fewer than `runs`
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("salts"))).cast("int")
    rows = rows.join(F.broadcast(many), "hash", "left").withColumn("prefix", F.substring(norm, 1, prefix)).withColumn("salt", salt)
    run = Window.partitionBy("prefix", "hash", "salt", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = rows.repartitionByRange("prefix", "hash", "salt").withColumn("norm", norm).select(
        "id",
        "salt",
        F.col("salts").isNotNull().alias("salted"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"),
        F.row_number().over(run).alias("at"),
        F.first("id").over(whole).alias("run_id"),
        F.count(F.lit(1)).over(whole).alias("run_n"),
        *(f"k{i}" for i in range(len(kept))),
        *(["text"] if keep_text else []),
    )
    placed = scratch.save(placed, "runs")
    text = Window.partitionBy("sha")
    groups = placed.where("salted and at = 1").select(
        "sha",
        "salt",
        F.min("run_id").over(text).alias("all_id"),
        F.sum("run_n").over(text).alias("all_n"),
        (F.row_number().over(text.orderBy(F.col("run_id").asc_nulls_last(), "salt")) == 1).alias("first_run"),
    )
    either = lambda salted, own: F.when(F.col("salted"), F.col(salted)).otherwise(F.col(own))
    return placed.join(F.broadcast(groups), ["sha", "salt"], "left").select(
        F.col("id").alias(id_col),
        either("all_id", "run_id").alias("keep_id"),
        either("all_n", "run_n").alias("group_size"),
        ((F.col("at") == 1) & (~F.col("salted") | F.col("first_run"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(F.col(f"k{i}").alias(n) for i, n in enumerate(names)),
        *(["text"] if keep_text else []),
    )
