"""Token counts as rollups that signed changes maintain.

A change row says what happened to one document under one tokenizer version: `insert`
(n_tokens), `delete` (old_tokens) or `revise` (from old_tokens under its old source and
language to n_tokens under the new ones). Each becomes one or two signed rows, which are
summed per (source, lang, tokenizer) within their batch; counts are additive, so totals
are the sum of all batches' rollups and no batch is ever read again in detail.

A batch is one folder, batch=<id>, written by one Spark commit. A batch whose folder holds
the commit marker is not applied again, so a driver that doesn't know whether a commit
went through sends the batch once more; if what it sends under that id then sums to
something else, that is an error. What a failed write left is overwritten.

Totals are maintained: a commit folds the batches that no snapshot holds yet into the next
snapshot=<n>, which has the totals and the ids of all batches in them. Reading the totals
reads the last whole snapshot and the batches that aren't in it (none, unless a driver was
lost between a batch and its fold). One driver commits at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import importable
from lodestar.llm.memory import serve

from lodestar.llm.tokens import encoder

KEYS = ("source", "lang", "tokenizer")


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows (source, lang, tokenizer, d_docs, d_tokens) of changes.

    Changes have op, source, lang, tokenizer, n_tokens, old_tokens and, if a revision
    moves a document, old_source and old_lang (null: unmoved). Null token counts are 0;
    null keys are keys. An unknown op raises.
    """
    have = set(changes.columns)
    old = {k: F.coalesce(f"old_{k}", k) if f"old_{k}" in have else F.col(k) for k in ("source", "lang")}
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    n, was = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")

    def part(source: Column, lang: Column, docs: int, tokens: Column, when: Column) -> Column:
        return F.when(when, F.struct(source.alias("source"), lang.alias("lang"), F.col("tokenizer").alias("tokenizer"), F.lit(docs).cast("long").alias("d_docs"), tokens.alias("d_tokens")))

    gone = part(old["source"], old["lang"], -1, -was, F.col("op").isin("delete", "revise"))
    come = part(F.col("source"), F.col("lang"), 1, n, F.col("op").isin("insert", "revise"))
    rows = changes.withColumn("op", op).select(F.explode(F.filter(F.array(gone, come), lambda x: x.isNotNull())).alias("x"))
    return rows.select("x.*")


class TokenLedger:
    """Rollups in a folder that driver and executors share."""

    SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch):
            raise ValueError(f"batch id {batch!r}: letters, digits and - _ . only")
        return f"{self.path}/batch={batch}"

    def _names(self, kind: str) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(n[len(kind) + 1 :] for n in names if n.startswith(f"{kind}="))

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    @staticmethod
    def _rollup(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))

    @staticmethod
    def _digest(rollup: DataFrame) -> tuple:
        return tuple(rollup.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rollup.columns).cast("decimal(38,0)"))).first())

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self._folder(batch)}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it had been applied before, ValueError if with other sums."""
        rollup = self._rollup(signed(changes))
        again = self.committed(batch)
        if again:
            if self._digest(rollup) != self._digest(self._read([self._folder(batch)])):
                raise ValueError(f"batch {batch!r} was committed with other content")
        else:
            rollup.coalesce(1).write.mode("overwrite").parquet(self._folder(batch))
        self.fold()
        return not again

    def _snapshot(self) -> tuple[int, set[str]]:
        """Number and batches of the last whole snapshot; 0 if there is none."""
        for n in sorted((int(x) for x in self._names("snapshot")), reverse=True):
            if self._fs.exists(self._path(f"{self.path}/snapshot={n}/totals/_SUCCESS")):
                return n, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshot={n}/batches").collect()}
        return 0, set()

    def batches(self) -> list[str]:
        _, inside = self._snapshot()
        return sorted(b for b in self._names("batch") if b in inside or self.committed(b))

    def _parts(self) -> tuple[int, set[str], list[str]]:
        """The last snapshot, the batches in it, and those that aren't."""
        n, inside = self._snapshot()
        return n, inside, [b for b in self._names("batch") if b not in inside and self.committed(b)]

    def _signed_totals(self, n: int, outside: list[str]) -> DataFrame:
        return self._rollup(self._read([f"{self.path}/snapshot={n}/totals"] * (n > 0) + [self._folder(b) for b in outside]))

    def fold(self) -> None:
        """Takes batches that no snapshot holds into the next one; the one before the last is dropped."""
        n, inside, outside = self._parts()
        if not outside:
            return
        new = f"{self.path}/snapshot={n + 1}"
        self.spark.createDataFrame([(b,) for b in sorted(inside | set(outside))], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{new}/batches")
        self._signed_totals(n, outside).write.mode("overwrite").parquet(f"{new}/totals")  # its marker makes the snapshot whole
        for old in self._names("snapshot"):
            if int(old) < n:
                self._fs.delete(self._path(f"{self.path}/snapshot={old}"), True)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys whose documents are all gone are left out."""
        n, _, outside = self._parts()
        sums = self._signed_totals(n, outside).withColumnsRenamed({"d_docs": "n_docs", "d_tokens": "n_tokens"})
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def counted(df: DataFrame, text_col: str = "text", keep: list[Column] | None = None, tokenizer: str | None = None) -> DataFrame:
    """The `keep` columns of each row, then n_tokens of the whole text (null and empty: 0).

    Repeated rows count one by one, other columns are ignored, an empty table gives an empty result.
    """
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    names = df.select(*(keep or [])).columns
    rows = df.select(*kept, F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("tokens")
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = [len(raw) // 4 for raw in encode.encode(part.column(part.num_columns - 1).to_pylist())]
                yield pa.record_batch([*part.columns[:-1], pa.array(n, pa.int64())], names=schema.fieldNames())

    return importable(rows).mapInArrow(run, schema).toDF(*names, "n_tokens")
