"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, in two steps: the
driver draws the counts of groups of GROUP partitions, row by row, each a multivariate
hypergeometric draw from the room left in the shards; then the executors divide each group's
counts among its partitions in the same way. The matrix itself is never in one place. Then each partition is permuted locally and its first rows go to shard 0, the
next to shard 1 and so on; after the exchange each shard is permuted again. Every
assignment of rows to places is equally likely (up to the pseudo-random keys), and shard
sizes are exact: counts differ by one at most.

A permutation is the order of a keyed hash. A shard's second permutation is dealt over
buckets of key ranges, so that no shard is sorted in one task; bucket counts give the
offsets of gapless slots.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, importable

SHARDS = 40
SEED = 7
#: partitions whose counts are divided in one task
GROUP = 1024
#: numpy draws exactly below that many rows
EXACT = 1_000_000_000
#: rows of a shard that are put in order at a time
BUCKET_ROWS = 20_000


def hypergeometric(good: int, bad: int, n: int, rng: random.Random) -> int:
    """A draw of any size by inversion outward from the mode.

    The mode's probability is a difference of log-gammas in double precision, so beyond some
    10^9 rows the draw's distribution has a relative error of about 10^-5; margins stay exact.
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    left = right = mode
    p_left = p_right = p
    u = rng.random() - p
    while u > 0:
        moved = False
        if right < high:
            p_right *= (good - right) * (n - right) / ((right + 1) * (bad - n + right + 1))
            right += 1
            u, moved = u - p_right, True
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - n + left) / ((good - left + 1) * (n - left + 1))
            left -= 1
            u, moved = u - p_left, True
            if u <= 0:
                return left
        if not moved or max(p_left, p_right) < 1e-300:  # what rounding leaves over
            return mode
    return mode


def communication_matrix(sizes: list[int], room: list[int], seed: int | list[int] = SEED) -> np.ndarray:
    """Rows of each partition (first axis) for each shard, whose totals are `room`; both have the same sum."""
    rng, left, out = np.random.default_rng(seed), np.array(room, np.int64), np.zeros((len(sizes), len(room)), np.int64)
    own = random.Random(int(rng.integers(1 << 62)))
    for p, size in enumerate(sizes):
        if left.sum() < EXACT:
            out[p] = rng.multivariate_hypergeometric(left, size, method="marginals")
        else:
            n, rest = size, int(left.sum())
            for s, good in enumerate(left.tolist()):
                rest -= good
                out[p, s] = hypergeometric(good, rest, n, own) if n else 0
                n -= int(out[p, s])
        left -= out[p]
    return out


def _ends(sizes: DataFrame, shards: int, seed: int, group: int) -> DataFrame:
    """part and ends: how many of a partition's rows go to its first shard, its first two and so on; sizes has part and n."""
    spark = sizes.sparkSession
    sizes = sizes.withColumn("group", F.floor(F.col("part") / group).cast("int"))
    totals = sizes.groupBy("group").agg(F.sum("n").alias("n")).orderBy("group").collect()
    total = sum(n for _, n in totals)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in totals], room, seed)
    rooms = spark.createDataFrame([(g, row.tolist()) for (g, _), row in zip(totals, matrix, strict=True)], "group int, room array<long>")

    def divide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        drawn = communication_matrix(rows["n"].tolist(), list(rows["room"].iloc[0]), [seed, 1 + int(key[0])])
        return pd.DataFrame({"part": rows["part"].to_numpy(), "ends": list(drawn.cumsum(axis=1))})

    return importable(sizes.join(rooms, "group")).groupBy("group").applyInPandas(divide, "part int, ends array<long>")


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, bucket_rows: int = BUCKET_ROWS, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, part, shard, slot.

    size: UTF-8 bytes of the text plus 16; null counts no bytes and, for the checksum, as
    empty. Shards 0 to shards - 1 get counts that differ by one at most; slots of a shard
    run from 0 without gaps. Rows with a null or repeated id are dealt like any others, a
    row that repeats another wholly is interchangeable with it. Other columns are ignored.
    An empty table gives an empty result. Only the sizes of groups of `group` partitions
    reach the driver.
    """
    scratch = scratch or Scratch(df.sparkSession)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")))
    rows = df.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), F.spark_partition_id().alias("part"))
    rows = scratch.save(rows, "rows")  # fixes which partition a row came from
    sizes = scratch.save(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "sizes")
    ends = scratch.save(_ends(sizes, shards, seed, group), "ends")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    first = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "id", "crc"), "id", "crc")
    rows = rows.withColumn("at", F.row_number().over(first)).join(ends, "part")
    shard = F.size(F.filter("ends", lambda e: e < F.col("at")))
    buckets = max(1, (total // shards + 1) // bucket_rows)
    key = F.xxhash64(F.lit(seed + 1), "id", "crc", "part")
    rows = rows.select("id", "size", "crc", "part", shard.alias("shard"), key.alias("key"))
    rows = scratch.save(rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 20), F.lit(buckets)).cast("int")), "dealt")

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    second = Window.partitionBy("shard", "bucket").orderBy("key", "id", "crc")
    rows = rows.withColumn("at", F.row_number().over(second)).join(offsets, ["shard", "bucket"])
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "part", "shard", (F.col("base") + F.col("at") - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", **how) -> None:
    """Writes whole rows with their slot under shard=<n>, in slot order within a file.

    Each row is written once, whatever its id: rows are stored with a number, by which they
    are dealt and joined with their places. Columns may have any names; one that is called
    shard or slot, in any case, is written as input_shard or input_slot (and with another
    input_ before it if that is taken too).
    """
    scratch = how.pop("scratch", None) or Scratch(df.sparkSession)
    df.schema[id_col]  # dealt by number, yet the column has to be there
    names: list[str] = []
    for c in df.columns:
        while c.lower() in {"shard", "slot", *(n.lower() for n in names)}:
            c = f"input_{c}"  # noqa: PLW2901
        names.append(c)
    own = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(df.columns)]
    rows = scratch.save(df.select(F.monotonically_increasing_id().alias("number"), *own), "numbered")
    text = f"k{df.columns.index(text_col)}"
    places = shuffle_to_shards(rows, shards, "number", text, scratch=scratch, **how).select("number", "shard", "slot")
    rows = rows.join(places, "number").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(*(F.col(f"k{i}").alias(n) for i, n in enumerate(names)), "slot", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
