"""Connected components of a link table, as rounds of joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., 2014) turn every component
into a star around its smallest node. Each round is written to the shared folder, so the
lineage stays short and nothing but two numbers a round reaches the driver. Nodes may have
any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch

#: a key is hot if it has more than HOT_ROWS rows and more than one in HOT_SHARE of all
HOT_ROWS, HOT_SHARE = 128, 100_000


def hot(n: Column, rows: int) -> Column:
    """Whether n of `rows` rows make a key hot; fewer than HOT_SHARE keys are."""
    return n > max(HOT_ROWS, rows // HOT_SHARE)


def join_to_unique(left: DataFrame, right: DataFrame, on: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has unique keys and their number of left rows in n.

    Rows of a hot key would meet in one task: its right row is broadcast instead, of which
    there are fewer than HOT_SHARE.
    """
    many = right.where(hot(F.col("n"), rows))
    few = left.join(F.broadcast(many.select(on)), on, "left_anti").join(right, on, how)
    return left.join(F.broadcast(many), on).unionByName(few)


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "a"))
    return join_to_unique(both, least, "a", 2 * rows).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Links here run from the larger to the smaller node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_to_unique(links, least, "a", rows).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reached.

    Links are undirected; repeated links, loops and rows with a null end change nothing. A
    long path takes about log2 of its length in rounds; rounds go on until nothing changes.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = scratch.save(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        n, mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if n == 0 or (n, mark) == before:
            break
        before = (n, mark)
        large = scratch.save(_large_star(now, n).where("a <> b").distinct(), "large-stars")
        now = scratch.save(_small_star(large, n).where("a <> b").distinct(), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
