"""Walks over nested values of any depth, one or more levels a round.

A round explodes the objects and arrays of a level into their children; the children that
are containers are the next level, the others are done. Rounds are written to the shared
folder, so a deep document makes no long plan, and a document's size is bounded by its row
alone. Texts of elements go down several levels in one plan, first few and then more, as
few documents are deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import normalize_ws
from lodestar.sources.shared import fresh_folder, saved

#: levels of the first round of an element's texts, and of any; each has twice those of the one before
LEVELS, MOST_LEVELS = 4, 16
#: whether a VARIANT is an object or an array
OBJECT, ARRAY = "schema_of_variant(node) LIKE 'OBJECT%'", "schema_of_variant(node) LIKE 'ARRAY%'"


def _levels(spark: SparkSession, level: DataFrame, step, name: str) -> DataFrame:
    """Union of what `step` emits in each round; step(level, round) gives rows with `emit` and `next` flags, which may both be set."""
    folder, found, n = fresh_folder(spark, name), None, 0
    columns = level.columns
    while True:
        rows = saved(step(level, n), folder, f"level-{n:05d}")
        emitted = rows.where("emit").drop("emit", "next")
        found = emitted if found is None else found.unionByName(emitted)
        level = rows.where("next").select(*columns)
        n += 1
        if level.isEmpty():
            return found


def element_texts(elements: DataFrame, key: str, node: str, content: str = "content", kids: str = "kids") -> DataFrame:
    """key, text, n_parts, depth of each element: its own content, else its children's texts depth first.

    `node` is a VARIANT column. A child that has content of its own is not looked into, one
    that is no object is passed over, and content that is no string, or blank, doesn't count.
    Elements may nest to any depth; depth is that of the deepest text. Keys have to be unique.
    An element without any text has an empty one.
    """
    spark = elements.sparkSession
    start = elements.select(F.col(key).alias("key"), F.array().cast("array<int>").alias("path"), F.col(node).alias("node"))

    def step(level: DataFrame, n: int) -> DataFrame:
        rows = level.withColumn("text", F.lit(None).cast("string"))
        own = F.when(F.expr(f"schema_of_variant(variant_get(node, '$.{content}')) = 'STRING'"), F.try_variant_get("node", f"$.{content}", "string"))
        said = normalize_ws(own)
        # a row with text is done and passes the levels below as it is
        done = F.col("text").isNotNull()
        below = F.when(done, F.array(F.lit(None).cast("variant"))).when(F.expr(f"schema_of_variant(variant_get(node, '$.{kids}')) LIKE 'ARRAY%'"), F.expr(f"variant_get(node, '$.{kids}', 'array<variant>')"))
        for _ in range(min(LEVELS << n, MOST_LEVELS)):
            rows = rows.withColumn("text", F.coalesce("text", F.when(said != "", said)))
            rows = rows.select("key", "path", "text", F.posexplode(below).alias("pos", "node"))
            rows = rows.select("key", F.when(done, F.col("path")).otherwise(F.concat("path", F.array("pos"))).alias("path"), "text", "node").where(f"text IS NOT NULL OR {OBJECT}")
        return rows.select("key", "path", "node", "text", done.alias("emit"), (~done).alias("next"))

    parts = _levels(spark, start, step, "elements").select("key", "path", "text")
    texts = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("parts"), F.max(F.size("path")).alias("depth"))
    rows = elements.select(F.col(key).alias("key")).join(texts, "key", "left")
    joined = normalize_ws(F.array_join(F.coalesce("parts.text", F.array().cast("array<string>")), " "))
    return rows.select(F.col("key").alias(key), joined.alias("text"), F.coalesce(F.size(F.coalesce("parts", F.expr("array()"))), F.lit(0)).alias("n_parts"), F.coalesce("depth", F.lit(0)).alias("depth"))


def key_paths(rows: DataFrame, key: str, node: str, named: Column | None = None, word: str = "gold") -> DataFrame:
    """key, path of every object key at any depth whose name holds `word` in any case: `$.a[3].gold_x`.

    `named` may replace the test; it reads the column `name`. Keys are looked for in keys
    only, never in values; a path is listed whether its value is a container or not.
    """
    test = F.contains(F.lower("name"), F.lit(word.lower())) if named is None else named
    start = rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.col(node).alias("node")).where(f"{OBJECT} OR {ARRAY}")

    def step(level: DataFrame, _: int) -> DataFrame:
        level.createOrReplaceTempView("_lodestar_level")
        kids = level.sparkSession.sql("SELECT l.key, l.path, x.pos, x.key AS name, x.value AS node FROM _lodestar_level l, LATERAL variant_explode(l.node) x")
        path = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "name"))
        return kids.select("key", path.alias("path"), "node", (F.col("name").isNotNull() & test).alias("emit"), F.expr(f"coalesce({OBJECT} OR {ARRAY}, false)").alias("next"))

    found = _levels(rows.sparkSession, start, step, "paths")
    return found.select(F.col("key").alias(key), "path")
