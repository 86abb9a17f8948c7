"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

An item's windows are its runs of WINDOW consecutive words; equal windows of several items
are one, and are told apart by item only in the last step. A window's shingles are its
runs of SHINGLE words (of all its words, if it has fewer).

1. One scan of the corpus hashes each word once, forms the shingles' keys from the word
   hashes and keeps the positions whose key is a window's, with the words around them and a
   row number. That table is small, and is all that the rest reads.
2. It says how often each shingle occurs. A window's shingles are ordered by that, rarest
   first. A document contains the window only if it contains all of its shingles, so the
   necessary prefix of the order is one shingle: the rarest. Only it is joined with the kept
   positions.
3. Each such position fixes where the window would have to begin; those that would begin
   before the text or end after it are discarded (position and length bounds), and the rest
   are verified word by word against the words kept.

Up to BROADCAST shingles or windows are broadcast; beyond that count the joins shuffle
narrow rows, and the words around a position are fetched from a saved table by row number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch

WINDOW = 10
SHINGLE = 5
#: all ASCII characters but digits and a to z
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: rows that are broadcast at most: keys of 8 bytes, or windows of about 200
BROADCAST = 200_000


def words(text: Column) -> Column:
    """The words; splitting at the gaps is much faster than matching the words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


def _key(hashes: Column, at: Column, k: int) -> Column:
    """The key of the k words from position `at`, given the words' hashes."""
    return F.xxhash64(F.lit(k), *(F.get(hashes, at + i) for i in range(k)))


def _hashes(all_words: Column) -> Column:
    return F.transform(all_words, lambda x: F.xxhash64(x))


def _positions(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds p (word position), k (words of the shingle) and t (key of the shingle that begins there) to rows with w and n.

    A text without words has one row with neither p nor t. Rows with the first size are one a position.
    """
    rows = texts.withColumn("h", _hashes(F.col("w"))).select("*", F.posexplode_outer("h").alias("p", "x"))
    key = lambda k: F.when(F.col("p") + k <= F.col("n"), _key(F.col("h"), F.col("p"), k))
    if len(sizes) == 1:
        return rows.select(*texts.columns, "p", F.lit(sizes[0]).alias("k"), key(sizes[0]).alias("t"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), key(k).alias("t")) for k in sizes)))
    return rows.select(*texts.columns, "p", each.alias("s")).select(*texts.columns, "p", "s.k", "s.t")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """item, w (words of the window): an item with fewer words is one window; none: no window."""
    rows = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    rows = rows.select("item", "all", F.explode(starts).alias("s"))
    return rows.select("item", F.slice("all", F.col("s") + 1, F.lit(window)).alias("w")).distinct()


def _join(df: DataFrame, small: DataFrame, n: int, limit: int, on: str, how: str = "inner") -> DataFrame:
    return df.join(F.broadcast(small) if n <= limit else small, on, how)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[Column] | None = None, keep_text: bool = False, window: int = WINDOW, shingle: int = SHINGLE, limit: int = BROADCAST, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items, items_sha256, contaminated, then the `keep` columns and, by `keep_text`, text.

    A word is hit if it lies inside any occurrence of a window. Null and empty texts have
    no words and are clean; so are all documents if there are no items. Rows that repeat an
    id, or have none, are judged one by one. Rows that repeat an item's id add their windows
    to it; a null item id counts no item, though its windows hit. Other columns are ignored.
    An empty table gives an empty result. Ids and item ids may have any type.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    named = scratch.save(item_windows(items, item_id, item_text, window), "items")
    windows = named.select("w").distinct().withColumn("size", F.size("w")).withColumn("k", F.least("size", F.lit(shingle)))
    sizes = sorted(k for (k,) in windows.select("k").distinct().collect()) or [shingle]  # 1 to shingle
    offsets = windows.select("w", "size", "k", _hashes(F.col("w")).alias("h"), F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))).alias("o"))
    key = reduce(lambda rest, k: F.when(F.col("k") == k, _key(F.col("h"), F.col("o"), k)).otherwise(rest), sizes, F.lit(None).cast("long"))
    inner = scratch.save(offsets.select("w", "size", "o", key.alias("t")), "shingles")
    known = scratch.save(inner.select("t", F.lit(True).alias("known")).distinct(), "keys")
    n_known = known.count()

    names = docs.select(*(keep or [])).columns
    own = F.struct(F.col(id_col).alias("id"), *(c.alias(f"k{i}") for i, c in enumerate(keep or [])), *([F.col(text_col).alias("text")] if keep_text else [])).alias("own")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), own, words(F.col(text_col)).alias("w")).withColumn("n", F.size("w"))
    reach = F.greatest(F.col("p") + F.col("k") - window, F.lit(0))
    around = F.struct(reach.alias("from"), F.slice("w", reach + 1, F.col("p") + window - reach).alias("w")).alias("around")
    marks = (F.coalesce("p", F.lit(0)) == 0) & (F.col("k") == sizes[0])
    if n_known <= limit:
        kept = _positions(texts, sizes).join(F.broadcast(known), "t", "left").where(F.col("known") | marks)
        kept = kept.select("row", marks.alias("mark"), F.when(marks, F.col("own")).alias("own"), "n", "p", "t", "known", F.when(F.col("known"), around).alias("around"))
        kept = scratch.save(kept, "positions")
        documents, hits = kept.where("mark").select("row", "own", "n"), kept.where("known").select("row", "n", "p", "t", "around")
    else:
        texts = scratch.save(texts, "texts")
        narrow = _positions(texts, sizes).select("row", "p", "k", "t").join(known, "t", "left_semi")
        documents, hits = texts.select("row", "own", "n"), scratch.save(texts.join(narrow, "row").select("row", "n", "p", "t", around), "positions")

    rarity = hits.groupBy("t").agg(F.count(F.lit(1)).alias("frequency"))
    order = Window.partitionBy("w").orderBy("frequency", "t", "o")
    # a window whose rarest shingle never occurs cannot occur itself
    prefix = inner.join(rarity, "t", "left").fillna(0, ["frequency"]).withColumn("rank", F.row_number().over(order)).where("rank = 1 and frequency > 0")
    prefix = scratch.save(prefix.select("t", "o", "size", "w"), "prefixes")
    begin = F.col("p") - F.col("o")
    found = _join(hits, prefix, prefix.count(), limit, "t").where((begin >= 0) & (begin + F.col("size") <= F.col("n")))
    found = found.where(F.slice("around.w", begin - F.col("around.from") + 1, F.col("size")) == F.col("w"))
    found = scratch.save(found.select("row", "w", F.struct(begin.alias("b"), (begin + F.col("size")).alias("e")).alias("span")), "occurrences")

    covered = F.aggregate(
        F.array_sort(F.collect_set("span")),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["hit"] + F.greatest(s["e"] - F.greatest(s["b"], a["end"]), F.lit(0))).alias("hit"), F.greatest(a["end"], s["e"]).alias("end")),
        lambda a: a["hit"],
    )
    hit = found.groupBy("row").agg(covered.alias("hit"))
    items_of = _join(found.select("row", "w").distinct(), named, named.count(), limit, "w").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    # rows that hold a window go to the documents by broadcast if they and their items are few
    per = scratch.save(hit.join(items_of, "row"), "contaminated")
    n_rows, n_items = per.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    placed = _join(documents, per, max(n_rows, n_items), limit, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return placed.select(
        F.col("own.id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
        *(F.col(f"own.k{i}").alias(n) for i, n in enumerate(names)),
        *(["own.text"] if keep_text else []),
    )
