"""Section-aware chunking of blocks.

Splitting, merging, micro-chunks and numbering are window and array expressions. Two steps
depend on their own output (packing with overlap, dropping a chunk that repeats the last
kept one); they are folds over one document's blocks, written with `aggregate`, so no step
leaves the JVM. A document's blocks meet in one row; that is the unit the reference works
on as well, and the only grouping here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.predicates import holds_any, infer_tags
from lodestar.functions.rules import DEFINITION_CUES, TAGS
from lodestar.functions.text import UNKNOWN, overlap_min, sentences, token_count

SIZE, OVERLAP, LEAST, MICRO = 280, 40, 90, 180
SIMILAR = 0.88
PACKS = "array<struct<text:string,n:int>>"


def presplit(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Splits blocks over `size` tokens into greedy runs of sentences; adds tok and sub_ord."""
    rows = blocks.withColumn("tok", token_count("text")).withColumn("s", F.when(F.col("tok") > size, sentences("text")))
    last = lambda acc: F.element_at(acc, -1)

    def put(acc: Column, s: Column) -> Column:
        one = F.struct(s.alias("text"), token_count(s).alias("n"))
        joined = F.struct(F.concat(last(acc)["text"], F.lit(" "), s).alias("text"), (last(acc)["n"] + token_count(s)).alias("n"))
        fits = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["n"] + token_count(s) <= size)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(one))).cast(PACKS)

    packs = F.aggregate("s", F.array().cast(PACKS), put)
    whole = F.array(F.struct(F.col("text").alias("text"), F.col("tok").cast("int").alias("n"))).cast(PACKS)
    packs = F.when((F.col("tok") > size) & (F.size("s") > 1) & (F.col("block_type") != "heading"), packs).otherwise(whole)
    split = F.size(packs) > 1
    rows = rows.withColumn("split", split).select("*", F.posexplode(packs).alias("sub_ord", "p"))
    name = F.when(F.col("split"), F.format_string("%s_s%02d", "block_id", "sub_ord")).otherwise(F.col("block_id"))
    return rows.withColumn("block_id", name).withColumn("text", F.col("p.text")).withColumn("tok", F.col("p.n").cast("int")).drop("s", "p", "split")


def pack(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Greedy chunks of a document's sections, each starting with the tail of the one before.

    Sections are taken in the order in which they first appear, later runs of a section
    joining the first. Blocks larger than the overlap target are not carried over, except
    in UNKNOWN sections, whose target is 20 at most.
    """
    body = blocks.where("block_type <> 'heading'")
    group = Window.partitionBy("doc_id", "section", "subsection")
    body = body.withColumn("first", F.min("block_ord").over(group))
    item = F.struct("block_ord", "sub_ord", F.col("tok").alias("n"), "text", "page_start", "page_end")
    groups = body.groupBy("doc_id", "title", "source_path", "section", "subsection", "first").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = groups.schema["items"].dataType.simpleString()
    unknown = F.col("section") == UNKNOWN
    target = F.when(unknown, F.lit(min(20, overlap))).otherwise(F.lit(overlap))
    tokens = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"])

    def carry(current: Column) -> Column:
        """From the end: blocks within the target until it is reached."""
        start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("n"))

        def take(acc: Column, x: Column) -> Column:
            skip = (acc["n"] >= target) & (F.size(acc["kept"]) > 0) | ((x["n"] > target) & ~unknown)
            return F.when(skip, acc).otherwise(F.struct(F.concat(F.array(x), acc["kept"]).alias("kept"), (acc["n"] + x["n"]).alias("n")))

        return F.aggregate(F.reverse(current), start, take)["kept"]

    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("now"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (tokens(acc["now"]) + x["n"] > size)
        done = F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        now = F.when(full, F.concat(carry(acc["now"]), F.array(x))).otherwise(F.concat(acc["now"], F.array(x)))
        return F.struct(done.alias("done"), now.alias("now"))

    packed = F.aggregate("items", start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
    rows = groups.withColumn("packed", packed).select("*", F.posexplode("packed").alias("at", "c"))
    order = Window.partitionBy("doc_id").orderBy("first", "at")
    text = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    return rows.select(
        "doc_id", "title", "source_path", "section", "subsection",
        (F.row_number().over(order) - 1).alias("chunk_ord"), F.element_at("c", 1)["page_start"].alias("page_start"), F.element_at("c", -1)["page_end"].alias("page_end"),
        text.alias("text"), token_count(text).alias("token_count"),
    )


def merge_tiny(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """Appends chunks under `least` tokens to the one before, within a section: gaps and islands."""
    order = Window.partitionBy("doc_id").orderBy("chunk_ord")
    same = (F.lag("section").over(order) == F.col("section")) & (F.lag("subsection").over(order) == F.col("subsection"))
    rows = chunks.withColumn("opens", F.when(same & (F.col("token_count") < least), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("opens").over(order))
    parts = F.array_sort(F.collect_list(F.struct("chunk_ord", "text", "page_start", "page_end", "token_count")))
    out = rows.groupBy("doc_id", "title", "source_path", "section", "subsection", "island").agg(parts.alias("parts"))
    return out.select(
        "doc_id", "title", "source_path", "section", "subsection", F.element_at("parts", 1)["chunk_ord"].alias("chunk_ord"),
        F.element_at("parts", 1)["page_start"].alias("page_start"), F.element_at("parts", -1)["page_end"].alias("page_end"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.aggregate("parts", F.lit(0), lambda a, p: a + p["token_count"]).alias("token_count"), F.size("parts").alias("n_merged"),
    )


def tagged(chunks: DataFrame, families: dict = TAGS, cues: tuple[str, ...] = DEFINITION_CUES) -> DataFrame:
    return chunks.withColumn("tags", infer_tags(F.col("section"), F.col("subsection"), F.col("text"), F.col("chunk_kind") == "definition_microchunk", families, cues))


def with_ids(chunks: DataFrame) -> DataFrame:
    name = F.format_string("%s_c%04d", F.col("doc_id").cast("string"), "chunk_ord")
    return chunks.withColumn("chunk_id", name).withColumn("chunk_kind", F.lit("standard")).withColumn("parent_chunk_id", F.lit(None).cast("string"))


def definition_chunks(chunks: DataFrame, cues: tuple[str, ...] = DEFINITION_CUES, most: int = MICRO) -> DataFrame:
    """Each sentence with a cue and its neighbours, outside UNKNOWN sections, up to `most` tokens."""
    rows = chunks.where((F.col("section") != UNKNOWN) & holds_any(F.lower("text"), cues)).withColumn("s", sentences("text"))
    rows = rows.select("*", F.posexplode("s").alias("i", "sentence")).where(holds_any(F.lower("sentence"), cues))
    near = F.slice("s", F.greatest(F.col("i"), F.lit(1)), F.when(F.col("i") == 0, 2).otherwise(3))
    rows = rows.withColumn("text", F.array_join(near, " ")).withColumn("token_count", token_count("text")).where(F.col("token_count") <= most)
    name = F.concat("chunk_id", F.lit("_def"), F.col("i").cast("string"))
    return rows.withColumn("parent_chunk_id", F.col("chunk_id")).withColumn("chunk_id", name).withColumn("chunk_kind", F.lit("definition_microchunk")).drop("s", "i", "sentence")


def drop_repeats(chunks: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Drops a standard chunk whose words overlap the last kept one's by more than `similar`.

    In the order of pages and ids within a document; the test is against the last kept
    chunk, not the one before, so it is a fold.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != ""))
    key = F.struct("page_start", "page_end", "chunk_id", "section", "subsection", "chunk_kind", words.alias("words"))
    docs = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(key)).alias("all"))
    kind = docs.schema["all"].dataType.elementType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(None).cast(kind).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        p = acc["last"]
        twin = (x["chunk_kind"] == "standard") & (p["chunk_kind"] == "standard") & (x["section"] == p["section"]) & (x["subsection"] == p["subsection"]) & (overlap_min(p["words"], x["words"]) > similar)
        return F.when(F.coalesce(twin, F.lit(False)), acc).otherwise(F.struct(F.concat(acc["ids"], F.array(x["chunk_id"])).alias("ids"), x.alias("last")))

    kept = docs.select(F.explode(F.aggregate("all", start, step, lambda a: a["ids"])).alias("chunk_id"))
    return chunks.join(kept, "chunk_id", "left_semi")


def renumber(chunks: DataFrame) -> DataFrame:
    """New ids by document, pages and old id; a parent that was dropped becomes null."""
    order = Window.partitionBy("doc_id").orderBy("page_start", "page_end", "chunk_id")
    rows = chunks.withColumn("n", F.row_number().over(order) - 1).withColumn("new_id", F.format_string("%s_c%04d", F.col("doc_id").cast("string"), "n"))
    parents = rows.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("new_id").alias("new_parent"))
    rows = rows.join(parents, "parent_chunk_id", "left")
    return rows.drop("chunk_id", "parent_chunk_id").withColumnsRenamed({"new_id": "chunk_id", "new_parent": "parent_chunk_id"}).withColumnRenamed("n", "corpus_pos")


def chunk_documents(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, micro: int = MICRO, cues: tuple[str, ...] = DEFINITION_CUES, families: dict = TAGS) -> DataFrame:
    """The whole chunker: split, pack, merge, micro-chunks, repeats, numbers, tags."""
    standard = with_ids(merge_tiny(pack(presplit(blocks, size), size, overlap), least))
    every = standard.unionByName(definition_chunks(standard, cues, micro))
    return tagged(renumber(drop_repeats(every)), families, cues)
