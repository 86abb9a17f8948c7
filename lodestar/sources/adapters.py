"""Model tables (chunks, blocks, elements, questions, assets) from raw tables.

Corpora come as documents, pages and benchmark items; these adapters give them the shape
that the retrieval operators expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_LINES = 10
ELEMENT = r"(?s)<(?:title|h1|p|li|div|footer)(?: [^>]*)?>.*?</(?:title|h1|p|li|div|footer)>"


def document_chunks(documents: DataFrame) -> DataFrame:
    """One chunk a document: title = source, section = lang; pages of 2,000 characters."""
    page = (F.col("doc_id") % 10 + 1).cast("int")
    return documents.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("corpus_pos"),
        F.col("source").alias("doc_id"),
        F.col("source").alias("title"),
        F.col("lang").alias("section"),
        F.lit("UNKNOWN").alias("subsection"),
        page.alias("page_start"),
        (page + F.floor(F.char_length("text") / 2000)).cast("int").alias("page_end"),
        "text",
        F.array().cast("array<string>").alias("tags"),
        F.lit("standard").alias("chunk_kind"),
        F.lit(None).cast("string").alias("parent_chunk_id"),
        F.lit(None).cast("string").alias("source_path"),
        F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+")).alias("token_count"),
    )


def line_blocks(documents: DataFrame) -> DataFrame:
    """One block a line of a document; ten lines make a page."""
    lines = documents.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("block_ord", "text"))
    page = (F.floor(F.col("block_ord") / PAGE_LINES) + 1).cast("int")
    return lines.select(
        F.format_string("%d_b%05d", "doc_id", "block_ord").alias("block_id"),
        "doc_id",
        F.col("source").alias("title"),
        page.alias("page_start"),
        page.alias("page_end"),
        F.col("lang").alias("section"),
        F.lit("UNKNOWN").alias("subsection"),
        "text",
        F.lit("paragraph").alias("block_type"),
        F.lit(None).cast("string").alias("source_path"),
        "block_ord",
    ).where("text <> ''")


def page_elements(pages: DataFrame) -> DataFrame:
    """Elements of raw HTML, in order: h1 as heading (level 1), li as table, div as image, footer as caption, title and p as paragraph."""
    found = F.regexp_extract_all("html", F.lit(ELEMENT), F.lit(0))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(found).alias("ord", "raw"))
    name = F.regexp_extract("raw", r"^<(\w+)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]+>", " "), r"\s+", " "))
    kind = F.when(name == "h1", "heading").when(name == "li", "table").when(name == "div", "image").when(name == "footer", "caption").otherwise("paragraph")
    return rows.select("doc_id", "ord", kind.alias("type"), (F.floor(F.col("ord") / PAGE_LINES) + 1).cast("int").alias("page"), F.when(name == "h1", 1).alias("heading_level"), text.alias("content"))


def questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vector_queries(embeddings: DataFrame) -> DataFrame:
    """Every twentieth vector is a query."""
    return embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
