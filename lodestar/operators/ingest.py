"""Elements to blocks and assets; corpus manifests and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import UNKNOWN, normalize_ws, safe_int, slug

BLOCK_TYPES = ("paragraph", "list", "text block", "caption", "table")
LOW_TEXT = 80


def section_fill(elements: DataFrame, types: tuple[str, ...] = BLOCK_TYPES) -> DataFrame:
    """Blocks with the section and subsection that the headings before them set.

    Headings of level 1 and 2 open a section and end the subsection; deeper ones (a missing
    level is 6) open a subsection. Elements without text are dropped first.
    """
    rows = elements.withColumn("text", normalize_ws("content")).where("text <> ''")
    upto = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading, top = F.col("type") == "heading", F.coalesce("heading_level", F.lit(6)) <= 2
    section = F.last(F.when(heading & top, F.col("text")), ignorenulls=True).over(upto)
    subsection = F.last(F.when(heading & top, F.lit(UNKNOWN)).when(heading, F.col("text")), ignorenulls=True).over(upto)
    rows = rows.withColumn("section", F.coalesce(section, F.lit(UNKNOWN))).withColumn("subsection", F.coalesce(subsection, F.lit(UNKNOWN)))
    rows = rows.where(heading | F.col("type").isin(*types))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return rows.select("doc_id", "ord", place.alias("block_ord"), F.replace("type", F.lit(" "), F.lit("_")).alias("block_type"), "page", "section", "subsection", "text")


def extract_assets(elements: DataFrame, kinds: tuple[str, ...] = ("table", "image")) -> DataFrame:
    """Tables and images with an index per document and kind."""
    rows = elements.where(F.col("type").isin(*kinds))
    index = F.row_number().over(Window.partitionBy("doc_id", "type").orderBy("ord"))
    return rows.withColumn("index", index).withColumn("asset_id", F.format_string("%s_%s%04d", F.col("doc_id").cast("string"), "type", "index"))


def nearest_caption(assets: DataFrame, captions: DataFrame) -> DataFrame:
    """The caption on the asset's page with the least vertical distance; the first wins ties.

    assets: doc_id, asset_id, page, top, bottom; captions: doc_id, page, ord, top, bottom, text.
    """
    c = captions.select("doc_id", "page", F.col("ord").alias("c_ord"), F.col("top").alias("c_top"), F.col("bottom").alias("c_bottom"), F.col("text").alias("c_text"))
    gap = F.least(F.abs(F.col("top") - F.col("c_bottom")), F.abs(F.col("c_top") - F.col("bottom")))
    found = assets.join(c, ["doc_id", "page"]).groupBy("doc_id", "asset_id").agg(F.min_by("c_text", F.struct(gap, "c_ord")).alias("caption"))
    return assets.join(found, ["doc_id", "asset_id"], "left")


def manifest(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """files (file, pdf_title) with catalog rows found by file name, else by slug of the stem.

    Of catalog rows that share a key the last (by pos) wins. Titles: catalog, then file's
    own, then stem.
    """
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    rows = files.withColumn("stem", stem).withColumn("slug", slug(stem))
    record = F.struct("doc_id", "title", "organization", "source_url")
    by_file = catalog.groupBy("file").agg(F.max_by(record, "pos").alias("a"))
    by_slug = catalog.groupBy(F.col("doc_id").alias("slug")).agg(F.max_by(record, "pos").alias("b"))
    found = rows.join(by_file, "file", "left").join(by_slug, "slug", "left").withColumn("c", F.coalesce("a", "b"))
    title = F.coalesce("c.title", F.when(F.trim(F.coalesce("pdf_title", F.lit(""))) != "", F.col("pdf_title")), "stem")
    return found.select("file", F.coalesce("c.doc_id", "slug").alias("doc_id"), title.alias("title"), "c.organization", "c.source_url")


def document_metadata(elements: DataFrame) -> DataFrame:
    return elements.groupBy("doc_id").agg(F.max("page").alias("num_pages"), F.count(F.lit(1)).alias("n_elements"), F.min_by("content", F.when(F.col("type") == "heading", F.col("ord"))).alias("first_heading"))


def text_density(page_texts: DataFrame, documents: DataFrame, low: int = LOW_TEXT) -> DataFrame:
    """Per document: pages, mean characters, low and empty pages, and whether it looks scanned.

    Every page from 1 to n_pages counts, also those without text rows.
    """
    pages = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    sums = page_texts.groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("chars"))
    full = pages.join(sums, ["doc_id", "page"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    per = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.round(F.avg("chars"), 4).alias("avg_chars"), F.count_if(F.col("chars") < low).alias("low_pages"), F.count_if(F.col("chars") == 0).alias("empty_pages"))
    return per.withColumn("scan_likely", (F.col("avg_chars") < low) | (F.col("low_pages") * 2 >= F.col("n_pages")))


def inventory(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """Chunks per document and kind, other kinds and none as `other`. `kinds` are given, so no extra pass looks for them."""
    kind = F.col("chunk_kind")
    counts = [F.count_if(kind == k).alias(k) for k in kinds]
    return chunks.groupBy("doc_id").agg(*counts, F.count_if(kind.isNull() | ~kind.isin(*kinds)).alias("other"), F.count(F.lit(1)).alias("n_chunks"))


def inspection_summary(density: DataFrame) -> DataFrame:
    """One row: files, files that look scanned, and whether all could be inspected (a null mean is a failure)."""
    return density.agg(F.count(F.lit(1)).alias("n_files"), F.count_if("scan_likely").alias("n_scan_likely"), F.coalesce(F.bool_and(F.col("avg_chars").isNotNull()), F.lit(True)).alias("ok"))


def export_manifest(chunks: DataFrame) -> DataFrame:
    """doc_id, title, file, n_chunks of a Markdown export."""
    return chunks.groupBy("doc_id").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n_chunks")).select("doc_id", "title", F.concat("doc_id", F.lit(".md")).alias("file"), "n_chunks")


def provenance(catalog: DataFrame, manifest_rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """catalog left-joined with manifest and file hashes; licences are not verified unless said."""
    rows = catalog.join(manifest_rows.select("doc_id", F.lit(True).alias("in_manifest")), "doc_id", "left").join(hashes.select("doc_id", "sha256"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("license_status", F.lit("not_verified")).alias("license_status"), F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"), F.col("sha256").isNotNull().alias("has_file"))


def identity(left: DataFrame, middle: DataFrame, right: DataFrame) -> DataFrame:
    """Three-way comparison of (doc_id, sha256) tables: presence and equality flags."""
    parts = [t.select("doc_id", F.col("sha256").alias(n)) for t, n in ((left, "a"), (middle, "b"), (right, "c"))]
    rows = parts[0].join(parts[1], "doc_id", "full").join(parts[2], "doc_id", "full")
    return rows.select("doc_id", F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"), F.col("c").isNotNull().alias("in_c"), F.coalesce((F.col("a") == F.col("b")) & (F.col("b") == F.col("c")), F.lit(False)).alias("same"))


def page_of(c: str) -> Column:
    """A page number, -999 where there is none."""
    return safe_int(c, -999)
