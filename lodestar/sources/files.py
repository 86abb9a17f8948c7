"""Readers and writers of the file formats around the engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.sources.shared import append_once, read_appended
from lodestar.sources.splits import json_line_errors, read_csv_split


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; a bad line fails the read, blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_jsonl_permissive(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; bad lines are dropped, a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """Strict check: a row (file, line_no, line, error) for each bad line, and one for each file without records; see `splits`."""
    return json_line_errors(spark, path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; the first bad line or empty file raises with its file and line number."""
    bad = jsonl_errors(spark, path).orderBy("file", "line_no").first()
    if bad is not None:
        raise ValueError(f"{bad.error} at {bad.file}:{bad.line_no}")
    return read_jsonl(spark, path, schema)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header, a byte-order mark and quoted line breaks allowed, split over tasks; missing columns raise."""
    return read_csv_split(spark, path, required)


def read_chunk_files(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All *.chunks.jsonl of a folder; corpus_pos follows file name, then place in the file."""
    from pyspark.sql import Window

    rows = spark.read.schema(schema).json(path, pathGlobFilter="*.chunks.jsonl", mode="FAILFAST")
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    within = Window.partitionBy("file_name").orderBy("block", "at")
    per_file = rows.groupBy("file_name").count()
    before = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    bases = per_file.select("file_name", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("n", F.row_number().over(within)).join(bases, "file_name")
    return placed.withColumn("corpus_pos", F.col("base") + F.col("n") - 1).drop("file_name", "block", "at", "n", "base")


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and sha256 of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def add_documents(spark: SparkSession, inputs: list[str], target: str, suffix: str = ".pdf") -> DataFrame:
    """Copies files, or those of a folder, into `target`; a row an input: input, copied, problem. Inputs are named by hand, so few."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    into = path(target)
    into.getFileSystem(conf).mkdirs(into)
    rows: list[tuple[str, str | None, str | None]] = []
    for name in inputs:
        source = path(name)
        fs = source.getFileSystem(conf)
        if fs.exists(source) and fs.getFileStatus(source).isDirectory():
            found = sorted(s.getPath().toString() for s in fs.listStatus(source) if s.getPath().getName().lower().endswith(suffix))
        else:
            found = [name]
        for one in found:
            file = path(one)
            if not file.getName().lower().endswith(suffix):
                rows.append((one, None, f"only {suffix} files are supported"))
            elif not fs.exists(file):
                rows.append((one, None, "file does not exist"))
            else:
                jvm.org.apache.hadoop.fs.FileUtil.copy(fs, file, into.getFileSystem(conf), path(into, file.getName()), False, True, conf)
                rows.append((one, f"{target}/{file.getName()}", None))
    return spark.createDataFrame(rows, "input string, copied string, problem string")


def init_workspace(spark: SparkSession, root: str, folders: tuple[str, ...] = ("reports", "parsed", "chunks", "assets", "index", "navigator", "experience")) -> list[str]:
    """Creates an empty workspace; existing folders stay as they are."""
    made = [f"{root}/{f}" for f in folders]
    for folder in made:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)
    return made


def write_json(df: DataFrame, path: str) -> None:
    """One indented JSON document of a one-row summary, non-ASCII preserved."""
    import json

    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    spark = df.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray((json.dumps(json.loads(rows[0]), ensure_ascii=False, indent=2) + "\n").encode()))
    out.close()


def download_status(listing: DataFrame) -> DataFrame:
    """Status of fetched files from their first bytes: ok, not_a_pdf or missing."""
    head = F.substring("content", 1, 5)
    return listing.withColumn("status", F.when(F.col("content").isNull(), "missing").when(head == F.lit(b"%PDF-"), "ok").otherwise("not_a_pdf"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_by(df: DataFrame, path: str, *keys: str, mode: str = "overwrite") -> None:
    """One folder a key value; rows of a key are spread over tasks by AQE, not gathered in one."""
    df.hint("rebalance", *keys).write.partitionBy(*keys).mode(mode).parquet(path)


def append_log(df: DataFrame, path: str, batch: str | None = None) -> bool:
    """Appends records to the experience log, with a UTC time where they have none.

    A batch that was appended before changes nothing and gives False, so a driver may send
    it again; without an id each call is a batch of its own.
    """
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    stamped = df.withColumn("timestamp_utc", F.coalesce("timestamp_utc", now) if "timestamp_utc" in df.columns else now)
    return append_once(stamped, path, batch or uuid.uuid4().hex)


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The log's committed records; what an attempt that failed has left isn't read."""
    return read_appended(spark, path, schema)


def markdown_lines(chunks: DataFrame) -> DataFrame:
    """doc_id, page_start, chunk_id, line: a heading (page 0, no chunk) a document and a line a chunk, white space collapsed.

    A document is its lines by first page and chunk id; no document is gathered in a row.
    """
    from lodestar.functions.text import collapse_ws, page_range

    line = F.concat(F.lit("- ["), F.col("chunk_id"), F.lit("; "), page_range("page_start", "page_end"), F.lit("] "), collapse_ws("text"))
    heads = chunks.groupBy("doc_id").agg(F.concat(F.lit("# "), F.min("title")).alias("line"))
    heads = heads.select("doc_id", F.lit(0).alias("page_start"), F.lit("").alias("chunk_id"), "line")
    return heads.unionByName(chunks.select("doc_id", F.col("page_start").cast("int").alias("page_start"), "chunk_id", line.alias("line")))


def write_markdown(chunks: DataFrame, path: str) -> None:
    """A folder a document; its files, in name order, have its lines in order. Splitters are sampled, so a long document spans files."""
    rows = markdown_lines(chunks).repartitionByRange("doc_id", "page_start", "chunk_id").sortWithinPartitions("doc_id", "page_start", "chunk_id")
    rows.select("doc_id", "line").write.partitionBy("doc_id").mode("overwrite").text(path)
