"""Line and record files read by many tasks: line numbers, and records that span lines.

A file is read as lines, split by split; what a split doesn't know about the ones before it
(how many lines they have, whether they end inside quotes) is a few bytes a split, summed
up over the splits of a file and joined back. Only records that cross an edge of a split
are put together by a shuffle. The number of splits is the size of the data over some 128
MB, so their table is broadcast, up to SPLITS of them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.sources.shared import fresh_folder, saved, ship

#: splits whose table may be broadcast; at 128 MB each, some 250 TB
SPLITS = 2_000_000


def split_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, block (where the split begins), value: lines without their line feed, in the order of the split."""
    lines = spark.read.text(path, lineSep="\n", **options)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _per_split(df: DataFrame) -> DataFrame:
    """A saved table of splits, to be broadcast; an error beyond SPLITS."""
    table = saved(df, fresh_folder(df.sparkSession, "splits"), "splits")
    n = table.count()
    if n > SPLITS:
        raise ValueError(f"{n} splits are more than {SPLITS}: read with a larger spark.sql.files.maxPartitionBytes")
    return F.broadcast(table)


def numbered_lines(spark: SparkSession, path: str, across: bool = False, **options) -> DataFrame:
    """file, line_no, value; line numbers begin at 1 in each file, or `across` go on from file to file by name.

    A line's number is its place in the split plus the lines of earlier splits; no line is
    moved. Blank lines count, an end of file after the last line feed doesn't.
    """
    lines = split_lines(spark, path, **options).withColumn("id", F.monotonically_increasing_id())
    per = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("n").over(in_file), F.lit(0)))
    if across:
        files = per.groupBy("file").agg(F.sum("n").alias("lines"))
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
        per = per.join(files.select("file", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("earlier")), "file").withColumn("base", F.col("base") + F.col("earlier"))
    placed = lines.join(_per_split(per.select("file", "block", "first", "base")), ["file", "block"], "left")
    number = F.when(F.col("base").isNull(), F.raise_error(F.lit("the file was split in another way meanwhile"))).otherwise(F.col("id") - F.col("first") + F.col("base") + 1)
    return placed.select("file", number.cast("long").alias("line_no"), "value")


def json_line_errors(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """file, line_no, line, error: a row for each line that isn't a JSON object, and one (line 0) for each file without records.

    Blank lines are passed over but count as lines.
    """
    lines = numbered_lines(spark, path, across).where("trim(value) <> ''")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    error = F.when(kind.isNull(), "invalid JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
    bad = lines.select("file", "line_no", F.col("value").alias("line"), error.alias("error")).where("error IS NOT NULL")
    listed = [(re.sub("^file:/+", "file:/", f),) for f in spark.read.text(path).inputFiles()]  # also those without a split
    there = spark.createDataFrame(listed, "file string")
    empty = there.join(split_lines(spark, path).where("trim(value) <> ''").select("file").distinct(), "file", "left_anti")
    return bad.unionByName(empty.select("file", F.lit(0).cast("long").alias("line_no"), F.lit("").alias("line"), F.lit("empty file").alias("error")))


# --- comma-separated records ----------------------------------------------------


def ends_inside(line: str, inside: bool, comma: str = ",") -> bool:
    """Whether a line ends inside a quoted field, if it begins inside one or not.

    A quote opens a field only at its beginning; inside, two quotes are one; after the
    closing quote anything up to the comma belongs to the field.
    """
    at, n = 0, len(line)
    while True:
        if not inside:
            if at < n and line[at] == '"':
                at += 1
            else:
                at = line.find(comma, at) + 1
                if not at:
                    return False
                continue
        while True:  # to the closing quote
            at = line.find('"', at) + 1
            if not at:
                return True
            if at < n and line[at] == '"':
                at += 1
                continue
            break
        inside = False
        at = line.find(comma, at) + 1
        if not at:
            return False


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Rows of one split at a time, in order; a split may come in several pieces."""
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            yield keys[at], batch.slice(at, end - at)
            at = end


def _exits(comma: str):
    """A row a split: whether it ends inside quotes, if it begins outside, and if it begins inside."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[str, int], list[bool]] = {}
        for key, rows in _runs(batches):
            state = done.setdefault(key, [False, True])
            quoted = pc.fill_null(pc.match_substring(rows.column("value"), '"'), False)
            for line in rows.column("value").filter(quoted).to_pylist():
                state[:] = [ends_inside(line, s, comma) for s in state]
        if done:
            yield pa.record_batch({"file": [k[0] for k in done], "block": pa.array([k[1] for k in done], pa.int64()), "outer": [s[0] for s in done.values()], "inner": [s[1] for s in done.values()]})

    return run


def _records(comma: str):
    """Records of each split: text, whether it begins inside (the rest of one before) and whether it ends inside."""
    names = ("file", "block", "at", "text", "head", "open")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, held, inside, head = None, 0, [], False, False
        rows: list[tuple] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=list(names))

        for now, part in _runs(batches):
            if now != key:
                if held:
                    rows.append((*key, at, "\n".join(held), head, True))
                key, at, held, inside = now, 0, [], part.column("inside")[0].as_py()
                head = inside
            quoted = pc.fill_null(pc.match_substring(part.column("value"), '"'), False).to_pylist()
            for line, q in zip(part.column("value").to_pylist(), quoted, strict=True):
                held.append(line)
                inside = ends_inside(line, inside, comma) if q else inside
                if not inside:
                    rows.append((*key, at, held[0] if len(held) == 1 else "\n".join(held), head, False))
                    at, held, head = at + 1, [], False
            if len(rows) >= 4096:
                yield table()
                rows.clear()
        if held:
            rows.append((*key, at, "\n".join(held), head, True))
        if rows:
            yield table()

    return run


def csv_records(spark: SparkSession, path: str, comma: str = ",", **options) -> DataFrame:
    """file, block, at, text: whole records as text, in their order by (file, block, at); quoted line breaks stay in them.

    A record that is never closed runs to the end of its file, as in a reader of whole files.
    """
    ship(spark)
    lines = split_lines(spark, path, **options)
    exits = lines.mapInArrow(_exits(comma), "file string, block long, outer boolean, inner boolean")
    splits = exits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "outer", "inner"))).alias("s"))

    def one(acc: Column, s: Column) -> Column:
        after = F.when(acc["inside"], s["inner"]).otherwise(s["outer"])
        return F.struct(after.alias("inside"), F.concat(acc["starts"], F.array(F.struct(s["block"].alias("block"), acc["inside"].alias("inside")))).alias("starts"))

    zero = F.struct(F.lit(False).alias("inside"), F.array().cast("array<struct<block:bigint,inside:boolean>>").alias("starts"))
    starts = splits.select("file", F.explode(F.aggregate("s", zero, one, lambda acc: acc["starts"])).alias("x")).select("file", "x.block", "x.inside")
    placed = lines.join(_per_split(starts), ["file", "block"], "left").withColumn("inside", F.when(F.col("inside").isNull(), F.raise_error(F.lit("the file was split in another way meanwhile"))).otherwise(F.col("inside")).cast("boolean"))
    pieces = placed.mapInArrow(_records(comma), "file string, block long, at long, text string, head boolean, open boolean")
    pieces = saved(pieces, fresh_folder(spark, "records"), "pieces")
    whole = pieces.where("NOT head AND NOT open").select("file", "block", "at", "text")
    upto = Window.partitionBy("file").orderBy("block", "at")  # two rows a split at most
    edges = pieces.where("head OR open").withColumn("record", F.sum((~F.col("head")).cast("int")).over(upto))
    joined = edges.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("p"))
    return whole.unionByName(joined.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"), F.array_join("p.text", "\n").alias("text")))


def read_csv_split(spark: SparkSession, path: str, required: list[str] | None = None, comma: str = ",", place: bool = False, **options) -> DataFrame:
    """CSV with a header in each file, quoted line breaks and a byte-order mark allowed, read by as many tasks as the file has splits.

    Columns are strings, named by the first file's header; missing `required` ones raise.
    An empty field is null, unless it is quoted. Blank lines are no records. place=True adds
    file, block and at, by which records are in order.
    """
    records = csv_records(spark, path, comma, **options)
    records = records.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\r\z", ""), "^﻿", ""))
    is_header = (F.col("block") == 0) & (F.col("at") == 0)
    first = records.where(is_header).orderBy("file").select("text").first()
    if first is None:
        raise ValueError(f"no header at {path}")
    # Spark takes quoted empty fields as null too if that is what null is; no file has a value that is drawn now
    how = {"escape": '"', "sep": comma, "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n", "maxCharsPerColumn": "-1", "nullValue": uuid.uuid4().hex}
    n = len(spark.range(1).select(F.schema_of_csv(F.lit(first.text or ""), {"escape": '"', "sep": comma}).alias("s")).first().s.split(", "))
    plain = ", ".join(f"_c{i} string" for i in range(n))
    header = spark.range(1).select(F.from_csv(F.lit(first.text), plain, how).alias("r")).first().r
    names = [(x or f"_c{i}").strip() for i, x in enumerate(header)]
    missing = [c for c in required or [] if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = records.where(~is_header & (F.col("text") != "")).select("file", "block", "at", F.from_csv("text", plain, how).alias("r"))
    columns = [F.col(f"r._c{i}").alias(name) for i, name in enumerate(names)]
    return rows.select(*(["file", "block", "at"] if place else []), *columns)
