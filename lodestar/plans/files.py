"""Queries over files that Spark derives from the tables: nested elements, strict lines, CSV, logs, the saved index, streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.audit import gold_paths
from lodestar.operators.nested import element_texts
from lodestar.operators.segments import SegmentIndex
from lodestar.plans.corpus import ELEMENTS, elements_of
from lodestar.plans.registry import Registry, table
from lodestar.plans.retrieval import chunks_of, questions_of
from lodestar.plans.sql import BM25, NORM
from lodestar.sources import shared, splits
from lodestar.streaming import events as ev

R = Registry()

#: elements of a page that share a level of its nesting
PER_LEVEL = 5


def nested_pages(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, node: a page as one nested element, each level of which holds PER_LEVEL elements and the next level.

    Images have their text a level below, under blank content; captions hide a child behind content of their own.
    """
    one = F.to_json(F.struct(F.col("content")))
    leaf = F.when(F.col("type") == "image", F.concat(F.lit('{"content":" ","kids":['), one, F.lit("]}"))).when(F.col("type") == "caption", F.concat(F.regexp_replace(one, r"\}$", ""), F.lit(',"kids":[{"content":"hidden"}]}'))).otherwise(one)
    rows = elements_of(spark, sf).select("doc_id", "ord", F.floor(F.col("ord") / PER_LEVEL).alias("level"), leaf.alias("leaf"))
    levels = rows.groupBy("doc_id", "level").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "leaf")))["leaf"], ",").alias("leaves"))
    pages = levels.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("level", "leaves")))["leaves"].alias("levels"))
    text = F.concat(F.lit('{"kids":['), F.array_join("levels", ',{"kids":['), F.expr("repeat(']}', size(levels))"))
    return pages.select("doc_id", F.parse_json(text).alias("node"))


ELEM_SQL = f"""WITH RECURSIVE {ELEMENTS},
leaf AS (SELECT doc_id, ord, ord // {PER_LEVEL} AS level, CASE type WHEN 'image' THEN '{{"content":" ","kids":[' || to_json(struct_pack(content := content)) || ']}}' WHEN 'caption' THEN '{{"content":' || to_json(content) || ',"kids":[{{"content":"hidden"}}]}}' ELSE to_json(struct_pack(content := content)) END AS leaf FROM elements),
levels AS (SELECT doc_id, level, string_agg(leaf, ',' ORDER BY ord) AS leaves FROM leaf GROUP BY ALL),
page AS (SELECT doc_id, CAST('{{"kids":[' || string_agg(leaves, ',{{"kids":[' ORDER BY level) || repeat(']}}', count(*)) AS JSON) AS node FROM levels GROUP BY doc_id),
walk AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, node FROM page
 UNION ALL SELECT doc_id, list_append(path, CAST(pos AS BIGINT)), kid FROM (SELECT doc_id, path, unnest(CAST(node -> '$.kids' AS JSON[])) AS kid, generate_subscripts(CAST(node -> '$.kids' AS JSON[]), 1) AS pos FROM walk WHERE trim(coalesce(node ->> '$.content', '')) = '')),
parts AS (SELECT doc_id, path, {NORM.format(x="node ->> '$.content'")} AS text FROM walk WHERE trim(coalesce(node ->> '$.content', '')) <> ''),
joined AS (SELECT doc_id, string_agg(text, ' ' ORDER BY path) AS text, count(*) AS n_parts, max(len(path)) AS depth FROM parts GROUP BY doc_id)
SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(coalesce(n_parts, 0) AS INTEGER) AS n_parts, CAST(coalesce(depth, 0) AS INTEGER) AS depth FROM page LEFT JOIN joined USING (doc_id)"""


@R.query("elem_text", ELEM_SQL)
def elem_text(spark: SparkSession, sf: str) -> DataFrame:
    return element_texts(nested_pages(spark, sf), "doc_id", "node").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_parts", "depth")


GOLD_SQL = """WITH c AS (SELECT conv_id, to_json(struct_pack(conv := conv_id, turns := list(struct_pack(role := role, Gold_role := CASE WHEN turn % 2 = 1 THEN role END, meta := struct_pack(n := length(text), goldLength := [length(text), turn], kids := [struct_pack(text := 'gold', "has gold" := turn = 1)])) ORDER BY turn))) AS j FROM conversations GROUP BY conv_id)
SELECT conv_id, replace(t.fullkey, '"', '') AS path FROM c, json_tree(c.j) t WHERE contains(lower(regexp_extract(replace(t.fullkey, '"', ''), '\\.([^.\\[\\]]*)$', 1)), 'gold')"""


@R.query("fn_gold_paths", GOLD_SQL)
def fn_gold_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as nested JSON, in which some keys name a gold value, at three depths."""
    n = F.char_length("text")
    meta = F.struct(n.alias("n"), F.array(n.cast("long"), F.col("turn")).alias("goldLength"), F.array(F.struct(F.lit("gold").alias("text"), (F.col("turn") == 1).alias("has gold"))).alias("kids"))
    turn = F.struct("turn", F.col("role").alias("role"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("Gold_role"), meta.alias("meta"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    json = F.to_json(F.struct(F.col("conv_id").alias("conv"), F.transform("turns", lambda t: t.dropFields("turn")).alias("turns")), {"ignoreNullFields": "false"})
    return gold_paths(rows.select("conv_id", json.alias("json")), "conv_id", "json")


LINE_SQL = """WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents)
SELECT line_no, CASE WHEN doc_id % 7 = 3 THEN '{"doc_id": ' || doc_id || ', "lang": ' ELSE '[' || doc_id || ']' END AS line, CASE WHEN doc_id % 7 = 3 THEN 'invalid JSON' ELSE 'not an object' END AS error FROM l WHERE doc_id % 7 = 3 OR doc_id % 11 = 5"""


@R.query("src_jsonl_strict", LINE_SQL)
def src_jsonl_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as lines in several files, by id; some are cut short, some are arrays, and every thirteenth is blank but counts."""
    path = f"{shared.fresh_folder(spark, 'lines')}/lines"
    key = F.col("doc_id").cast("string")
    broken = F.concat(F.lit('{"doc_id": '), key, F.lit(', "lang": '))
    good = F.concat(broken, F.lit('"'), F.coalesce("lang", F.lit("")), F.lit('"}'))
    line = F.when(F.col("doc_id") % 7 == 3, broken).when(F.col("doc_id") % 11 == 5, F.concat(F.lit("["), key, F.lit("]"))).when(F.col("doc_id") % 13 == 0, F.lit(" ")).otherwise(good)
    rows = table(spark, sf, "documents").select("doc_id", line.alias("line"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("line").write.text(path)
    return splits.json_line_errors(spark, path, across=True).where("line_no > 0").select("line_no", "line", "error")


@R.query("src_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n_chars FROM documents")
def src_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as CSV, whose texts hold commas, quotes and line breaks, read back split by split."""
    path = f"{shared.fresh_folder(spark, 'csv')}/csv"
    table(spark, sf, "documents").select("doc_id", "source", "text").write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = splits.read_csv_split(spark, path, ["doc_id", "text"])
    return rows.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"), F.char_length("text").alias("n_chars"))


@R.query("sink_append_log", "SELECT user_id AS event_user, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def sink_append_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended in four batches, each sent twice, with what a failed attempt has left beside them."""
    path = shared.fresh_folder(spark, "log")
    events = table(spark, sf, "events").select(F.col("user_id").alias("event_user"), "event_type", "value")
    part = F.pmod(F.xxhash64("event_user"), F.lit(4))
    for batch in (0, 1, 0, 2, 3, 2):
        shared.append_once(events.where(part == batch), path, f"batch-{batch}", form="parquet")
    events.where(part == 1).write.parquet(f"{path}/data/left-by-a-failed-attempt")
    rows = shared.read_appended(spark, path, events.schema)
    return rows.groupBy("event_user", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- the saved index ------------------------------------------------------------


def built_index(spark: SparkSession, sf: str) -> SegmentIndex:
    """All chunks in one batch."""
    index = SegmentIndex(spark, shared.fresh_folder(spark, "index"))
    index.apply("all", chunks_of(spark, sf).withColumn("key", F.col("chunk_id")))
    return index


@R.query("sink_index_sparse", f"WITH {BM25} SELECT qid, chunk_id, doc_id, score, rank FROM sparse")
def sink_index_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """The search of rk_bm25_search by MaxScore over a saved index of posting blocks."""
    return built_index(spark, sf).search(questions_of(spark, sf)).select("qid", "chunk_id", "doc_id", "score", "rank")


GONE = "doc_id % 17 = 5"
LIVE_BM25 = BM25.replace("FROM documents)", f"FROM documents WHERE NOT ({GONE}))")


@R.query("src_add_docs", f"WITH {LIVE_BM25} SELECT qid, chunk_id, doc_id, score, rank FROM sparse")
def src_add_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents added, replaced and deleted in batches, one of them sent twice, and searched: the same as an index of what is left.

    A third of the documents first come with another text; some are deleted and added again.
    """
    chunks = chunks_of(spark, sf).withColumn("key", F.col("chunk_id")).withColumn("number", F.col("corpus_pos"))
    gone = F.expr(GONE.replace("doc_id", "number"))
    index = SegmentIndex(spark, shared.fresh_folder(spark, "index"))
    first = chunks.where("number % 2 = 0 OR number % 3 = 0")
    index.apply("first", first.withColumn("text", F.when(F.col("number") % 3 == 0, F.concat(F.lit("draft "), F.substring("text", 1, 200))).otherwise(F.col("text"))))
    for _ in range(2):
        index.apply("second", chunks.where("number % 3 = 0 OR number % 2 = 1"), chunks.where(gone | (F.col("number") % 10 == 7)).select("key"))
    index.apply("third", chunks.where("number % 10 = 7"), chunks.where(gone).select("key"))
    index.apply("fourth", deletes=chunks.where(gone).select("key"))
    return index.search(questions_of(spark, sf)).select("qid", "chunk_id", "doc_id", "score", "rank")


# --- streams over events --------------------------------------------------------


@R.query("st_first_seen", "SELECT user_id AS key, ts FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE since IS NULL OR since > INTERVAL 6 HOURS")
def st_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Events of users not seen for six hours, by a state machine with timers over a stream in order of time."""
    folder = shared.fresh_folder(spark, "stream")
    found = ev.drained(ev.first_seen(ev.replayed(table(spark, sf, "events"), folder, "events"), "user_id", timedelta(hours=6)), folder, "found", rocks=True)
    return found.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"))


@R.query("st_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id AS key, min(ts) AS started, max(ts) + INTERVAL 6 HOURS AS ended, count(*) AS n FROM y GROUP BY user_id, g HAVING max(ts) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES")
def st_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user's events, those that the last watermark has closed."""
    folder = shared.fresh_folder(spark, "stream")
    found = ev.drained(ev.sessions(ev.replayed(table(spark, sf, "events"), folder, "events"), "user_id", "6 hours"), folder, "found")
    return found.select("key", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@R.query("st_answered", "SELECT q.user_id AS key, q.event_id AS question_id, a.event_id AS answer_id FROM events q JOIN events a ON q.user_id = a.user_id AND q.event_type = 'view' AND a.event_type = 'purchase' AND a.ts > q.ts AND a.ts <= q.ts + INTERVAL 12 HOURS")
def st_answered(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases within twelve hours of a view of the same user: two streams joined under watermarks."""
    folder, events = shared.fresh_folder(spark, "stream"), table(spark, sf, "events")
    asked = ev.replayed(events.where("event_type = 'view'").withColumnRenamed("event_id", "question_id"), folder, "asked")
    told = ev.replayed(events.where("event_type = 'purchase'").withColumnRenamed("event_id", "answer_id"), folder, "told")
    return ev.drained(ev.answered(asked, told, "user_id", "12 hours", late="31 days"), folder, "found")
