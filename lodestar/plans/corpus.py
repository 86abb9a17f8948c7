"""Queries for ingest, chunking, the navigator and relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import answers as an
from lodestar.operators import chunking as ck
from lodestar.operators import evaluate as el
from lodestar.operators import generators as gn
from lodestar.operators import ingest as ig
from lodestar.operators import navigator as nv
from lodestar.operators.retrieve import top_k
from lodestar.plans.registry import Registry, firms, people, table
from lodestar.plans.retrieval import RERANK, TERMS, chunks_of, questions_of, reranked_of
from lodestar.plans.sql import CHUNKS, NORM, tok, tokset
from lodestar.sources import adapters, files

R = Registry()

ELEMENTS = rf"""raw AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{adapters.ELEMENT}')) AS raw, generate_subscripts(regexp_extract_all(html, '{adapters.ELEMENT}'), 1) - 1 AS ord FROM pages),
elements AS (SELECT doc_id, ord, regexp_extract(raw, '^<(\w+)', 1) AS tag, CASE regexp_extract(raw, '^<(\w+)', 1) WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'table' WHEN 'div' THEN 'image' WHEN 'footer' THEN 'caption' ELSE 'paragraph' END AS type, CAST(ord // 10 + 1 AS INTEGER) AS page,
 trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM raw)"""


def elements_of(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.page_elements(table(spark, sf, "pages"))


def blocks_of(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.line_blocks(table(spark, sf, "documents"))


@R.query("block_section_fill", f"WITH {ELEMENTS}, e AS (SELECT *, {NORM.format(x='content')} AS text FROM elements WHERE {NORM.format(x='content')} <> ''), f AS (SELECT *, coalesce(last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS section FROM e) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS block_ord, type AS block_type, page, section, md5(text) AS digest FROM f WHERE type <> 'image'")
def block_section_fill(spark: SparkSession, sf: str) -> DataFrame:
    return ig.section_fill(elements_of(spark, sf)).select("doc_id", "block_ord", "block_type", "page", "section", F.md5(F.col("text").cast("binary")).alias("digest"))


@R.query("asset_extract", f"WITH {ELEMENTS} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) AS index, doc_id || '_' || type || lpad(CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) AS VARCHAR), 4, '0') AS asset_id FROM elements WHERE type IN ('table', 'image')")
def asset_extract(spark: SparkSession, sf: str) -> DataFrame:
    return ig.extract_assets(elements_of(spark, sf)).select("doc_id", "ord", "index", "asset_id")


@R.query("caption_nearest", f"WITH {ELEMENTS}, a AS (SELECT doc_id, doc_id || '_' || type || lpad(CAST(row_number() OVER (PARTITION BY doc_id, type ORDER BY ord) AS VARCHAR), 4, '0') AS asset_id, page, ord * 10 AS top, ord * 10 + 8 AS bottom FROM elements WHERE type IN ('table', 'image')), c AS (SELECT doc_id, page, ord, ord * 10 AS top, ord * 10 + 8 AS bottom, content FROM elements WHERE type IN ('paragraph', 'caption')) SELECT a.doc_id, a.asset_id, md5(arg_min(c.content, struct_pack(d := least(abs(a.top - c.bottom), abs(c.top - a.bottom)), o := c.ord))) AS digest FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.page = a.page GROUP BY ALL")
def caption_nearest(spark: SparkSession, sf: str) -> DataFrame:
    placed = elements_of(spark, sf).withColumn("top", F.col("ord") * 10).withColumn("bottom", F.col("ord") * 10 + 8)
    captions = placed.where("type IN ('paragraph', 'caption')").withColumnRenamed("content", "text")
    return ig.nearest_caption(ig.extract_assets(placed), captions).select("doc_id", "asset_id", F.md5(F.col("caption").cast("binary")).alias("digest"))


@R.query("doc_metadata", f"WITH {ELEMENTS} SELECT doc_id, max(page) AS num_pages, count(*) AS n_elements, arg_min(content, ord) FILTER (WHERE type = 'heading') AS first_heading FROM elements GROUP BY doc_id")
def doc_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return ig.document_metadata(elements_of(spark, sf))


LINES = "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents), blocks AS (SELECT *, CAST(ord // 10 + 1 AS INTEGER) AS page FROM lines WHERE text <> '')"


@R.query("inspect_text_density", f"WITH {LINES}, d AS (SELECT doc_id, max(page) + 1 AS n FROM blocks GROUP BY doc_id), p AS (SELECT doc_id, unnest(range(1, n + 1)) AS page FROM d), f AS (SELECT p.doc_id, p.page, coalesce(sum(length(b.text)), 0) AS chars FROM p LEFT JOIN blocks b ON b.doc_id = p.doc_id AND b.page = p.page GROUP BY ALL) SELECT doc_id, count(*) AS n_pages, round(avg(chars), 4) AS avg_chars, count_if(chars < 80) AS low_pages, count_if(chars = 0) AS empty_pages, avg(chars) < 80 OR count_if(chars < 80) * 2 >= count(*) AS scan_likely FROM f GROUP BY doc_id")
def inspect_text_density(spark: SparkSession, sf: str) -> DataFrame:
    """Documents are given one page more than they have text for."""
    blocks = blocks_of(spark, sf).withColumnRenamed("page_start", "page")
    return ig.text_density(blocks.select("doc_id", "page", "text"), blocks.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages")))


@R.query("corpus_inventory", "SELECT source AS doc_id, count_if(lang = 'de') AS de, count_if(lang = 'en') AS en, count_if(lang = 'es') AS es, count_if(lang = 'fr') AS fr, count_if(lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')) AS other, count(*) AS n_chunks FROM documents GROUP BY source")
def corpus_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return ig.inventory(chunks_of(spark, sf).drop("chunk_kind").withColumnRenamed("section", "chunk_kind"), ["de", "en", "es", "fr"])


@R.query("chunk_presplit")
def chunk_presplit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: a fold; tests compare with a loop."""
    return ck.presplit(blocks_of(spark, sf), 60).select("doc_id", "block_id", "block_ord", "sub_ord", "tok", F.md5(F.col("text").cast("binary")).alias("digest"))


@R.query("chunk_pack_overlap")
def chunk_pack_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return ck.pack(ck.presplit(blocks_of(spark, sf))).select("doc_id", "chunk_ord", "section", "page_start", "page_end", "token_count", F.md5(F.col("text").cast("binary")).alias("digest"))


@R.query("chunk_documents")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chunker, with cues that the corpus has."""
    out = ck.chunk_documents(blocks_of(spark, sf), cues=(" is the ", " est le "))
    return out.select("doc_id", "chunk_id", "corpus_pos", "chunk_kind", "parent_chunk_id", "token_count", "page_start", "page_end", F.md5(F.col("text").cast("binary")).alias("digest"))


@R.query("chunk_merge_tiny", f"WITH {LINES}, c AS (SELECT doc_id, ord, page, text, len({tok('text')}) AS n FROM blocks), o AS (SELECT *, CASE WHEN n < 20 AND lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) IS NOT NULL THEN 0 ELSE 1 END AS opens FROM c), i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM o) SELECT doc_id, min(ord) AS chunk_ord, min(page) AS page_start, arg_max(page, ord) AS page_end, CAST(sum(n) AS BIGINT) AS token_count, count(*) AS n_merged, md5(string_agg(text, chr(10) ORDER BY ord)) AS digest FROM i GROUP BY doc_id, island")
def chunk_merge_tiny(spark: SparkSession, sf: str) -> DataFrame:
    lines = blocks_of(spark, sf).withColumn("token_count", tx.token_count("text")).withColumnRenamed("block_ord", "chunk_ord")
    out = ck.merge_tiny(lines, 20)
    return out.select("doc_id", "chunk_ord", "page_start", "page_end", F.col("token_count").cast("long").alias("token_count"), F.col("n_merged").cast("long").alias("n_merged"), F.md5(F.col("text").cast("binary")).alias("digest"))


# --- navigator ----------------------------------------------------------------

#: a taxonomy over what the corpus's metadata holds: languages and sources
TOPICS = {"romance": ("fr", "es unknown"), "germanic": ("de", "en"), "early": ("src1", "src2"), "none": ("absent",)}
SCORES = {t: " + ".join(f"CASE WHEN contains(hay, '{k}') THEN {3 if ' ' in k else 1} ELSE 0 END" for k in ks) for t, ks in TOPICS.items()}
NAV = f"""{CHUNKS}, hay AS (SELECT *, lower(doc_id || ' ' || title || ' ' || section || ' ' || subsection || ' standard ') AS hay FROM chunks),
best AS (SELECT *, list_max([{', '.join(f"struct_pack(score := {s}, topic := '{t}')" for t, s in SCORES.items())}]) AS best FROM hay),
nav AS (SELECT *, CASE WHEN best.score > 0 THEN best.topic ELSE 'none' END AS topic FROM best)"""


def navigator_of(spark: SparkSession, sf: str) -> DataFrame:
    return nv.rows(nv.assign_topics(chunks_of(spark, sf), TOPICS, "none"))


@R.query("nv_assign", f"WITH {NAV} SELECT chunk_id, topic, '[NAV] ' || title || '; ' || section || '; ' || CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END || '; chunk ' || chunk_id AS citation FROM nav")
def nv_assign(spark: SparkSession, sf: str) -> DataFrame:
    return navigator_of(spark, sf).select("chunk_id", "topic", "citation")


@R.query("ag_topic_counts", f"WITH {NAV}, t AS (SELECT unnest(['romance', 'germanic', 'early', 'none']) AS topic) SELECT t.topic, count(chunk_id) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM t LEFT JOIN nav USING (topic) GROUP BY t.topic")
def ag_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return nv.topic_counts(navigator_of(spark, sf), spark.createDataFrame([(t,) for t in TOPICS], "topic string"))


@R.query("ag_topic_doc_index", f"WITH {NAV}, s AS (SELECT topic, doc_id, section, min(corpus_pos) AS pos FROM nav GROUP BY ALL), g AS (SELECT topic, doc_id, array_to_string((list(section ORDER BY pos))[1:5], ',') AS sections FROM s GROUP BY ALL), p AS (SELECT topic, doc_id, count(*) AS n_chunks, array_to_string((list(chunk_id ORDER BY corpus_pos))[1:5], ',') AS chunk_ids FROM nav GROUP BY ALL) SELECT topic, doc_id, n_chunks, sections, chunk_ids, row_number() OVER (PARTITION BY topic ORDER BY n_chunks DESC, doc_id) AS place FROM p JOIN g USING (topic, doc_id)")
def ag_topic_doc_index(spark: SparkSession, sf: str) -> DataFrame:
    return nv.topic_documents(navigator_of(spark, sf)).select("topic", "doc_id", "n_chunks", F.array_join("sections", ",").alias("sections"), F.array_join("chunk_ids", ",").alias("chunk_ids"), "place")


@R.query("ag_top_terms", "WITH w AS (SELECT source, doc_id AS pos, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{2,}')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{2,}'), 1) AS i FROM documents), c AS (SELECT source, term, count(*) AS n, min(struct_pack(p := pos, a := i)) AS seen FROM w WHERE term NOT IN ('the', 'and', 'for', 'with', 'report', 'radiotherapy', 'radiation') GROUP BY ALL) SELECT source, term, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) AS rank FROM c QUALIFY rank <= 30")
def ag_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    return nv.top_terms(table(spark, sf, "documents").select("source", F.col("doc_id").alias("pos"), "text"), by="source")


@R.query("ag_distinct_docs", f"WITH {NAV} SELECT doc_id, array_to_string(list_sort(list_distinct(list(topic))), ',') AS topics FROM nav GROUP BY doc_id")
def ag_distinct_docs(spark: SparkSession, sf: str) -> DataFrame:
    return nv.entities(navigator_of(spark, sf)).select("doc_id", F.array_join("topics", ",").alias("topics"))


def lang_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that name what navigator rows hold."""
    return questions_of(spark, sf).withColumn("question", F.concat_ws(" ", "question", F.lit("en fr src1 src11 germanic early"), F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))))


NAVROW = "topic || ' ' || title || ' ' || section"
ASKED = "asked AS (SELECT item_id AS qid, text || ' en fr src1 src11 germanic early src' || item_id % 20 AS question FROM benchmark)"
RANKED = f"""{NAV}, {ASKED}, words AS (SELECT topic, token, count(*) AS n, min(struct_pack(p := corpus_pos, a := i)) AS seen FROM (SELECT topic, corpus_pos, unnest({tok(NAVROW)}) AS token, generate_subscripts({tok(NAVROW)}, 1) AS i FROM nav) GROUP BY ALL),
vocab AS (SELECT topic, token FROM words QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, seen) <= 80 UNION SELECT DISTINCT topic, unnest({tok("replace(topic, '-', ' ')")}) FROM nav),
qt AS (SELECT qid, len({tokset('question')}) AS size, unnest({tokset('question')}) AS token FROM asked),
ranked AS (SELECT qid, topic, round(count(*) / size, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(count(*) / size, 6) DESC, topic) AS rank FROM qt JOIN vocab USING (token) GROUP BY qid, topic, size)"""


@R.query("rk_navigator_topics", f"WITH {RANKED} SELECT qid, topic, score, rank FROM ranked")
def rk_navigator_topics(spark: SparkSession, sf: str) -> DataFrame:
    return nv.rank_topics(lang_questions(spark, sf), navigator_of(spark, sf))


@R.query("rk_navigator_docs", f"WITH {RANKED}, s AS (SELECT a.qid, n.doc_id, round(sum(len(list_intersect({tokset('a.question')}, {tokset('n.topic || chr(32) || n.title || chr(32) || n.section')})) / greatest(len({tokset('a.question')}), 1)), 6) AS score FROM asked a JOIN ranked r ON r.qid = a.qid AND r.rank <= 2 JOIN nav n ON n.topic = r.topic GROUP BY ALL) SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5")
def rk_navigator_docs(spark: SparkSession, sf: str) -> DataFrame:
    asked, nav = lang_questions(spark, sf), navigator_of(spark, sf)
    return nv.rank_documents(asked, nav, nv.rank_topics(asked, nav).where("rank <= 2"))


# --- answers, exports, generators ---------------------------------------------


SPLIT = r"string_split(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(c.text, ''), '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), '(;)\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@R.query("an_lexical_candidates", f"WITH {RERANK}, p AS (SELECT qid, rank, {TERMS} AS terms, unnest({SPLIT}) AS sentence, generate_subscripts({SPLIT}, 1) - 1 AS sentence_idx FROM reranked c), s AS (SELECT *, trim(sentence) AS t FROM p) SELECT qid, rank, sentence_idx, round(len(list_intersect(terms, {tokset('t')})) / greatest(len(terms), 1) + 0.20 / rank, 6) AS score, md5(t) AS digest FROM s WHERE length(t) BETWEEN 40 AND 700")
def an_lexical_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return an.sentence_candidates(reranked_of(spark, sf)).select("qid", "rank", "sentence_idx", "score", F.md5(F.col("sentence").cast("binary")).alias("digest"))


@R.query("an_extractive")
def an_extractive(spark: SparkSession, sf: str) -> DataFrame:
    out = an.extractive_answers(reranked_of(spark, sf))
    return out.select("qid", F.md5(F.col("answer").cast("binary")).alias("digest"), F.array_join("used_evidence_ids", ",").alias("used"))


@R.query("sink_markdown_export", f"WITH {CHUNKS} SELECT doc_id, 0 AS page_start, '' AS chunk_id, md5('# ' || min(title)) AS digest FROM chunks GROUP BY doc_id UNION ALL SELECT doc_id, page_start, chunk_id, md5('- [' || chunk_id || '; ' || CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM chunks")
def sink_markdown_export(spark: SparkSession, sf: str) -> DataFrame:
    return files.markdown_lines(chunks_of(spark, sf)).select("doc_id", "page_start", "chunk_id", F.md5(F.col("line").cast("binary")).alias("digest"))


@R.query("wn_round_robin", "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS round FROM part")
def wn_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return el.round_robin(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", ["p_size", "p_partkey"]).select("p_partkey", "p_brand", "round")


@R.query("gn_topic", "WITH q AS (SELECT n_nationkey AS pos, n_name AS title, unnest(['scope', 'guidance', 'definition', 'locator', 'comparison']) AS type, unnest(range(5)) AS i FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer)), t AS (SELECT 0 AS side, pos, i, type, n.title AS report_id, CASE i WHEN 0 THEN 'What does ' || title || ' cover?' WHEN 1 THEN 'Which guidance does ' || title || ' give?' WHEN 2 THEN 'What is ' || w || ' according to ' || title || '?' WHEN 3 THEN 'Which section of ' || title || ' discusses ' || w || '?' ELSE 'Compare ' || title || ' with similar reports on ' || w || '.' END AS question FROM (SELECT *, lower(array_to_string(regexp_extract_all(title, '[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*')[1:3], ' ')) AS w FROM q) n UNION ALL SELECT 1, r_regionkey, 0, 'control', NULL, 'Tell me about ' || r_name FROM (SELECT s_suppkey AS r_regionkey, s_name AS r_name FROM supplier)) SELECT 'q' || printf('%04d', row_number() OVER (ORDER BY side, pos, i)) AS qid, question, type, report_id, side = 1 AS expected_abstain FROM t")
def gn_topic(spark: SparkSession, sf: str) -> DataFrame:
    catalog = people(spark, sf).select(F.col("n_name").alias("doc_id"), F.col("n_name").alias("title"), F.col("n_nationkey").alias("pos"))
    controls = firms(spark, sf).select(F.col("r_regionkey").alias("pos"), F.concat(F.lit("Tell me about "), F.col("r_name")).alias("question"))
    return gn.topic_questions(catalog, controls).drop("pos")


@R.query("gn_asset", "WITH a AS (SELECT 'src' || page_id % 20 AS doc_id, 'a' || page_id AS asset_id, CASE WHEN page_id % 3 = 0 THEN 'image' ELSE 'table' END AS asset_type, CAST(page_id % 12 AS INTEGER) AS page, CAST(page_id % 5 AS INTEGER) AS rows, 3 AS columns FROM pages), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, asset_type ORDER BY page, asset_id) AS turn FROM a WHERE asset_type <> 'table' OR rows >= 2) SELECT doc_id, asset_id, asset_type, page AS expected_page, 1 AS expected_page_window, 'Which page shows the ' || asset_type || ' on ' || CASE WHEN asset_type = 'table' THEN 'detected table with ' || rows || ' rows and 3 columns' ELSE 'detected image' END || '?' AS question, row_number() OVER (PARTITION BY asset_type ORDER BY turn, doc_id) AS place FROM t QUALIFY place <= 60")
def gn_asset(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.plans.retrieval import assets_of

    number = F.substring("asset_id", 2, 20).cast("long")
    assets = assets_of(spark, sf).select("doc_id", "asset_id", "asset_type", "page", (number % 5).cast("int").alias("rows"), F.lit(3).alias("columns"), F.lit("").alias("caption"))
    return gn.asset_questions(assets)


@R.query("ag_group_options", "WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS question, turn AS pos, role AS choice, turn = 1 AS correct, chr(CAST(64 + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER)) AS label FROM conversations) SELECT question, string_agg(label || ':' || choice, ',' ORDER BY label) AS options, min(CASE WHEN correct THEN label END) AS gold_label, count_if(correct) AS n_gold, count_if(correct) = 1 AS valid FROM r GROUP BY question")
def ag_group_options(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("question"), F.col("turn").alias("pos"), F.col("role").alias("choice"), (F.col("turn") == 1).alias("correct"))
    out = gn.exam_questions(raw)
    return out.withColumn("options", F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(":"), o["text"])), ","))


# --- relational patterns over the star schema ----------------------------------


@R.query("jn_left_default", "SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jn_left_default(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return table(spark, sf, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@R.query("jn_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def jn_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey")
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(keys, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionAll(c.join(keys, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@R.query("rk_topk", "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def rk_topk(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 3, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@R.query("jn_three_way_identity", "SELECT doc_id, in_a, in_b, in_c, coalesce(in_a AND in_b AND in_c, FALSE) AS same FROM (SELECT coalesce(a.doc_id, b.doc_id, c.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b, c.doc_id IS NOT NULL AS in_c FROM (SELECT doc_id FROM documents WHERE doc_id % 5 > 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 7 > 0) b USING (doc_id) FULL JOIN (SELECT doc_id FROM documents) c USING (doc_id))")
def jn_three_way_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Three listings of one corpus, two of which lack some documents."""
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return ig.identity(rows.where("doc_id % 5 > 0"), rows.where("doc_id % 7 > 0"), rows)


@R.query("provenance_join", "SELECT doc_id, 'not_verified' AS license_status, doc_id IN (SELECT doc_id FROM labels) AS in_manifest, text <> '' AS has_file FROM documents")
def provenance_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    catalog = docs.select("doc_id", F.lit(None).cast("string").alias("license_status"))
    hashes = docs.where("text <> ''").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return ig.provenance(catalog, table(spark, sf, "labels").select("doc_id").distinct(), hashes)


