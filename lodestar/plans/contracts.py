"""Queries for the contract evaluations, over answers that quote retrieved texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import contracts as ct
from lodestar.operators import evidence as ev
from lodestar.operators import navigator as nv
from lodestar.plans.corpus import RANKED, lang_questions, navigator_of
from lodestar.plans.registry import Registry, table
from lodestar.plans.retrieval import ASSETS, RERANK, assets_of, questions_of, reranked_of
from lodestar.plans.sql import tok, tokset

R = Registry()
NAVROW_OF = "n.topic || chr(32) || n.title || chr(32) || n.section"


def asked_of(spark: SparkSession, sf: str) -> DataFrame:
    """A question expects its first or second word, and its third, of pages around its number."""
    t = tx.tokens("question")
    rows = questions_of(spark, sf)
    source = F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))
    return rows.select("qid", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("profile"), F.array(F.slice(t, 1, 2), F.slice(t, 3, 1)).alias("expected_answer_groups"), source.alias("doc_id"), (F.col("qid") % 10 + 1).cast("int").alias("page"), F.lit(1).alias("window"), F.when(F.col("qid") % 3 > 0, F.concat(F.lit("a"), F.col("qid").cast("string"))).alias("asset_id"), F.array(source).alias("expected_doc_ids"), F.lit(True).alias("expected_citations"), F.lit(False).alias("expected_bundle_prompt"), (F.col("qid") % 7 == 6).alias("expected_abstain"))


def outcomes_of(spark: SparkSession, sf: str) -> DataFrame:
    """Answers are the last half of a question; some calls fail."""
    t = tx.tokens("question")
    ok = F.col("qid") % 7 != 6
    half = F.floor(F.size(t) / 2).cast("int")
    return questions_of(spark, sf).select("qid", ok.alias("ok"), F.when(~ok, "out_of_scope").alias("code"), F.array_join(F.slice(t, half + 1, F.size(t)), " ").alias("answer"), F.lit("").alias("prompt"), (F.col("qid") % 5).alias("n_citations"))


def evidence_of(spark: SparkSession, sf: str) -> DataFrame:
    """What hybrid retrieval and reranking give."""
    return reranked_of(spark, sf).select("qid", "rank", "chunk_id", "doc_id", "title", "section", "page_start", "page_end", "text", F.col("chunk_id").alias("citation"))


def near_of(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence chunks' nearest tables and figures."""
    e = evidence_of(spark, sf)
    near = ev.nearby_assets(e.select("chunk_id", "doc_id", "page_start", "page_end").distinct(), assets_of(spark, sf)).select("chunk_id", "asset_id", "asset_type", "caption", "text_preview")
    return e.select("qid", "rank", "chunk_id").join(near, "chunk_id").drop("chunk_id")


NORMAL = r"trim(regexp_replace(translate(lower({x}), '–—' || chr(160), '-- '), '\s+', ' ', 'g'))"
BASE = f"""{RERANK}, {ASSETS}, q AS (SELECT item_id AS qid, {tok('text')} AS t, 'src' || item_id % 20 AS doc_id, CAST(item_id % 10 + 1 AS INTEGER) AS page, CASE WHEN item_id % 3 > 0 THEN 'a' || item_id END AS asset_id FROM benchmark),
o AS (SELECT qid, qid % 7 <> 6 AS ok, array_to_string(t[len(t) // 2 + 1:], ' ') AS answer, qid % 5 AS n_citations FROM q),
e AS (SELECT qid, rank, chunk_id, doc_id, title, section, page_start, page_end, text FROM reranked),
nb AS (SELECT c.chunk_id, a.asset_id, a.caption, a.text_preview, row_number() OVER (PARTITION BY c.chunk_id ORDER BY abs(a.page - c.page_start), a.asset_id) AS r FROM (SELECT DISTINCT chunk_id, doc_id, page_start, page_end FROM e) c JOIN assets a ON a.doc_id = c.doc_id AND a.page BETWEEN c.page_start - 1 AND c.page_end + 1 QUALIFY r <= 5),
n AS (SELECT e.qid, e.rank, nb.asset_id, nb.caption, nb.text_preview FROM e JOIN nb USING (chunk_id)),
b AS (SELECT qid, string_agg(line, chr(10)) AS body, string_agg(head || line, chr(10)) AS headed_body FROM (SELECT qid, coalesce(text, '') AS line, concat_ws(chr(10), title, section, chunk_id) || chr(10) AS head FROM e UNION ALL SELECT qid, concat_ws(chr(10), caption, text_preview), '' FROM n) GROUP BY qid),
h AS (SELECT q.*, o.ok, o.n_citations, {NORMAL.format(x='o.answer')} AS ans, {NORMAL.format(x="o.answer || chr(10) || coalesce(b.body, '')")} AS hay, {NORMAL.format(x="coalesce(b.headed_body, '')")} AS evi FROM q JOIN o USING (qid) LEFT JOIN b USING (qid)),
v AS (SELECT *, (contains(ans, t[1]) OR contains(ans, t[2])) AND contains(ans, t[3]) AS answer_hit, (contains(hay, t[1]) OR contains(hay, t[2])) AND contains(hay, t[3]) AS evidence_hit, (contains(evi, t[1]) OR contains(evi, t[2])) AND contains(evi, t[3]) AS headed_hit,
 (contains(evi, t[1]) OR contains(evi, t[2]) OR contains(ans, t[1]) OR contains(ans, t[2])) AND (contains(evi, t[3]) OR contains(ans, t[3])) AS any_hit,
 EXISTS (SELECT 1 FROM e WHERE e.qid = h.qid AND e.rank <= 5 AND e.doc_id = h.doc_id) AS doc_hit, EXISTS (SELECT 1 FROM e WHERE e.qid = h.qid AND e.rank <= 5 AND e.doc_id = h.doc_id AND e.page_start <= h.page + 1 AND e.page_end >= h.page - 1) AS page_hit, asset_id IS NULL OR EXISTS (SELECT 1 FROM n WHERE n.qid = h.qid AND n.rank <= 5 AND n.asset_id = h.asset_id) AS asset_hit FROM h)"""


@R.query("ev_gold", f"WITH {BASE} SELECT qid, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS profile, answer_hit, evidence_hit, n_citations > 0 AS citation_present, evidence_hit AND n_citations > 0 AS success FROM v")
def ev_gold(spark: SparkSession, sf: str) -> DataFrame:
    return ct.gold_values(asked_of(spark, sf), outcomes_of(spark, sf), evidence_of(spark, sf), near_of(spark, sf))


@R.query("ev_gold_summary", f"WITH {BASE} SELECT CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS profile, count(*) AS n, round(avg(CAST(evidence_hit AS INTEGER)), 6) AS evidence_hit, round(avg(CAST(evidence_hit AND n_citations > 0 AS INTEGER)), 6) AS success FROM v GROUP BY ROLLUP (1)")
def ev_gold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ct.skill_summary(ev_gold(spark, sf), "profile", "evidence_hit", "success")


@R.query("ev_generation", f"WITH {BASE} SELECT qid, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS profile, answer_hit, any_hit AS all_hit, headed_hit AS evidence_hit, headed_hit AS bundle_hit, (any_hit OR headed_hit) AND NOT answer_hit AS synthesis_gap, NOT (any_hit OR headed_hit) AS retrieval_gap FROM v")
def ev_generation(spark: SparkSession, sf: str) -> DataFrame:
    return ct.generation_gaps(asked_of(spark, sf), outcomes_of(spark, sf), evidence_of(spark, sf), near_of(spark, sf))


@R.query("ev_table_cell", f"WITH {BASE} SELECT qid, evidence_hit, n_citations > 0 AS citation_present, doc_hit, page_hit, asset_hit, doc_hit AND page_hit AND asset_hit AND evidence_hit AND n_citations > 0 AS success FROM v")
def ev_table_cell(spark: SparkSession, sf: str) -> DataFrame:
    return ct.table_cells(asked_of(spark, sf), outcomes_of(spark, sf), evidence_of(spark, sf), near_of(spark, sf))


@R.query("ev_agent_tasks", f"WITH {BASE} SELECT qid, ok AS structured, doc_hit AS doc, n_citations > 0 AS citation, TRUE AS bundle, asset_hit AS asset, evidence_hit AS answer_value, CASE WHEN qid % 7 = 6 THEN NOT ok ELSE ok AND doc_hit AND n_citations > 0 AND asset_hit AND evidence_hit END AS success FROM v")
def ev_agent_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return ct.task_contracts(asked_of(spark, sf), outcomes_of(spark, sf), evidence_of(spark, sf), near_of(spark, sf))


NAV_DOCS = f"""{RANKED}, g AS (SELECT item_id AS qid, 'src' || item_id % 20 AS gold FROM benchmark), h AS (SELECT g.qid, min(r.rank) AS t FROM g JOIN ranked r ON r.qid = g.qid JOIN (SELECT DISTINCT topic, doc_id FROM nav) n ON n.topic = r.topic AND n.doc_id = g.gold GROUP BY g.qid),
sd AS (SELECT a.qid, n.doc_id, round(sum(len(list_intersect({tokset('a.question')}, {tokset(NAVROW_OF)})) / greatest(len({tokset('a.question')}), 1)), 6) AS score FROM asked a JOIN ranked r ON r.qid = a.qid AND r.rank <= 2 JOIN nav n ON n.topic = r.topic GROUP BY ALL),
rd AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sd QUALIFY rank <= 5), d AS (SELECT g.qid, min(rd.rank) AS d FROM g JOIN rd ON rd.qid = g.qid AND rd.doc_id = g.gold GROUP BY g.qid)"""


@R.query("ev_navigator", f"WITH {NAV_DOCS} SELECT g.qid, " + ", ".join([*(f"coalesce(t <= {k}, FALSE) AS topic_hit_at_{k}" for k in (1, 2, 3)), *(f"coalesce(d <= {k}, FALSE) AS doc_hit_at_{k}" for k in (1, 3, 5))]) + " FROM g LEFT JOIN h USING (qid) LEFT JOIN d USING (qid)")
def ev_navigator(spark: SparkSession, sf: str) -> DataFrame:
    nav, asked = navigator_of(spark, sf), lang_questions(spark, sf)
    topics = nv.rank_topics(asked, nav)
    docs = nv.rank_documents(asked, nav, topics.where("rank <= 2"))
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc_id"))
    return ct.navigator_metrics(topics, docs, nav.select("topic", "doc_id").distinct(), gold)
