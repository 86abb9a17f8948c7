"""Queries for whole evaluations: retrieval with abstention, ablation, selectors, exams, assets, intervals, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.functions.predicates import chunk_bonus, rerank_adjustment
from lodestar.operators import answers as an
from lodestar.operators import evidence as ev
from lodestar.operators import experiments as ex
from lodestar.operators import generators as gn
from lodestar.operators import ingest as ig
from lodestar.operators import navigator as nv
from lodestar.operators import retrieve as rt
from lodestar.operators import routing
from lodestar.plans.contracts import BASE, evidence_of, near_of
from lodestar.plans.corpus import NAV, navigator_of
from lodestar.plans.evaluation import GOLD, WILSON, gold_of
from lodestar.plans.registry import Registry, firms, people, table
from lodestar.plans.retrieval import HAY, LEXICAL, RERANK, TERMS, chunks_of, hit_chunks, hybrid_of, questions_of, reranked_of, sparse_of
from lodestar.plans.sql import CHUNKS, HYBRID, tok, tokset
from lodestar.plans.textual import ASKED, KEYS, SCENE, TABLE
from lodestar.sources.shared import fresh_folder, saved

R = Registry()


def expected_of(spark: SparkSession, sf: str) -> DataFrame:
    """A question expects a source by its number; every seventh ought to be refused."""
    return questions_of(spark, sf).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("expected_doc_id"), (F.col("qid") % 7 == 6).alias("expected_abstain"))


def loop_details_of(spark: SparkSession, sf: str) -> DataFrame:
    found = reranked_of(spark, sf)
    return ex.retrieval_details(expected_of(spark, sf), found, ev.sufficiency(questions_of(spark, sf), found), gold_of(spark, sf))


def _details(runs: str, by: str = "") -> str:
    """SQL of retrieval_details over a CTE of runs with qid, chunk_id, doc_id, rank and o (the share of content terms)."""
    key, using = (f"{by}, " if by else ""), f"({by + ', ' if by else ''}qid)"
    every = f"(SELECT DISTINCT {by} FROM {runs}) v CROSS JOIN " if by else ""
    return f"""qx AS (SELECT {key}item_id AS qid, 'src' || item_id % 20 AS want, item_id % 7 = 6 AS refuse FROM {every}benchmark),
firsts AS (SELECT {key}qid, min(CASE WHEN g.qid IS NOT NULL THEN r.rank END) AS g, min(CASE WHEN r.doc_id = 'src' || r.qid % 20 THEN r.rank END) AS d, max(o) AS o, bool_or(bare) AS bare FROM {runs} r LEFT JOIN gold g USING (qid, chunk_id) GROUP BY ALL),
details AS (SELECT {key}qid, NOT refuse AS in_scope, CAST(coalesce(g <= 3, FALSE) AS INTEGER) AS hit_at_3, CAST(coalesce(g <= 5, FALSE) AS INTEGER) AS hit_at_5, coalesce(round(1 / g, 6), 0.0) AS rr,
 CASE WHEN NOT refuse THEN CAST(coalesce(d <= 3, FALSE) AS INTEGER) END AS doc_hit_at_3, CASE WHEN NOT refuse THEN CAST(coalesce(d <= 5, FALSE) AS INTEGER) END AS doc_hit_at_5, NOT coalesce(bare OR o >= 0.3, FALSE) AS abstained FROM qx LEFT JOIN firsts USING {using})"""


MEANS = ", ".join(f"coalesce(round(avg({c}), 6), 0.0) AS {c}" for c in ("hit_at_3", "hit_at_5", "rr", "doc_hit_at_3", "doc_hit_at_5"))
CONFUSED = "count_if(abstained AND NOT in_scope) AS tp, count_if(abstained AND in_scope) AS fp, count_if(NOT abstained AND in_scope) AS tn, count_if(NOT abstained AND NOT in_scope) AS fn"
OVERLAP = f"len(list_intersect({TERMS}, {tokset(HAY)})) / greatest(len({TERMS}), 1) AS o, len({TERMS}) = 0 AS bare"
LOOP = f"{RERANK}, {GOLD}, runs AS (SELECT qid, chunk_id, doc_id, rank, {OVERLAP} FROM reranked), {_details('runs')}"


@R.query("ev_retrieval_loop", f"WITH {LOOP} SELECT count(*) AS n, {MEANS}, {CONFUSED} FROM details")
def ev_retrieval_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk and document hits and the confusion of abstentions, in one summary."""
    return ex.retrieval_summary(loop_details_of(spark, sf))


@R.query("hp_outcomes", f"WITH {LOOP} SELECT qid, CASE WHEN in_scope THEN 'document' ELSE 'refusal' END AS kind, CASE WHEN in_scope THEN doc_hit_at_5 ELSE CAST(abstained AS INTEGER) END AS outcome FROM details")
def hp_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return ex.outcomes(loop_details_of(spark, sf))


INTERVAL = f"round({WILSON.format(f='greatest', e=0.0, s='-')}, 6) AS low, round({WILSON.format(f='least', e=1.0, s='+')}, 6) AS high"


@R.query("st_uncertainty", f"WITH {LOOP}, x AS (SELECT CASE WHEN in_scope THEN 'document_hit' ELSE 'refusal' END AS metric, CASE WHEN in_scope THEN doc_hit_at_5 ELSE CAST(abstained AS INTEGER) END AS v FROM details UNION ALL SELECT 'chunk_hit', hit_at_5 FROM details UNION ALL SELECT 'quality', quality FROM labels), b AS (SELECT metric, count_if(v = 1) AS successes, count(*) AS total FROM x GROUP BY metric) SELECT metric, total, successes, round(successes / total, 6) AS rate, {INTERVAL} FROM b")
def st_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    """Wilson intervals of an evaluation's rates; the bootstrap rows of the assembly are tested on their own."""
    details = loop_details_of(spark, sf)
    outcome = ex.outcomes(details)
    return ex.uncertainty({"document_hit": (outcome.where("kind = 'document'"), "outcome"), "refusal": (outcome.where("kind = 'refusal'"), "outcome"), "chunk_hit": (details, "hit_at_5"), "quality": (table(spark, sf, "labels"), "quality")})


# --- ablation -------------------------------------------------------------------


def ablation_candidates_of(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """Both backends share one search, which is saved in a folder with their hits."""
    asked = questions_of(spark, sf)
    n = asked.count()
    sparse = saved(sparse_of(spark, sf), folder, "sparse")
    lists = {"sparse": rt.sparse_only(sparse), "hybrid": hybrid_of(spark, sf, sparse)}
    both = [df.select("qid", "chunk_id", "final_retrieval_score", "retrieval_rank", F.lit(kind).alias("backend")) for kind, df in lists.items()]
    hits, most = saved(both[0].unionByName(both[1]), folder, "hits"), 2 * n * rt.FUSED_K
    return hit_chunks(spark, sf, hits, most).join(rt.sized(hits, most), "chunk_id").join(rt.sized(asked, n), "qid")


PLAN = "(VALUES " + ", ".join(f"('{name}', '{backend}', {str(model).upper()})" for name, (backend, model, _) in ex.VARIANTS.items()) + ") AS plan(variant, backend, by_model)"
BENCH_SCENE = SCENE.replace(ASKED, "(SELECT item_id AS qid, text AS question, CAST(NULL AS VARCHAR) AS report_id FROM benchmark)")
RATIO = f"CASE WHEN len({KEYS.format(x='b.text')}) = 0 OR len({KEYS.format(x='c.text')}) = 0 THEN 0.0 ELSE len(list_intersect({KEYS.format(x='b.text')}, {KEYS.format(x='c.text')})) / len({KEYS.format(x='b.text')}) END"
ABLATION = f"""{HYBRID}, {GOLD}, {BENCH_SCENE},
lists AS (SELECT 'sparse' AS kind, qid, chunk_id, corpus_pos, round(1.0 / (60 + rank), 8) AS prior, row_number() OVER (PARTITION BY qid ORDER BY round(1.0 / (60 + rank), 8) DESC, corpus_pos) AS place FROM sparse QUALIFY place <= 20 UNION ALL SELECT 'hybrid', qid, chunk_id, corpus_pos, fusion_score, retrieval_rank FROM hybrid),
chosen AS (SELECT qid, t.backend AS kind FROM task JOIN (SELECT * FROM {TABLE}) t ON t.key = CASE WHEN task IN ('comparison', 'multi_report_synthesis') THEN 'synthesis_dense' ELSE task END),
cand AS (SELECT plan.variant, plan.by_model, l.qid, l.chunk_id, l.corpus_pos, l.prior, l.place, c.doc_id, c.title, c.section, c.subsection, c.text, b.text AS question, {LEXICAL} AS lexical, {RATIO} AS modelled
 FROM lists l JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = l.qid JOIN chosen ON chosen.qid = l.qid JOIN {PLAN} ON plan.backend = l.kind OR (plan.backend = 'routed' AND chosen.kind = l.kind)),
raws AS (SELECT *, CASE WHEN by_model THEN modelled ELSE lexical END AS raw FROM cand),
scaled AS (SELECT *, CASE WHEN max(raw) OVER w - min(raw) OVER w < 1e-8 THEN 0.5 ELSE (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) END AS m, CASE WHEN max(prior) OVER w - min(prior) OVER w < 1e-8 THEN 0.5 ELSE (prior - min(prior) OVER w) / (max(prior) OVER w - min(prior) OVER w) END AS p FROM raws WINDOW w AS (PARTITION BY variant, qid)),
runs AS (SELECT variant, qid, chunk_id, doc_id, {OVERLAP}, row_number() OVER (PARTITION BY variant, qid ORDER BY round(0.65 * m + 0.35 * p, 6) DESC, place, corpus_pos) AS rank FROM scaled QUALIFY rank <= 6), {_details('runs', 'variant')}"""


@R.query("ev_ablation", f"WITH {ABLATION} SELECT variant, count(*) AS n, {MEANS}, {CONFUSED} FROM details GROUP BY variant")
def ev_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """All six variants in one plan; shared keywords stand in for a neural model, and no benchmark text meets a report rule."""
    routes = routing.select_strategy(routing.with_scene(questions_of(spark, sf)), True)
    folder = fresh_folder(spark, "ablation")
    candidates = saved(ablation_candidates_of(spark, sf, folder), folder, "candidates")
    found = ex.ablation_evidence(candidates, routes, tx.keyword_ratio(F.col("question"), F.col("text")), chunk_bonus(F.col("question")), rerank_adjustment(F.col("question")))
    found = saved(found, folder, "evidence")
    each = F.explode(F.array(*map(F.lit, ex.VARIANTS))).alias("variant")
    key = F.struct("variant", "qid").alias("qid")
    questions = questions_of(spark, sf).select("*", each)
    enough = ev.sufficiency(questions.select(key, "question"), found.withColumn("qid", key)).select("qid.variant", "qid.qid", "sufficient")
    details = ex.retrieval_details(expected_of(spark, sf).select("*", each), found, enough, gold_of(spark, sf), ["variant"])
    return ex.retrieval_summary(details, ["variant"])


# --- answers, exams, assets -------------------------------------------------------


def told_of(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    t = tx.tokens("question")
    asked = questions_of(spark, sf).select("qid", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("profile"), F.array(F.slice(t, 1, 2), F.slice(t, 3, 1)).alias("expected_answer_groups"))
    found = reranked_of(spark, sf)
    return asked, {name: an.extractive_answers(found, name) for name in ("lexical", "semantic_coverage")}


@R.query("ev_selectors")
def ev_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """Two selectors on the same evidence (rows only: the answers are folds, which tests hold against loops)."""
    return ex.selector_details(*told_of(spark, sf))


@R.query("ev_selectors_paired")
def ev_selectors_paired(spark: SparkSession, sf: str) -> DataFrame:
    details = ex.selector_details(*told_of(spark, sf))
    return ex.paired(details, "selector", "answer_hit", "lexical", "semantic_coverage")


OPTIONS = f"""opts AS (SELECT item_id AS qid, text AS question, unnest(['A', 'B', 'C', 'D']) AS label, unnest([{tok('text')}[1], {tok('text')}[-1] || ' ' || {tok('text')}[5], 'absent', {tok('text')}[7] || ' elsewhere']) AS option FROM benchmark),
pairs AS (SELECT o.qid, o.label, coalesce(max(len(list_intersect({tokset("o.question || ' ' || o.option")}, {tokset("r.title || chr(10) || coalesce(r.section, '') || chr(10) || coalesce(r.text, '')")})) / greatest(len({tokset("o.question || ' ' || o.option")}), 1)), 0.0) AS s FROM opts o LEFT JOIN reranked r USING (qid) GROUP BY ALL),
best AS (SELECT qid, arg_min(label, struct_pack(a := -round(s, 6), b := label)) AS chosen FROM pairs GROUP BY qid)"""


@R.query("ev_mcq", f"WITH {RERANK}, {OPTIONS}, h AS (SELECT qid, string_agg(title || chr(10) || coalesce(text, ''), chr(10)) AS hay FROM reranked GROUP BY qid) SELECT o.qid, chosen, chosen = 'B' AS correct, coalesce(contains(trim(regexp_replace(translate(lower(h.hay), '–—' || chr(160), '-- '), '\\s+', ' ', 'g')), o.option), FALSE) AS evidence_has_gold, h.qid IS NOT NULL AS citation_present FROM opts o JOIN best USING (qid) LEFT JOIN h USING (qid) WHERE o.label = 'B'")
def ev_mcq(spark: SparkSession, sf: str) -> DataFrame:
    """Four options a benchmark item, of which B is gold."""
    t = tx.tokens("question")
    at = lambda i: F.get(t, F.lit(i))
    made = F.array(*(F.struct(F.lit(x).alias("label"), o.alias("option")) for x, o in (("A", at(0)), ("B", F.concat(F.element_at(t, -1), F.lit(" "), at(4))), ("C", F.lit("absent")), ("D", F.concat(at(6), F.lit(" elsewhere"))))))
    options = questions_of(spark, sf).select("qid", "question", F.explode(made).alias("o")).select("qid", "question", "o.label", "o.option")
    gold = questions_of(spark, sf).select("qid", F.lit("B").alias("gold_label"))
    return ex.exam(options, gold, evidence_of(spark, sf).withColumn("subsection", F.lit("UNKNOWN"))).drop("option_scores")


@R.query("ev_asset", f"WITH {BASE}, k AS (SELECT qid, bool_or(a.asset_type = CASE WHEN qid % 3 = 0 THEN 'image' ELSE 'table' END) AS kind, bool_or(n.asset_id = 'a' || qid) AS same FROM n JOIN assets a ON a.asset_id = n.asset_id WHERE n.rank <= 5 GROUP BY qid) SELECT v.qid, doc_hit, page_hit, coalesce(same, FALSE) AS asset_hit, coalesce(kind, FALSE) AS type_hit FROM v LEFT JOIN k USING (qid)")
def ev_asset(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("qid")
    asked = questions_of(spark, sf).select("qid", F.concat(F.lit("src"), (n % 20).cast("string")).alias("doc_id"), (n % 10 + 1).cast("int").alias("page"), F.lit(1).alias("window"), F.concat(F.lit("a"), n.cast("string")).alias("asset_id"), F.when(n % 3 == 0, "image").otherwise("table").alias("asset_type"))
    return ex.asset_details(asked, evidence_of(spark, sf), near_of(spark, sf))


# --- comparisons, manifests, generators ------------------------------------------------


@R.query("ev_compare_parsers", "SELECT 'artifact' AS kind, name, CAST(old AS DOUBLE) AS old, CAST(new AS DOUBLE) AS new, CAST(new - old AS DOUBLE) AS delta FROM (SELECT 'chunks' AS name, (SELECT count(*) FROM documents) AS old, (SELECT count(*) FROM documents WHERE text <> '') AS new UNION ALL SELECT 'pages', (SELECT count(*) FROM pages), 0 UNION ALL SELECT 'labels', 0, (SELECT count(*) FROM labels)) UNION ALL SELECT 'metric', name, old, new, round(new - old, 6) FROM (SELECT 'quality' AS name, (SELECT round(avg(quality), 6) FROM labels WHERE doc_id % 2 = 0) AS old, (SELECT round(avg(quality), 6) FROM labels) AS new UNION ALL SELECT 'toxic', NULL, (SELECT round(avg(toxic), 6) FROM labels))")
def ev_compare_parsers(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of two builds and their metrics, one of which only the new one has."""
    t = {n: table(spark, sf, n) for n in ("documents", "pages", "labels")}
    old = ex.snapshot({"chunks": t["documents"], "pages": t["pages"]})
    new = ex.snapshot({"chunks": t["documents"].where("text <> ''"), "labels": t["labels"]})
    mean = lambda df, c: df.agg(F.round(F.avg(c), 6).alias("value")).select(F.lit(c).alias("name"), "value")
    return ex.compare_runs(old, new, mean(t["labels"].where("doc_id % 2 = 0"), "quality"), mean(t["labels"], "quality").unionByName(mean(t["labels"], "toxic")))


@R.query("ev_outcome_changes", "WITH c AS (SELECT CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN toxic = 1 THEN 'improved' WHEN quality = 1 THEN 'regressed' ELSE 'neither' END AS outcome FROM labels) SELECT o AS outcome, count(c.outcome) AS n FROM (SELECT unnest(['improved', 'regressed', 'both', 'neither']) AS o) LEFT JOIN c ON c.outcome = o GROUP BY o")
def ev_outcome_changes(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "qid")
    return ex.outcome_changes(labels.select("qid", (F.col("quality") == 1).alias("correct")), labels.select("qid", (F.col("toxic") == 1).alias("correct")))


@R.query("hp_parse_response", """WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS label FROM labels) SELECT doc_id, label AS selected_label, CASE doc_id % 6 WHEN 2 THEN 'invalid label' WHEN 3 THEN 'not JSON' WHEN 4 THEN 'violates the schema' WHEN 5 THEN 'invalid citations' END AS problem FROM r""")
def hp_parse_response(spark: SparkSession, sf: str) -> DataFrame:
    """Host answers made from labels, most of them faulty in a way of their own."""
    n = F.col("doc_id") % 6
    fine = lambda label: f'{{"selected_label": "{label}", "citations": ["E1", "E2"]}}'
    said = F.when(n == 0, fine("A")).when(n == 1, f"  {fine('B')} ").when(n == 2, fine("C")).when(n == 3, "the answer is A").when(n == 4, '{"selected_label": "A"}').otherwise('{"selected_label": "A", "citations": [1]}')
    return table(spark, sf, "labels").select("doc_id", an.parse_response(said, F.array(F.lit("A"), F.lit("B"))).alias("r")).select("doc_id", "r.selected_label", "r.problem")


@R.query("jn_manifest_nav", f"WITH {NAV}, m AS (SELECT source AS doc_id, arg_max(lang, doc_id) FILTER (WHERE TRUE) AS organization, arg_max(struct_pack(o := lang), doc_id) AS last FROM documents WHERE source <> 'src7' GROUP BY source) SELECT n.chunk_id, n.topic, m.last.o AS organization FROM nav n LEFT JOIN m ON m.doc_id = n.doc_id")
def jn_manifest_nav(spark: SparkSession, sf: str) -> DataFrame:
    """Navigator rows with what the last manifest record of their document says; one document has none."""
    manifest = table(spark, sf, "documents").where("source <> 'src7'").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("pos"), F.col("lang").alias("organization"), F.lit(None).cast("string").alias("source_url"))
    return nv.enriched(navigator_of(spark, sf), manifest).select("chunk_id", "topic", "organization")


@R.query("hp_export_build", f"WITH {CHUNKS} SELECT doc_id, min(title) AS title, doc_id || '.md' AS file, count(*) AS n_chunks FROM chunks GROUP BY doc_id")
def hp_export_build(spark: SparkSession, sf: str) -> DataFrame:
    return ig.export_manifest(chunks_of(spark, sf))


@R.query("hp_inspect_all", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents), p AS (SELECT doc_id, o // 10 + 1 AS page, sum(length(t)) AS chars FROM l WHERE t <> '' GROUP BY ALL), d AS (SELECT doc_id, avg(chars) AS a, count_if(chars < 80) * 2 >= count(*) AS low FROM (SELECT f.doc_id, f.page, coalesce(p.chars, 0) AS chars FROM (SELECT doc_id, unnest(range(1, max(page) + 1)) AS page FROM p GROUP BY doc_id) f LEFT JOIN p USING (doc_id, page)) GROUP BY doc_id) SELECT count(*) AS n_files, count_if(a < 80 OR low) AS n_scan_likely, TRUE AS ok FROM d")
def hp_inspect_all(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.plans.corpus import blocks_of

    blocks = blocks_of(spark, sf).withColumnRenamed("page_start", "page")
    density = ig.text_density(blocks.select("doc_id", "page", "text"), blocks.groupBy("doc_id").agg(F.max("page").alias("n_pages")))
    return ig.inspection_summary(density)


@R.query("gn_gold", "SELECT 'gold_q' || printf('%04d', row_number() OVER (ORDER BY side, pos)) AS qid, question, profile, doc FROM (SELECT 0 AS side, r_regionkey AS pos, 'What about ' || r_name || '?' AS question, 'external' AS profile, NULL AS doc FROM (SELECT s_suppkey AS r_regionkey, s_name AS r_name FROM supplier) UNION ALL SELECT 1, n_nationkey, 'What does ' || n_name || ' say?', 'report', n_name FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer))")
def gn_gold(spark: SparkSession, sf: str) -> DataFrame:
    groups = F.array(F.array(F.lit("x")))
    external = firms(spark, sf).select(F.col("r_regionkey").alias("pos"), F.concat(F.lit("What about "), "r_name", F.lit("?")).alias("question"), groups.alias("groups"))
    nation = people(spark, sf)
    targets = nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("doc_id"), F.concat(F.lit("What does "), "n_name", F.lit(" say?")).alias("question"), groups.alias("groups"))
    catalog = nation.select(F.col("n_name").alias("doc_id"), F.concat(F.lit("http://"), "n_name").alias("source_url"))
    out = gn.gold_targets(external, targets, catalog)
    return out.select("qid", "question", "profile", F.get("expected_doc_ids", F.lit(0)).alias("doc"))


@R.query("gn_tasks", "SELECT 'agent_task_q' || printf('%04d', row_number() OVER (ORDER BY side, pos)) AS qid, question, mode, n_docs, side = 1 AS expected_abstain FROM (SELECT 0 AS side, n_nationkey AS pos, 'Report on ' || n_name AS question, ['evidence', 'bundle', 'answer'][1 + n_nationkey % 3] AS mode, 1 AS n_docs FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name FROM customer) UNION ALL SELECT 1, r_regionkey, 'Tell me about ' || r_name, 'answer', 0 FROM (SELECT s_suppkey AS r_regionkey, s_name AS r_name FROM supplier))")
def gn_tasks(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.element_at(F.array(F.lit("evidence"), F.lit("bundle"), F.lit("answer")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    inside = people(spark, sf).select(F.col("n_nationkey").alias("pos"), F.lit("lookup").alias("task"), mode.alias("mode"), F.concat(F.lit("Report on "), "n_name").alias("question"), F.array("n_name").alias("expected_doc_ids"))
    outside = firms(spark, sf).select(F.col("r_regionkey").alias("pos"), F.lit("control").alias("task"), F.lit("answer").alias("mode"), F.concat(F.lit("Tell me about "), "r_name").alias("question"))
    return gn.agent_tasks(inside, outside).select("qid", "question", "mode", F.size("expected_doc_ids").alias("n_docs"), "expected_abstain")
