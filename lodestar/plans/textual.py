"""Queries for text functions, predicates and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import predicates as pr
from lodestar.functions import rules
from lodestar.functions import text as tx
from lodestar.operators import routing
from lodestar.plans.registry import Registry, table
from lodestar.plans.sql import BM25, CHUNKS, NORM, any_match, lit, tok, tokset, values
from lodestar.sources import adapters

R = Registry()

#: questions that exercise the rule packs: qid, question, report_id
QUESTIONS = [
    (1, "What is nontarget dose according to TG-158?", None),
    (2, "Define output factor", None),
    (3, "Which section covers small field dosimetry in TRS 483?", None),
    (4, "Compare AAPM TG 100, TG-142, IAEA TRS 398, and TECDOC1540.", None),
    (5, "How should a linac QA program be set up across several sites?", None),
    (6, "What does Table II on page 14 of Report 083 list?", "report_83"),
    (7, "Should my mother choose SBRT or surgery for this patient?", None),
    (8, "Best sourdough bread recipe", None),
    (9, "Calculate the monitor unit for a small field", None),
    (10, "List the tests for CBCT image registration", None),
    (11, "The displayed image on page 9", None),
    (12, "", None),
    (13, "image-guided radiotherapy and FMEA audit of IMRT planning", "tg_100"),
    (14, "difference between HDR and LDR", None),
    (15, "What are the recommended tolerance levels for monthly output constancy checks of a linear accelerator when the machine is used for stereotactic treatments?", None),
]
#: these, then every user turn after one of them, its other characters than printable ASCII blanked
ASKED = f"(WITH v AS (SELECT * FROM {values(QUESTIONS, 'qid', 'question', 'report_id')}) SELECT * FROM v UNION ALL SELECT 1000 + conv_id * 1000 + turn, question || ' ' || regexp_replace(text, '[^ -~]+', ' ', 'g'), report_id FROM conversations JOIN v ON qid = (conv_id + turn) % {len(QUESTIONS)} + 1 WHERE role = 'user') AS asked"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame(QUESTIONS, "qid long, question string, report_id string")
    turns = table(spark, sf, "conversations").where("role = 'user'").withColumn("qid", (F.col("conv_id") + F.col("turn")) % len(QUESTIONS) + 1).join(F.broadcast(fixed), "qid")
    said = F.concat("question", F.lit(" "), F.regexp_replace("text", "[^ -~]+", " "))
    return fixed.unionByName(turns.select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), said.alias("question"), "report_id"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@R.query("fn_tokenize", f"SELECT doc_id, CAST(len({tok('text')}) AS BIGINT) AS n, CAST(len({tokset('text')}) AS BIGINT) AS n_distinct, md5(array_to_string({tok('text')}, ' ')) AS digest FROM documents")
def fn_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.tokens("text")
    return documents(spark, sf).select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@R.query("fn_token_count", f"SELECT source, CAST(sum(len({tok('text')})) AS BIGINT) AS tokens, round(avg(len({tok('text')})), 6) AS mean, max(len({tok('text')})) AS most FROM documents GROUP BY source")
def fn_token_count(spark: SparkSession, sf: str) -> DataFrame:
    n = tx.token_count("text")
    return documents(spark, sf).groupBy("source").agg(F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean"), F.max(n).cast("long").alias("most"))


@R.query("fn_normalize_ws", f"SELECT doc_id, md5({NORM.format(x='text')}) AS digest FROM documents")
def fn_normalize_ws(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.md5(tx.normalize_ws("text").cast("binary")).alias("digest"))


MARKED = r"""regexp_replace({x}, '([.!?])\s+([A-Z0-9"“(])', '\1' || chr(1) || '\2', 'g')"""


@R.query("fn_sentences", f"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split({MARKED.format(x=NORM.format(x='text'))}, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, '|')) AS digest FROM s")
def fn_sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = tx.sentences("text")
    return documents(spark, sf).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|").cast("binary")).alias("digest"))


SLUG = "regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '{m}', 'g'), '^{m}+|{m}+$', '', 'g')"


@R.query("fn_slugs", f"SELECT page_id, {SLUG.format(m='_')} AS slug, {SLUG.format(m='-')} AS dashed, lower(array_to_string(regexp_extract_all(url, '[A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*')[1:3], ' ')) AS words FROM pages")
def fn_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.slug("url").alias("slug"), tx.slug("url", "-", "item").alias("dashed"), tx.slug_words("url", 3).alias("words"))


@R.query("fn_composed_texts", f"WITH {CHUNKS} SELECT chunk_id, md5(title || ' ' || section || ' ' || text) AS indexed, md5('title: ' || title || chr(10) || title || chr(10) || section || chr(10) || text) AS embedded, md5(title || chr(10) || section || chr(10) || text) AS reranked, CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END AS pages FROM chunks WHERE text <> ''")
def fn_composed_texts(spark: SparkSession, sf: str) -> DataFrame:
    digest = lambda c: F.md5(c.cast("binary"))
    chunks = adapters.document_chunks(documents(spark, sf)).where("text <> ''")
    return chunks.select("chunk_id", digest(tx.index_text()).alias("indexed"), digest(tx.embed_text("title: {title}\n")).alias("embedded"), digest(tx.rerank_text()).alias("reranked"), tx.page_range("page_start", "page_end").alias("pages"))


SETS = f"s AS (SELECT doc_id, text, {tokset('text')} AS t FROM documents), p AS (SELECT a.doc_id, a.t AS x, b.t AS y, len(list_intersect(a.t, b.t)) AS both_ FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)"


@R.query("fn_set_similarity", f"WITH {SETS} SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE both_ / (len(x) + len(y) - both_) END, 6) AS jaccard, round(CASE WHEN least(len(x), len(y)) = 0 THEN 0.0 ELSE both_ / least(len(x), len(y)) END, 6) AS overlap_min, round(both_ / greatest(len(x), 1), 6) AS share FROM p")
def fn_set_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the next one."""
    s = documents(spark, sf).select("doc_id", tx.token_set("text").alias("x"))
    pairs = s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y")), "doc_id")
    x, y = F.col("x"), F.col("y")
    return pairs.select("doc_id", F.round(tx.jaccard(x, y), 6).alias("jaccard"), F.round(tx.overlap_min(x, y), 6).alias("overlap_min"), F.round(tx.share_of(x, y), 6).alias("share"))


KEYS = "list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z]{{3,}}'))"


EACH = "SELECT d.doc_id, d.text AS d, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"


def each_with_item(spark: SparkSession, sf: str) -> DataFrame:
    """Every document (doc_id, d) with the benchmark item (item_id, text) whose number is its own modulo theirs."""
    items, docs = table(spark, sf, "benchmark"), documents(spark, sf).select("doc_id", F.col("text").alias("d"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    return docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).drop("n").join(items, "item_id")


@R.query("fn_keyword_ratio", f"WITH k AS (SELECT doc_id, {KEYS.format(x='text')} AS q, {KEYS.format(x='d')} AS t FROM ({EACH})) SELECT doc_id, round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0.0 ELSE len(list_intersect(q, t)) / len(q) END, 6) AS ratio FROM k")
def fn_keyword_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return each_with_item(spark, sf).select("doc_id", F.round(tx.keyword_ratio(F.col("text"), F.col("d")), 6).alias("ratio"))


STOP = "[" + ", ".join(map(lit, rules.QUERY_STOPWORDS)) + "]"
TITLE_STOP = "[" + ", ".join(map(lit, rules.TITLE_STOPWORDS)) + "]"
CONTENT = f"list_filter({tok('text')}, lambda t: NOT list_contains({STOP}, t) AND NOT regexp_matches(t, '^[0-9]+$') AND length(t) >= 3)"


@R.query("fn_query_terms", f"SELECT item_id, array_to_string({CONTENT}, ' ') AS terms, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9]{{2,}}')), lambda t: NOT list_contains({TITLE_STOP}, t))), ' ') AS title_terms FROM benchmark")
def fn_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(tx.query_terms("text"), " ").alias("terms"), F.array_join(F.array_sort(tx.title_terms("text")), " ").alias("title_terms"))


PLAIN = NORM.format(x="translate(question, '_-', '  ')")
CUES = "list_sort(list_distinct(flatten([" + ", ".join(f"list_transform(regexp_extract_all(lower({PLAIN}), {lit(p)}, 1), lambda n: '{k}:' || CASE WHEN ltrim(n, '0') = '' THEN '0' ELSE ltrim(n, '0') END)" for k, p in rules.REPORT_CUES.items()) + "])))"


@R.query("fn_report_cues", f"SELECT qid, array_to_string({CUES}, ' ') AS cues FROM {ASKED}")
def fn_report_cues(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("qid", F.array_join(tx.report_cues("question"), " ").alias("cues"))


NORMQ = NORM.format(x="question")


@R.query("fn_query_focus", f"SELECT qid, lower(trim(coalesce(nullif(regexp_extract({NORMQ}, '(?i)^what is\\s+(.+?)(?:\\s+according to.*)?\\??$', 1), ''), nullif(regexp_extract({NORMQ}, '(?i)^define\\s+(.+?)\\??$', 1), '')))) AS focus, TRY_CAST(nullif(regexp_extract(question, '(?i)\\bpage\\s+(\\d{{1,4}})\\b', 1), '') AS INTEGER) AS page FROM {ASKED}")
def fn_query_focus(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("qid", tx.query_focus("question").alias("focus"), tx.requested_page("question").alias("page"))


NUMBERS = r"list_distinct(regexp_extract_all(regexp_replace({x}, '\[E\d+\]', ' ', 'g'), '\b\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?%?\b'))"


@R.query("fn_extract_numbers", f"SELECT doc_id, array_to_string(list_sort({NUMBERS.format(x='text')}), ' ') AS numbers FROM documents")
def fn_extract_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.array_join(F.array_sort(tx.extract_numbers("text")), " ").alias("numbers"))


@R.query("fn_casts", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.page') AS INTEGER) IS NULL AS no_page, round(value, 4) AS value FROM events")
def fn_casts(spark: SparkSession, sf: str) -> DataFrame:
    v = tx.json_object("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.page", "int").isNull().alias("no_page"), F.round(tx.safe_float(F.col("value").cast("string")), 4).alias("value"))


EVALN = r"trim(regexp_replace(translate(lower({x}), '–—' || chr(160), '-- '), '\s+', ' ', 'g'))"


@R.query("fn_group_hit", f"WITH g AS (SELECT doc_id, {EVALN.format(x='d')} AS hay, {tok('text')} AS t FROM ({EACH})) SELECT doc_id, (contains(hay, t[1]) OR contains(hay, t[2])) AND contains(hay, t[3]) AS hit, contains(hay, t[1]) AS option_hit FROM g")
def fn_group_hit(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.tokens("text")
    rows = each_with_item(spark, sf).withColumn("groups", F.array(F.slice(t, 1, 2), F.slice(t, 3, 1))).withColumn("option", F.get(t, F.lit(0)))
    return rows.select("doc_id", tx.group_hit(F.col("d"), F.col("groups")).alias("hit"), tx.option_in_text(F.col("option"), F.col("d")).alias("option_hit"))


@R.query("fn_phrase", "SELECT item_id, lower(left(p, 1)) || substr(p, 2) AS phrase FROM (SELECT item_id, rtrim(trim(regexp_replace(text, '\\s+', ' ', 'g')), '.') AS p FROM benchmark)")
def fn_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", tx.phrase("text").alias("phrase"))


KIND = "CASE " + " ".join(f"WHEN {any_match(NORMQ, p)} THEN '{k}'" for k, p in rules.QUERY_TYPES.items()) + " ELSE 'general' END"


@R.query("cls_query_type", f"SELECT qid, {KIND} AS kind, regexp_matches(question, {lit(rules.ASSET_QUERY)}) AS asset FROM {ASKED}")
def cls_query_type(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("qid", pr.query_type(F.col("question")).alias("kind"), pr.asset_query(F.col("question")).alias("asset"))


def _holds(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


TAGS = "list_filter([" + ", ".join(f"CASE WHEN {_holds('lower(question)', t)} THEN '{k}' END" for k, t in rules.DOMAIN_TERMS.items()) + "], lambda x: x IS NOT NULL)"
FOUND = "list_filter([" + ", ".join(f"CASE WHEN {any_match('question', [p])} THEN '{k}' END" for k, p in rules.QUESTION_PATTERNS.items()) + "], lambda x: x IS NOT NULL)"
LENGTH = r"len(list_filter(string_split_regex(trim(question), '\s+'), lambda w: w <> ''))"
SCENE = f"""base AS (SELECT qid, question, report_id, {TAGS} AS tags, {FOUND} AS found, {LENGTH} AS n, {any_match('question', rules.BOUNDARIES)} AS boundary, {_holds('lower(question)', rules.OUT_OF_DOMAIN)} AS foreign_ FROM {ASKED}),
task AS (SELECT *, CASE WHEN boundary OR (foreign_ AND len(tags) = 0) THEN 'out_of_scope' WHEN list_contains(found, 'table_or_figure') THEN 'asset_lookup' WHEN list_contains(found, 'calculation') THEN 'calculation_or_formula'
 WHEN list_contains(found, 'definition') THEN 'definition' WHEN list_contains(found, 'comparison') THEN 'comparison' WHEN list_contains(found, 'procedure') THEN 'procedure_or_qa'
 WHEN len(tags) >= 2 OR regexp_matches(lower(question), {lit(rules.BROAD)}) THEN 'multi_report_synthesis' ELSE 'direct_fact' END AS task FROM base)"""


@R.query("cls_scene", f"WITH {SCENE} SELECT qid, task AS task_type, array_to_string(tags, ' ') AS domain_tags, array_to_string(found, ' ') AS matched, CASE WHEN n >= 22 OR len(tags) >= 3 THEN 'high' WHEN task IN ('comparison', 'multi_report_synthesis', 'procedure_or_qa') THEN 'medium' ELSE 'low' END AS complexity, coalesce(report_id, '') <> '' AS scoped, CASE WHEN contains(question, '?') THEN 'question' ELSE 'instruction' END AS style FROM task")
def cls_scene(spark: SparkSession, sf: str) -> DataFrame:
    rows = routing.with_scene(asked(spark, sf))
    return rows.select("qid", "scene.task_type", F.array_join("scene.domain_tags", " ").alias("domain_tags"), F.array_join("scene.matched_patterns", " ").alias("matched"), "scene.complexity", F.col("scene.has_report_scope").alias("scoped"), F.col("scene.query_style").alias("style"))


#: experience log: pos, task type, tags, status, strategy, backend, rows
MEMORY = [
    (1, "definition", "dosimetry", "sufficient", "definition_sparse_microchunk", "sparse", 5),
    (2, "comparison", "dosimetry equipment", "sufficient", "hybrid_rrf_synthesis", "hybrid", 8),
    (3, "procedure_or_qa", "quality_management equipment", "insufficient", "qa_sparse_exact_terms", "sparse", 8),
    (4, "asset_lookup", "imaging_guidance", "sufficient", "", "hybrid", 8),
    (5, "procedure_or_qa", "quality_management", "sufficient", "qa_sparse_exact_terms", "sparse", 7),
]
#: these, then a record a document, made from its number
LOG = f"""(SELECT pos, task_type, tags, status, strategy, backend, top_k FROM {values(MEMORY, 'pos', 'task_type', 'tags', 'status', 'strategy', 'backend', 'top_k')} UNION ALL
 SELECT 100 + doc_id, ['definition', 'comparison', 'procedure_or_qa', 'direct_fact'][1 + doc_id % 4], ['dosimetry', 'equipment imaging_guidance', 'quality_management'][1 + doc_id % 3], CASE WHEN doc_id % 5 = 0 THEN 'sufficient' ELSE 'insufficient' END, CASE WHEN doc_id % 2 = 0 THEN 'learned' ELSE '' END, ['sparse', 'hybrid'][1 + doc_id % 2], 3 + doc_id % 4 FROM documents)"""


def memory(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.createDataFrame(MEMORY, "pos long, task_type string, tags string, evidence_status string, strategy_used string, retrieval_backend string, evidence_top_k int")
    n = F.col("doc_id")
    one_of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (1 + at).cast("int"))
    made = documents(spark, sf).select(
        (100 + n).alias("pos"),
        one_of(("definition", "comparison", "procedure_or_qa", "direct_fact"), n % 4).alias("task_type"),
        one_of(("dosimetry", "equipment imaging_guidance", "quality_management"), n % 3).alias("tags"),
        F.when(n % 5 == 0, "sufficient").otherwise("insufficient").alias("evidence_status"),
        F.when(n % 2 == 0, "learned").otherwise("").alias("strategy_used"),
        one_of(("sparse", "hybrid"), n % 2).alias("retrieval_backend"),
        (3 + n % 4).cast("int").alias("evidence_top_k"),
    )
    return fixed.unionByName(made).withColumn("domain_tags", F.split("tags", " "))


MATCHES = f"""{SCENE}, points AS (SELECT t.qid, m.pos, m.strategy, m.backend, m.top_k, CASE WHEN t.task = m.task_type THEN 2 ELSE 0 END + len(list_intersect(t.tags, string_split(m.tags, ' '))) AS score FROM task t CROSS JOIN (SELECT * FROM {LOG}) m WHERE m.status = 'sufficient'),
matches AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM points WHERE score > 0 QUALIFY rank <= 3)"""


@R.query("rt_memory", f"WITH {MATCHES} SELECT qid, pos, CAST(score AS BIGINT) AS score, rank FROM matches")
def rt_memory(spark: SparkSession, sf: str) -> DataFrame:
    return routing.memory_matches(routing.with_scene(asked(spark, sf)), memory(spark, sf)).select("qid", "pos", "score", "rank")


TABLE = values([(k, *v) for k, v in rules.STRATEGIES.items()], "key", "strategy", "backend", "top_k")


@R.query("rt_select", f"WITH {MATCHES}, usable AS (SELECT qid, strategy, backend, top_k FROM matches WHERE strategy <> '' AND backend IN ('sparse', 'hybrid') QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1), cnt AS (SELECT qid, count(*) AS n FROM matches GROUP BY qid), keyed AS (SELECT qid, CASE WHEN task = 'out_of_scope' THEN task WHEN coalesce(report_id, '') <> '' THEN 'scoped' WHEN task IN ('comparison', 'multi_report_synthesis') THEN 'synthesis_dense' ELSE task END AS key FROM task) SELECT k.qid, coalesce(u.strategy, t.strategy) AS strategy, coalesce(u.backend, t.backend) AS backend, CAST(coalesce(u.top_k, t.top_k) AS INTEGER) AS evidence_top_k, CASE WHEN u.qid IS NULL THEN 0 ELSE n END AS memory_match_count FROM keyed k JOIN (SELECT * FROM {TABLE}) t USING (key) LEFT JOIN usable u USING (qid) LEFT JOIN cnt USING (qid)")
def rt_select(spark: SparkSession, sf: str) -> DataFrame:
    scenes = routing.with_scene(asked(spark, sf))
    return routing.select_strategy(scenes, True, routing.memory_matches(scenes, memory(spark, sf)))


HB_TEXT = """text || CASE WHEN doc_id % 5 = 0 THEN ' An output factor is defined as a ratio of doses.' WHEN doc_id % 5 = 1 THEN ' Nontarget dose refers to dose outside the target.' ELSE '' END || CASE WHEN doc_id % 13 = 0 THEN ' This report provides guidance on brachytherapy.' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN ' We compare beams.' ELSE '' END"""
HB_HEADS = {2: "REFERENCES", 3: "1. INTRODUCTION", 4: "8. RECOMMENDATIONS", 5: "FRONT_MATTER", 6: "4. MEASUREMENT of small fields", 7: "UNKNOWN"}
HB_TAGS = {1: "definition", 2: "recommendation", 3: "modality_specific"}


def rule_chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose sections, tags, kinds and texts hold what the heuristic rules look for."""
    n = F.col("corpus_pos")
    pick = lambda by, values, rest: F.coalesce(*(F.when(n % by == k, F.lit(v)) for k, v in values.items()), rest)
    text = F.concat(
        F.when(n % 11 == 0, "FIG. 1 ").otherwise(""),
        F.col("text"),
        F.when(n % 5 == 0, " An output factor is defined as a ratio of doses.").when(n % 5 == 1, " Nontarget dose refers to dose outside the target.").otherwise(""),
        F.when(n % 13 == 0, " This report provides guidance on brachytherapy.").otherwise(""),
        F.when(n % 17 == 0, " We compare beams.").otherwise(""),
    )
    chunks = adapters.document_chunks(documents(spark, sf))
    tags = F.coalesce(*(F.when(n % 4 == k, F.array(F.lit(v))) for k, v in HB_TAGS.items()), F.array().cast("array<string>"))
    source = F.when(n % 3 == 0, "reports/tg-158 nontarget dose.pdf").when(n % 3 == 1, "reports/trs 0483 small field.pdf")
    return chunks.select("chunk_id", "corpus_pos", "doc_id", "title", pick(9, HB_HEADS, F.col("section")).alias("section"), F.when(n % 19 == 0, "photons vs electrons").otherwise("UNKNOWN").alias("subsection"), text.alias("text"), tags.alias("tags"), F.when(n % 7 == 0, "definition_microchunk").otherwise("standard").alias("chunk_kind"), source.alias("source_path"), "page_start", "page_end", "token_count")


#: what SQL makes of the same rows: questions, chunks, and the tests of both
HB_SECTION = "CASE doc_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in HB_HEADS.items()) + " ELSE lang END"
HB_CHUNKS = f"""hc AS (SELECT 'c' || doc_id AS chunk_id, doc_id AS n, source AS doc_id, coalesce({HB_SECTION}, '') AS section, CASE WHEN doc_id % 19 = 0 THEN 'photons vs electrons' ELSE 'UNKNOWN' END AS subsection, CASE WHEN doc_id % 11 = 0 THEN 'FIG. 1 ' ELSE '' END || {HB_TEXT} AS text,
 doc_id % 4 AS tag, doc_id % 7 = 0 AS micro, CASE doc_id % 3 WHEN 0 THEN ' reports/tg-158 nontarget dose.pdf' WHEN 1 THEN ' reports/trs 0483 small field.pdf' ELSE '' END AS path, CAST(doc_id % 10 + 1 AS INTEGER) AS page_start, len({tok('text')}) AS tokens FROM documents)"""
_cues = any_match("{x}", [chr(92) + "b" + c + chr(92) + "b" for c in rules.DEFINITION_CUES])
_sentences = f"""list_transform(string_split({MARKED.format(x=NORM.format(x='text'))}, chr(1)), lambda x: trim(x))"""
_title = lambda x: f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-zA-Z][a-zA-Z0-9]{{2,}}')), lambda t: NOT list_contains({TITLE_STOP}, t))"
_report = lambda x: CUES.replace("question", x)
HB_QUESTIONS = f"""hq AS (SELECT qid, question, {KIND} AS kind, {_report('question')} AS cues, {_title('question')} AS words, {KEYS.format(x='question')} AS keys,
 lower(trim(coalesce(nullif(regexp_extract({NORMQ}, '(?i)^what is\\s+(.+?)(?:\\s+according to.*)?\\??$', 1), ''), nullif(regexp_extract({NORMQ}, '(?i)^define\\s+(.+?)\\??$', 1), '')))) AS focus FROM {ASKED} WHERE question <> '')"""
HB_FACTS = f"""hf AS (SELECT *, doc_id || ' ' || doc_id || path AS name, {_cues.format(x=NORM.format(x='text'))} AS cue, starts_with(upper(section), '1. INTRODUCTION') AS intro, starts_with(upper(section), 'REFERENCES') AS refs,
 upper(section) = 'FRONT_MATTER' OR (upper(section) = 'UNKNOWN' AND upper(subsection) = 'UNKNOWN' AND page_start <= 6 AND (regexp_matches(lower({NORM.format(x='text')}), '\\.{{3,}}\\s*\\d{{1,3}}') OR contains(lower({NORM.format(x='text')}), 'contents'))) AS front,
 tag = 2 OR contains(lower(section || ' ' || subsection), 'recommend') AS rec, starts_with(trim(text), 'FIG.') OR starts_with(trim(text), 'TABLE ') AS caption,
 tag = 3 OR {_holds(f"lower({NORM.format(x="section || ' ' || subsection || ' ' || text")})", rules.MODALITIES)} AS modality,
 ({' OR '.join(f"starts_with(upper({NORM.format(x='section')}), '{h}')" for h in rules.SUMMARY_SECTIONS)}) OR {any_match(NORM.format(x='text'), [chr(92) + 'b' + p + chr(92) + 'b' for p in rules.SUMMARY_PHRASES])} AS summary,
 list_filter({_sentences}, lambda x: x <> '' AND {_cues.format(x='x')}) AS cued, {_report('name_').replace('name_', "(doc_id || ' ' || doc_id || path)")} AS cues, {_title("(doc_id || ' ' || doc_id || path)")} AS words, {KEYS.format(x="section || ' ' || subsection")} AS keys FROM hc)"""


def _hb_score(w: dict, caption_in_definitions: bool) -> str:
    term = lambda test, weight: f"CASE WHEN {test} THEN {weight} ELSE 0.0 END"
    definition = [
        ("f.intro", "intro"), ("f.micro", "micro"), ("f.cue", "cue"), ("f.tag = 1", "tag"), ("coalesce(contains(lower(f.section || ' ' || f.subsection || ' ' || f.text), q.focus), FALSE)", "focus"), ("said", "focus_sentence"),
        ("f.modality AND NOT said", "modality"), ("f.rec AND NOT said AND NOT f.intro", "recommendation"), ("f.summary AND NOT said AND NOT f.cue", "summary"), ("NOT f.intro AND NOT f.cue", "no_cue"), (f"f.tokens > {w['long_tokens']}", "long"), ("f.front", "front_definition"),
    ]
    definition += [("f.caption", "caption")] if caption_in_definitions else []
    always = [("f.front", "front"), ("f.refs AND NOT contains(lower(q.question), 'reference')", "references")] + ([] if caption_in_definitions else [("f.caption", "caption")])
    recommendation = [("contains(lower(f.section), 'recommend') OR contains(lower(f.subsection), 'recommend')", "recommend_head"), ("f.rec", "recommend_like")]
    locator = [(f"len(q.keys) > 0 AND len(f.keys) > 0 AND len(list_intersect(q.keys, f.keys)) / greatest(len(q.keys), 1) > {w['locator_ratio']}", "locator"), ("f.section <> 'UNKNOWN'", "locator_known")]
    comparison = [("contains(lower(f.subsection), 'vs') OR contains(lower(f.subsection), 'versus') OR contains(lower(f.text), 'compare')", "versus"), ("regexp_matches(upper(f.section), '^(4\\. MEASUREMENT|5\\. COMPUTATIONAL|6\\. TECHNIQUES)')", "comparison_section")]
    total = lambda terms: " + ".join(term(t, w[k]) for t, k in terms)
    kinds = {"definition": definition, "recommendation": recommendation, "section_locator": locator, "comparison": comparison}
    by_kind = "CASE q.kind " + " ".join(f"WHEN '{k}' THEN {total(v)}" for k, v in kinds.items()) + " ELSE 0.0 END"
    shared = "len(list_intersect(q.cues, f.cues))"
    ratio = "(CASE WHEN len(f.words) = 0 THEN 0.0 ELSE len(list_intersect(q.words, f.words)) / greatest(len(q.words), 1) END)"
    report = f"CASE WHEN {shared} > 0 THEN 0.46 + least(0.10, {shared} * 0.03) WHEN len(q.cues) > 0 AND len(f.cues) > 0 THEN -0.18 ELSE 0.0 END + CASE WHEN {ratio} >= 0.45 THEN least(0.18, 0.08 + {ratio} * 0.15) WHEN {ratio} >= 0.25 THEN 0.05 ELSE 0.0 END"
    return f"round(CAST({report} + {total(always)} + {by_kind} AS DOUBLE), 6)"


HB_HITS = BM25.replace(f"SELECT item_id AS qid, unnest({tok('text')}) AS token FROM benchmark", f"SELECT qid, unnest({tok('question')}) AS token FROM {ASKED}")
HB_SQL = f"""WITH {HB_HITS}, {HB_CHUNKS}, {HB_QUESTIONS}, {HB_FACTS}, pairs AS (SELECT qid, corpus_pos AS n FROM sparse)
SELECT q.qid, f.chunk_id, {_hb_score(pr.RETRIEVAL_WEIGHTS, False)} AS bonus, {_hb_score(pr.RERANK_WEIGHTS, True)} AS adjustment FROM (SELECT hq.*, pairs.n AS n_ FROM hq JOIN pairs USING (qid)) q JOIN hf f ON f.n = q.n_, LATERAL (SELECT coalesce(len(list_filter(f.cued, lambda s: contains(lower(s), q.focus))) > 0, FALSE) AS said)"""


@R.query("hb_bonuses", HB_SQL)
def hb_bonuses(spark: SparkSession, sf: str) -> DataFrame:
    """Both heuristic scores of every question and its lexical candidates."""
    from lodestar.operators.rerank import heuristic_scores
    from lodestar.operators.retrieve import bm25_search

    questions = asked(spark, sf).where("question <> ''").select("qid", "question")
    hits = bm25_search(questions, adapters.document_chunks(documents(spark, sf)), F.col("text")).select("qid", "chunk_id")
    return heuristic_scores(hits, questions, rule_chunks_of(spark, sf))


@R.query("prd_front_matter", f"WITH {CHUNKS} SELECT chunk_id, upper(section) = 'FRONT_MATTER' OR (page_start <= 6 AND upper(section) = 'UNKNOWN' AND contains(lower(text), 'contents')) AS front, starts_with(upper(section), 'REFERENCES') AS refs, {any_match('text', [chr(92) + 'b' + c + chr(92) + 'b' for c in rules.DEFINITION_CUES])} AS cue FROM chunks")
def prd_front_matter(spark: SparkSession, sf: str) -> DataFrame:
    c = {n: F.col(n) for n in ("section", "subsection", "text", "page_start")}
    rows = adapters.document_chunks(documents(spark, sf))
    return rows.select("chunk_id", pr.front_matter(c["section"], c["subsection"], c["text"], c["page_start"]).alias("front"), pr.references(c["section"]).alias("refs"), pr.definition_cue(c["text"]).alias("cue"))
