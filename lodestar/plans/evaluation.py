"""Queries for metrics, statistics, audits and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import audit as au
from lodestar.operators import evaluate as el
from lodestar.operators import stats as st
from lodestar.plans.registry import Registry, table
from lodestar.plans.retrieval import RERANK, candidates_of, questions_of, reranked_of, sparse_of
from lodestar.plans.sql import BM25, RERANK_HEAD, tok
from lodestar.plans.textual import NUMBERS, each_with_item
from lodestar.sources.shared import fresh_folder, saved

R = Registry()
RUN = 8


def gold_of(spark: SparkSession, sf: str) -> DataFrame:
    """qid, chunk_id: documents that hold any eight consecutive words of a question."""
    found = el.passage_gold(questions_of(spark, sf), table(spark, sf, "documents"), "doc_id", RUN)
    return found.select("qid", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"))


GOLD = f"""gold AS (WITH bw AS (SELECT item_id AS qid, {tok('text')} AS w FROM benchmark), bn AS (SELECT qid, w, least(len(w), 8) AS n FROM bw WHERE len(w) > 0), dw AS (SELECT doc_id, {tok('text')} AS w FROM documents), ns AS (SELECT DISTINCT n FROM bn),
 br AS (SELECT DISTINCT qid, n, array_to_string(w[s:s + n - 1], ' ') AS r FROM (SELECT qid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bn)),
 dr AS (SELECT doc_id, n, array_to_string(w[s:s + n - 1], ' ') AS r FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, ns WHERE len(w) >= n))
 SELECT DISTINCT br.qid, 'c' || dr.doc_id AS chunk_id FROM br JOIN dr USING (n, r))"""
HITS = f"{BM25}, {GOLD}, firsts AS (SELECT s.qid, min(s.rank) AS first FROM sparse s JOIN gold USING (qid, chunk_id) GROUP BY s.qid), details AS (SELECT item_id AS qid, CAST(coalesce(first <= 1, FALSE) AS INTEGER) AS hit_at_1, CAST(coalesce(first <= 3, FALSE) AS INTEGER) AS hit_at_3, CAST(coalesce(first <= 5, FALSE) AS INTEGER) AS hit_at_5, coalesce(round(1 / first, 6), 0.0) AS rr FROM benchmark LEFT JOIN firsts ON qid = item_id)"


def details_of(spark: SparkSession, sf: str) -> DataFrame:
    return el.hit_at_k(sparse_of(spark, sf), gold_of(spark, sf), questions_of(spark, sf))


@R.query("ev_hit_at_k", f"WITH {HITS} SELECT * FROM details")
def ev_hit_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return details_of(spark, sf)


@R.query("ev_retrieval", f"WITH {HITS} SELECT count(*) AS n, round(avg(hit_at_1), 6) AS hit_at_1, round(avg(hit_at_3), 6) AS hit_at_3, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(rr), 6) AS rr FROM details")
def ev_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return el.summarize(details_of(spark, sf), "hit_at_1", "hit_at_3", "hit_at_5", "rr")


@R.query("ev_strategies", f"WITH {RERANK_HEAD}, {GOLD}, runs AS (SELECT 'sparse' AS strategy, qid, chunk_id, rank FROM sparse UNION ALL SELECT 'hybrid', qid, chunk_id, retrieval_rank FROM hybrid), f AS (SELECT strategy, r.qid, min(rank) AS first FROM runs r JOIN gold USING (qid, chunk_id) GROUP BY ALL), s AS (SELECT unnest(['sparse', 'hybrid']) AS strategy) SELECT strategy, count(*) AS n, round(avg(CAST(coalesce(first <= 5, FALSE) AS INTEGER)), 6) AS hit_at_5, round(avg(coalesce(round(1 / first, 6), 0.0)), 6) AS rr FROM s CROSS JOIN benchmark LEFT JOIN f USING (strategy) WHERE f.qid IS NULL OR f.qid = item_id GROUP BY strategy".replace("LEFT JOIN f USING (strategy) WHERE f.qid IS NULL OR f.qid = item_id", "LEFT JOIN f ON f.strategy = s.strategy AND f.qid = item_id").replace("SELECT strategy, count(*) AS n, round(avg(CAST", "SELECT s.strategy, count(*) AS n, round(avg(CAST").replace("GROUP BY strategy", "GROUP BY s.strategy"))
def ev_strategies(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.plans.retrieval import hybrid_of

    gold, asked = gold_of(spark, sf), questions_of(spark, sf)
    sparse = saved(sparse_of(spark, sf), fresh_folder(spark, "strategies"), "sparse")
    runs = {"sparse": sparse, "hybrid": hybrid_of(spark, sf, sparse).withColumnRenamed("retrieval_rank", "rank")}
    parts = [el.hit_at_k(run, gold, asked, (5,)).withColumn("strategy", F.lit(name)) for name, run in runs.items()]
    return el.summarize(parts[0].unionByName(parts[1]), "hit_at_5", "rr", by=["strategy"])


@R.query("ev_section_hit", f"WITH {RERANK_HEAD}, w AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'EN' ELSE 'fr' END AS gold FROM benchmark) SELECT w.qid, coalesce(bool_or(contains(lower(h.section), lower(gold))), FALSE) AS hit FROM w LEFT JOIN (SELECT h.qid, c.section FROM hybrid h JOIN chunks c USING (chunk_id) WHERE retrieval_rank <= 3) h ON h.qid = w.qid GROUP BY w.qid")
def ev_section_hit(spark: SparkSession, sf: str) -> DataFrame:
    wanted = questions_of(spark, sf).select("qid", F.when(F.col("qid") % 2 == 0, "EN").otherwise("fr").alias("gold_section"))
    return el.section_hits(candidates_of(spark, sf).withColumnRenamed("retrieval_rank", "rank"), wanted, 3)


@R.query("hp_page_hit", f"WITH {RERANK_HEAD}, w AS (SELECT item_id AS qid, 'src' || item_id % 20 AS doc_id, CAST(item_id % 10 + 1 AS INTEGER) AS page FROM benchmark) SELECT w.qid, coalesce(bool_or(h.doc_id = w.doc_id), FALSE) AS doc_hit, coalesce(bool_or(h.doc_id = w.doc_id AND h.page_start <= page + 1 AND h.page_end >= page - 1), FALSE) AS page_hit FROM w LEFT JOIN (SELECT h.qid, c.doc_id, c.page_start, c.page_end FROM hybrid h JOIN chunks c USING (chunk_id) WHERE retrieval_rank <= 5) h ON h.qid = w.qid GROUP BY w.qid")
def hp_page_hit(spark: SparkSession, sf: str) -> DataFrame:
    from lodestar.plans.retrieval import targets_of

    return el.page_hits(candidates_of(spark, sf).withColumnRenamed("retrieval_rank", "rank"), targets_of(spark, sf).withColumn("window", F.lit(1)))


ANSWER = "'Based on ' || b.text || ' [E1] 3.5% and 17-19 in ' || b.item_id || CASE WHEN b.item_id % 5 = 0 THEN '. We recommend it.' ELSE '' END"
BARE = r"regexp_replace(a.answer, '\[E\d+\]', ' ', 'g')"
TERMS = f"list_distinct(list_filter({tok(BARE)}, lambda t: length(t) >= 3 AND t NOT IN ('based', 'only', 'retrieved', 'evidence')))"
EACH = "SELECT d.doc_id, d.text AS hay, b.item_id, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"


@R.query("ev_quality", f"WITH a AS (SELECT doc_id, hay, {ANSWER} AS answer, b.item_id FROM ({EACH}) b) SELECT doc_id AS qid, round(len(list_intersect({TERMS}, list_distinct({tok('a.hay')}))) / greatest(len({TERMS}), 1), 6) AS grounded, array_to_string(list_sort(list_filter({NUMBERS.format(x='a.answer')}, lambda n: NOT list_contains({NUMBERS.format(x='coalesce(a.hay, chr(32))')}, n))), ' ') AS unsupported, item_id % 5 = 0 AS overclaim FROM a")
def ev_quality(spark: SparkSession, sf: str) -> DataFrame:
    """For every document an answer that quotes a benchmark item, some of them too sure, judged against the document."""
    rows = each_with_item(spark, sf).withColumnRenamed("d", "hay")
    sure = F.when(F.col("item_id") % 5 == 0, ". We recommend it.").otherwise("")
    answers = rows.select(F.col("doc_id").alias("qid"), F.concat(F.lit("Based on "), F.col("text"), F.lit(" [E1] 3.5% and 17-19 in "), F.col("item_id").cast("string"), sure).alias("answer"), "hay")
    return el.answer_quality(answers.drop("hay"), answers.select("qid", "hay")).select("qid", "grounded", F.array_join("unsupported_numbers", " ").alias("unsupported"), "overclaim")


LABELLED = "SELECT d.source, l.doc_id, l.quality, l.toxic, d.n_chars FROM labels l JOIN documents d USING (doc_id)"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@R.query("ag_rollup_profile", f"WITH l AS ({LABELLED}) SELECT source, count(*) AS n, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS bad FROM l GROUP BY ROLLUP (source)")
def ag_rollup_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled(spark, sf).select("source", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    return el.profile_rollup(rows, "source", "good", "bad")


@R.query("ag_confusion", f"WITH l AS ({LABELLED}) SELECT source, count_if(n_chars > 1500 AND quality = 1) AS tp, count_if(n_chars > 1500 AND quality = 0) AS fp, count_if(n_chars <= 1500 AND quality = 0) AS tn, count_if(n_chars <= 1500 AND quality = 1) AS fn FROM l GROUP BY source")
def ag_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).groupBy("source").agg(*el.confusion(F.col("n_chars") > 1500, F.col("quality") == 1))


@R.query("ag_percentiles", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS linear_low, round(quantile_cont(value, 0.95), 6) AS linear_high, quantile_disc(value, 0.95) AS nearest FROM events GROUP BY event_type")
def ag_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = el.quantiles(table(spark, sf, "events"), "value", {"linear_low": (0.025, False), "linear_high": (0.95, False), "nearest": (0.95, True)}, ["event_type"])
    return out.select("event_type", F.round("linear_low", 6).alias("linear_low"), F.round("linear_high", 6).alias("linear_high"), "nearest")


@R.query("ag_latency_stats", "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def ag_latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    return el.latency(table(spark, sf, "events"), "value", ["event_type"])


@R.query("ag_outcome_change", "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'both' WHEN toxic = 1 THEN 'improved' WHEN quality = 1 THEN 'regressed' ELSE 'neither' END AS outcome FROM labels")
def ag_outcome_change(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return el.outcome_change(labels.select("doc_id", (F.col("quality") == 1).alias("correct")), labels.select("doc_id", (F.col("toxic") == 1).alias("correct")), "doc_id")


@R.query("jn_strict_equal_keys", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def jn_strict_equal_keys(spark: SparkSession, sf: str) -> DataFrame:
    return el.key_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@R.query("hp_unique_index", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def hp_unique_index(spark: SparkSession, sf: str) -> DataFrame:
    return el.duplicates(table(spark, sf, "conversations"), "conv_id")


WILSON = "CASE WHEN total = 0 THEN 0 ELSE {f}({e}, (successes / total + 3.8414588206941236 / (2 * total) {s} 1.959963984540054 * sqrt((successes / total * (1 - successes / total) + 3.8414588206941236 / (4 * total)) / total)) / (1 + 3.8414588206941236 / total)) END"


@R.query("st_wilson", f"WITH l AS ({LABELLED}), b AS (SELECT source, count_if(quality = 1) AS successes, count(*) AS total FROM l GROUP BY source) SELECT source, successes, total, round(successes / total, 6) AS rate, round({WILSON.format(f='greatest', e=0.0, s='-')}, 6) AS low, round({WILSON.format(f='least', e=1.0, s='+')}, 6) AS high FROM b")
def st_wilson(spark: SparkSession, sf: str) -> DataFrame:
    return st.binary_summary(labelled(spark, sf), "quality", ["source"])


@R.query("st_mcnemar", f"WITH l AS ({LABELLED}), b AS (SELECT source, count(*) AS n, count_if(quality = 1 AND toxic = 0) AS left_only, count_if(quality = 0 AND toxic = 1) AS right_only FROM l GROUP BY source) SELECT source, n, left_only, right_only, round(CASE WHEN left_only + right_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(left_only, right_only) + 1 AS BIGINT)), lambda k: exp(lgamma(left_only + right_only + 1) - lgamma(k + 1) - lgamma(left_only + right_only - k + 1) - (left_only + right_only) * ln(2))))) END, 6) AS p FROM b")
def st_mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    return st.paired_test(labelled(spark, sf), "quality", "toxic", ["source"])


@R.query("st_bootstrap_mean")
def st_bootstrap_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: draws come from a keyed hash; tests compare the interval with theory."""
    out = st.bootstrap_mean(labelled(spark, sf), "quality", 1000)
    return out.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@R.query("st_bootstrap_paired")
def st_bootstrap_paired(spark: SparkSession, sf: str) -> DataFrame:
    out = st.bootstrap_paired(labelled(spark, sf), "quality", "toxic", repetitions=1000)
    return out.select(F.round("mean", 6).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@R.query("ev_taxonomy", f"WITH l AS ({LABELLED}), c AS (SELECT source, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'junk' WHEN n_chars < 200 THEN 'short' ELSE 'passed' END AS category FROM l) SELECT source, category, count(*) AS n FROM c GROUP BY CUBE (source, category)")
def ev_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("toxic", F.col("toxic") == 1), ("junk", F.col("quality") == 0), ("short", F.col("n_chars") < 200)]
    return el.failure_categories(labelled(spark, sf), rules).cube("source", "category").agg(F.count(F.lit(1)).alias("n"))


@R.query("va_events", "SELECT conv_id, arg_max(text, turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def va_events(spark: SparkSession, sf: str) -> DataFrame:
    return el.last_message(table(spark, sf, "conversations"), "conv_id", "turn", "text", F.col("role") == "assistant")


@R.query("va_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def va_resume(spark: SparkSession, sf: str) -> DataFrame:
    return au.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@R.query("va_answers", "WITH a AS (SELECT l.doc_id AS qid, CASE WHEN l.doc_id % 10 = 0 THEN 'Z' WHEN quality = 1 THEN 'A' ELSE 'B' END AS label, CASE WHEN l.doc_id % 9 = 0 THEN -1.0 ELSE 1.0 END AS latency FROM labels l) SELECT qid, 'label not offered' AS problem FROM a WHERE label = 'Z' UNION ALL SELECT qid, 'bad latency' FROM a WHERE latency < 0 UNION ALL SELECT doc_id, 'missing answer' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def va_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers made from labels, some with a label that isn't offered or a bad latency."""
    options = F.array(*(F.struct(F.lit(x).alias("label"), F.lit(x).alias("text")) for x in "AB"))
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), options.alias("options"), F.lit("A").alias("gold_label"))
    label = F.when(F.col("doc_id") % 10 == 0, "Z").when(F.col("quality") == 1, "A").otherwise("B")
    answers = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), label.alias("selected_label"), F.when(F.col("doc_id") % 9 == 0, -1.0).otherwise(1.0).alias("latency_seconds"))
    return au.validate_answers(answers, asked)


@R.query("ev_host_score", "SELECT count(*) AS n, round(avg(quality), 6) AS accuracy, round(avg(toxic), 6) AS citation_rate, round(avg(doc_id % 7), 6) AS mean_latency, round(median(doc_id % 7), 6) AS median_latency, CAST(quantile_disc(doc_id % 7, 0.95) AS DOUBLE) AS p95_latency FROM labels")
def ev_host_score(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    asked = labels.select(F.col("doc_id").alias("qid"), F.lit("A").alias("gold_label"))
    answers = labels.select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, "A").otherwise("B").alias("selected_label"), F.col("toxic").alias("n_citations"), (F.col("doc_id") % 7).cast("double").alias("latency_seconds"))
    return au.host_scores(answers, asked)


@R.query("au_eval", f"WITH l AS ({LABELLED}), a AS (SELECT source, unnest(['quality', 'toxic']) AS metric, unnest([sum(quality) / count(*), sum(toxic) / count(*)]) AS recomputed FROM l GROUP BY source) SELECT source, metric, abs(CASE WHEN metric = 'quality' THEN recomputed + CASE WHEN source LIKE '%7' THEN 0.01 ELSE 0 END ELSE round(recomputed, 3) END - recomputed) <= 1e-12 AS ok FROM a")
def au_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries that state wrong quality rates of some sources, and toxic rates cut to three digits."""
    rows = labelled(spark, sf)
    off = F.when(F.col("source").like("%7"), 0.01).otherwise(0.0)
    stated = rows.groupBy("source").agg((F.sum("quality") / F.count(F.lit(1))).alias("quality"), F.round(F.sum("toxic") / F.count(F.lit(1)), 3).alias("toxic")).withColumn("quality", F.col("quality") + off)
    return el.recomputed(rows, stated, ("quality", "toxic"), "source").select("source", "metric", "ok")


@R.query("ev_matrix", f"WITH l AS ({LABELLED}), s AS (SELECT count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM l) SELECT 'labels' AS experiment, unnest(['n', 'quality', 'toxic']) AS metric, unnest([CAST(n AS DOUBLE), quality, toxic]) AS value FROM s UNION ALL SELECT 'sizes', 'n', CAST(count(*) AS DOUBLE) FROM documents")
def ev_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return el.experiment_matrix({"labels": el.summarize(labelled(spark, sf), "quality", "toxic"), "sizes": table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n"))})


@R.query("st_subset", f"WITH {RERANK}, n AS (SELECT qid, max(rank) AS n FROM reranked GROUP BY qid) SELECT qid, qid % 4 <> 0 AND qid % 9 BETWEEN 1 AND n AS valid FROM n")
def st_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Ids marked in a text, none in some, are among the ranked evidence."""
    known = reranked_of(spark, sf).groupBy("qid").agg(F.collect_set(F.concat(F.lit("E"), F.col("rank").cast("string"))).alias("known"))
    text = F.when(F.col("qid") % 4 == 0, "").otherwise(F.concat(F.lit("as [E1] and [E"), (F.col("qid") % 9).cast("string"), F.lit("] say, [E1]")))
    return known.select("qid", el.ids_valid(el.marked_ids(text), F.col("known")).alias("valid"))
