"""Evaluations as a whole: ablations, selectors, exams, assets, intervals and comparisons of runs.

Details are tables with a row a question; summaries are means over them. Configurations are
columns, not processes: all variants of an experiment are one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import group_hit
from lodestar.operators import contracts, evaluate, rerank, stats

# Variants of the ablation (backend, model reranking, report rules).
VARIANTS = {
    "bm25_lexical_no_reportaware": ("sparse", False, False),
    "bm25_lexical_reportaware": ("sparse", False, True),
    "hybrid_lexical_no_reportaware": ("hybrid", False, False),
    "hybrid_crossencoder_no_reportaware": ("hybrid", True, False),
    "hybrid_crossencoder_reportaware": ("hybrid", True, True),
    "routed_full": ("routed", True, True),
}

ABSTENTIONS = ("insufficient_evidence", "out_of_scope")


def retrieval_details(questions: DataFrame, evidence: DataFrame, sufficient: DataFrame, gold: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, qid, in_scope, hit_at_3, hit_at_5, rr, doc_hit_at_3, doc_hit_at_5, abstained.

    questions: qid, expected_doc_id, expected_abstain; evidence: qid, chunk_id, doc_id,
    rank; gold: qid, chunk_id; sufficient: qid, sufficient. `by` names columns that all but
    gold have besides (variants of a run). Document hits count for questions in scope that
    expect a document; for others they are null.
    """
    by = by or []
    key = [*by, "qid"]
    marked = evidence.join(gold.select("qid", "chunk_id").distinct().withColumn("is_gold", F.lit(True)), ["qid", "chunk_id"], "left")
    marked = marked.join(questions.select(*key, "expected_doc_id"), key)
    first = marked.groupBy(*key).agg(F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("g"), F.min(F.when(F.col("doc_id") == F.col("expected_doc_id"), F.col("rank"))).alias("d"))
    rows = questions.join(first, key, "left").join(sufficient.select(*key, "sufficient"), key, "left")
    at = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False)).cast("int")
    inside = ~F.coalesce("expected_abstain", F.lit(False))
    counts = inside & F.col("expected_doc_id").isNotNull()
    return rows.select(
        *key,
        inside.alias("in_scope"),
        at("g", 3).alias("hit_at_3"),
        at("g", 5).alias("hit_at_5"),
        F.coalesce(F.round(1 / F.col("g"), 6), F.lit(0.0)).alias("rr"),
        F.when(counts, at("d", 3)).alias("doc_hit_at_3"),
        F.when(counts, at("d", 5)).alias("doc_hit_at_5"),
        (~F.coalesce("sufficient", F.lit(False))).alias("abstained"),
    )


def retrieval_summary(details: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the hits, and the confusion of abstentions (tp: rightly abstained)."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c)
    return details.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *map(mean, ("hit_at_3", "hit_at_5", "rr", "doc_hit_at_3", "doc_hit_at_5")), *evaluate.confusion(F.col("abstained"), ~F.col("in_scope")))


def outcomes(details: DataFrame) -> DataFrame:
    """qid, kind, outcome: document hits in scope (document) and refusals out of scope (refusal) as 0 or 1."""
    kind = F.when(F.col("in_scope"), "document").otherwise("refusal")
    return details.select("qid", kind.alias("kind"), F.when(F.col("in_scope"), F.coalesce("doc_hit_at_5", F.lit(0))).otherwise(F.col("abstained").cast("int")).alias("outcome"))


def ablation_evidence(candidates: DataFrame, routes: DataFrame, model: Column, bonus: Column, adjustment: Column, variants: dict[str, tuple[str, bool, bool]] = VARIANTS, k: int = rerank.TOP_K) -> DataFrame:
    """variant, qid, rank and the chunk's columns: every variant's evidence from one pass over the candidates.

    candidates: rows of rerank.rerank with the backend (sparse or hybrid) that found them;
    routes: qid, backend. A variant reranks its backend's rows, or those of the question's
    route, by the model's score or the lexical one, with or without the rules' bonus and
    adjustment. Scores are computed once a candidate, before it is taken by its variants.
    """
    lexical = rerank.lexical_score(F.col("question"), rerank.rerank_text())
    rows = candidates.join(routes.select("qid", F.col("backend").alias("route")), "qid", "left")
    rows = rows.select("*", lexical.alias("by_words"), model.alias("by_model"), bonus.alias("rule_bonus"), adjustment.alias("rule_adjustment"))
    plans = F.array(*(F.struct(F.lit(name).alias("variant"), F.lit(backend).alias("backend"), F.lit(modelled).alias("modelled"), F.lit(rules).alias("rules")) for name, (backend, modelled, rules) in variants.items()))
    mine = F.filter(plans, lambda p: (p["backend"] == F.col("backend")) | ((p["backend"] == "routed") & (F.col("route") == F.col("backend"))))
    rows = rows.withColumn("plan", F.explode(mine)).withColumn("question_id", F.col("qid")).withColumn("qid", F.struct(F.col("plan.variant").alias("variant"), "qid"))
    ruled = lambda c: F.when(F.col("plan.rules"), F.col(c)).otherwise(0.0)
    ranked = rerank.rerank(rows, k, F.when(F.col("plan.modelled"), F.col("by_model")).otherwise(F.col("by_words")), ruled("rule_bonus"), ruled("rule_adjustment"))
    ranked = rerank.refine(ranked)
    return ranked.withColumn("variant", F.col("qid.variant")).withColumn("qid", F.col("question_id")).drop("question_id", "plan", "backend", "route", "by_words", "by_model", "rule_bonus", "rule_adjustment")


def selector_details(questions: DataFrame, answers: dict[str, DataFrame]) -> DataFrame:
    """selector, qid, profile, answer_hit, citation_present: every selector's answer to the same evidence.

    questions: qid, profile, expected_answer_groups; answers: qid, answer, used_evidence_ids by selector.
    """
    each = []
    for name, told in answers.items():
        rows = questions.join(told.select("qid", "answer", "used_evidence_ids"), "qid", "left")
        each.append(rows.select(F.lit(name).alias("selector"), "qid", "profile", group_hit(F.col("answer"), F.col("expected_answer_groups"), empty=False).alias("answer_hit"), (F.size(F.coalesce("used_evidence_ids", F.array().cast("array<string>"))) > 0).alias("citation_present")))
    return reduce(DataFrame.unionByName, each)


def paired(details: DataFrame, name: str, value: str, baseline: str, challenger: str, repetitions: int = 1000, seed: int = 1) -> DataFrame:
    """One row: challenger against baseline over questions that both have.

    details: a column `name` that tells runs apart, qid, and a 0/1 `value`.
    """
    spark = details.sparkSession
    side = lambda run, alias: details.where(F.col(name) == run).select("qid", F.col(value).cast("int").alias(alias))
    cells = side(baseline, "a").join(side(challenger, "b"), "qid").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).collect()  # at most four
    of = lambda *which: sum(r.c for r in cells if (r.a, r.b) in which)
    n, a_hits, b_hits, better, worse = sum(r.c for r in cells), of((1, 0), (1, 1)), of((0, 1), (1, 1)), of((0, 1)), of((1, 0))
    spread = stats.bootstrap_counted(spark.createDataFrame([(float(v), c) for v, c in ((1, better), (-1, worse), (0, n - better - worse)) if c], "v double, c long"), repetitions, seed)
    whole = lambda x: F.lit(x).cast("long")
    a, b = stats.wilson(whole(a_hits), whole(n)), stats.wilson(whole(b_hits), whole(n))
    return spread.select(
        F.lit(baseline).alias("baseline"),
        F.lit(challenger).alias("challenger"),
        whole(n).alias("n"),
        F.lit(round(a_hits / max(1, n), 6)).alias("baseline_rate"),
        F.lit(round(b_hits / max(1, n), 6)).alias("challenger_rate"),
        F.lit(round((b_hits - a_hits) / max(1, n), 6)).alias("difference"),
        F.round(a["low"], 6).alias("baseline_low"),
        F.round(a["high"], 6).alias("baseline_high"),
        F.round(b["low"], 6).alias("challenger_low"),
        F.round(b["high"], 6).alias("challenger_high"),
        F.round("low", 6).alias("difference_low"),
        F.round("high", 6).alias("difference_high"),
        whole(better).alias("challenger_better"),
        whole(worse).alias("challenger_worse"),
        F.round(stats.mcnemar(whole(better), whole(worse)), 6).alias("p"),
    )


def uncertainty(flags: dict[str, tuple[DataFrame, str]], means: dict[str, tuple[DataFrame, str]] | None = None, repetitions: int = 1000, seed: int = 1) -> DataFrame:
    """metric, total, successes, rate, low, high: Wilson intervals of 0/1 or boolean columns, bootstrap intervals of means."""
    parts = []
    for name, (rows, column) in flags.items():
        s = stats.binary_summary(rows.select(F.col(column).cast("int").alias("x")).where("x IS NOT NULL"), "x")
        parts.append(s.select(F.lit(name).alias("metric"), "total", "successes", "rate", "low", "high"))
    for name, (rows, column) in (means or {}).items():
        known = rows.where(F.col(column).isNotNull())
        n = known.agg(F.count(F.lit(1)).alias("total"))
        m = stats.bootstrap_mean(known, column, repetitions, seed)
        parts.append(n.crossJoin(F.broadcast(m)).select(F.lit(name).alias("metric"), "total", F.lit(None).cast("long").alias("successes"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("rate"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high")))
    return reduce(DataFrame.unionByName, parts)


def exam(options: DataFrame, gold: DataFrame, evidence: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """qid, chosen, correct, evidence_has_gold, citation_present, option_scores.

    options: qid, question, label, option; gold: qid, gold_label; evidence as in contracts.
    The option with the best score over the question's evidence is chosen, gold unseen.
    """
    scored = rerank.option_scores(options, evidence)
    chosen = scored.where("rank = 1").select("qid", F.col("label").alias("chosen"))
    scores = scored.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("option_scores"))
    titled = evidence.withColumn("text", F.concat_ws("\n", "title", "text"))
    hay = contracts.haystack(gold.select("qid"), titled, assets)
    placed = options.select("qid", "label", "option").join(scored.select("qid", "label", "rank"), ["qid", "label"])
    result = contracts.mcq_results(placed, gold, hay)
    cited = evidence.select("qid").distinct().withColumn("citation_present", F.lit(True))
    rows = result.join(chosen, "qid", "left").join(cited, "qid", "left").join(scores, "qid", "left")
    return rows.select("qid", "chosen", "correct", "evidence_has_gold", F.coalesce("citation_present", F.lit(False)).alias("citation_present"), "option_scores")


def asset_details(questions: DataFrame, evidence: DataFrame, near: DataFrame, k: int = 5) -> DataFrame:
    """qid, doc_hit, page_hit, asset_hit, type_hit in the first k evidence rows.

    questions: qid, doc_id, page, window, asset_id, asset_type; near: qid, rank, asset_id, asset_type.
    """
    pages = evaluate.page_hits(evidence, questions.select("qid", "doc_id", "page", "window"), k)
    seen = near.where(F.col("rank") <= k).select("qid", F.col("asset_id").alias("seen_id"), F.col("asset_type").alias("seen_type"))
    traces = questions.select("qid", "asset_id", "asset_type").join(seen, "qid", "left").groupBy("qid").agg(F.coalesce(F.bool_or(F.col("asset_id") == F.col("seen_id")), F.lit(False)).alias("asset_hit"), F.coalesce(F.bool_or(F.col("asset_type") == F.col("seen_type")), F.lit(False)).alias("type_hit"))
    return pages.join(traces, "qid")


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def compare_runs(old_counts: DataFrame, new_counts: DataFrame, old_metrics: DataFrame, new_metrics: DataFrame) -> DataFrame:
    """kind, name, old, new, delta: artifact counts (name, n; a missing one is 0) and metrics (name, value; a missing one has no delta)."""
    side = lambda df, value, alias: df.select("name", F.col(value).cast("double").alias(alias))
    counts = side(old_counts, "n", "old").join(side(new_counts, "n", "new"), "name", "full").select(F.lit("artifact").alias("kind"), "name", F.coalesce("old", F.lit(0.0)).alias("old"), F.coalesce("new", F.lit(0.0)).alias("new"))
    metrics = side(old_metrics, "value", "old").join(side(new_metrics, "value", "new"), "name", "full").select(F.lit("metric").alias("kind"), "name", "old", "new")
    return counts.unionByName(metrics).withColumn("delta", F.round(F.col("new") - F.col("old"), 6))


def outcome_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """outcome, n: questions by what changed; runs with other questions raise. old, new: qid, correct."""
    wrong = evaluate.key_difference(old, new).limit(5).collect()
    if wrong:
        raise ValueError(f"the runs have different questions: {', '.join(str(r.qid) for r in wrong)}")
    changed = evaluate.outcome_change(old, new).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    every = old.sparkSession.createDataFrame([(x,) for x in ("improved", "regressed", "both", "neither")], "outcome string")
    return every.join(changed, "outcome", "left").na.fill(0)
