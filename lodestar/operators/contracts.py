"""Evaluations of answers against expectations: gold values, assets, cells, tasks and tool calls.

An outcome row has qid, ok, code, answer, prompt and n_citations; evidence rows have qid,
rank, doc_id, pages, title, section, citation and text; asset rows qid, rank, asset_id,
caption, text_preview. What counts as the text to be searched differs between
evaluations, so the builder takes flags and nothing is searched by default but evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import group_hit, option_in_text
from lodestar.operators.evaluate import page_hits, profile_rollup


def haystack(outcomes: DataFrame, evidence: DataFrame, assets: DataFrame | None = None, answer: bool = False, prompt: bool = False, heads: bool = False) -> DataFrame:
    """qid, hay: evidence texts in rank order, with assets' captions and previews, and by flag the answer, the prompt and evidence titles, sections and citations."""
    parts = [F.col(c) for c in ("title", "section", "citation")] if heads else []
    lines = evidence.select("qid", "rank", F.lit(0).alias("side"), F.concat_ws("\n", *parts, F.col("text")).alias("line"))
    if assets is not None:
        lines = lines.unionByName(assets.select("qid", "rank", F.lit(1).alias("side"), F.concat_ws("\n", "caption", "text_preview").alias("line")))
    body = lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "side", "line"))), lambda x: x["line"]), "\n").alias("body"))
    rows = outcomes.join(body, "qid", "left")
    said = ([F.col("answer")] if answer else []) + ([F.col("prompt")] if prompt else [])
    return rows.select("qid", F.concat_ws("\n", *said, F.coalesce("body", F.lit(""))).alias("hay"))


def gold_values(questions: DataFrame, outcomes: DataFrame, evidence: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """qid, profile, answer_hit, evidence_hit (answer included), citation_present, success. Without expected groups nothing hits."""
    hay = haystack(outcomes, evidence, assets, answer=True)
    rows = questions.join(outcomes, "qid", "left").join(hay, "qid", "left")
    groups = F.col("expected_answer_groups")
    rows = rows.select("qid", "profile", group_hit(F.col("answer"), groups, empty=False).alias("answer_hit"), group_hit(F.col("hay"), groups, empty=False).alias("evidence_hit"), (F.coalesce("n_citations", F.lit(0)) > 0).alias("citation_present"))
    return rows.withColumn("success", F.col("evidence_hit") & F.col("citation_present"))


def generation_gaps(questions: DataFrame, outcomes: DataFrame, evidence: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Whether the value is in the answer, the evidence or the prompt, and which gap that means."""
    rows = questions.join(outcomes.select("qid", "answer"), "qid", "left")
    found = {"all_hit": haystack(outcomes, evidence, assets, answer=True, heads=True), "evidence_hit": haystack(outcomes, evidence, assets, heads=True), "bundle_hit": haystack(outcomes, evidence, assets, prompt=True, heads=True)}
    groups = F.col("expected_answer_groups")
    rows = rows.withColumn("answer_hit", group_hit(F.col("answer"), groups, empty=False))
    for name, hay in found.items():
        rows = rows.join(hay, "qid", "left").withColumn(name, group_hit(F.col("hay"), groups, empty=False)).drop("hay")
    anywhere = F.col("all_hit") | F.col("evidence_hit") | F.col("bundle_hit")
    return rows.select("qid", "profile", "answer_hit", *found, (anywhere & ~F.col("answer_hit")).alias("synthesis_gap"), (~anywhere).alias("retrieval_gap"))


def asset_traces(assets: DataFrame, wanted: DataFrame, k: int | None = 5) -> DataFrame:
    """qid, asset_hit: the wanted asset is among those of the top k evidence rows (k=None: of all); true where none is wanted."""
    near = assets if k is None else assets.where(F.col("rank") <= k)
    hits = wanted.select("qid", F.col("asset_id").alias("want")).join(near.select("qid", "asset_id"), "qid", "left")
    return hits.groupBy("qid").agg((F.bool_or(F.col("want").isNull()) | F.coalesce(F.bool_or(F.col("want") == F.col("asset_id")), F.lit(False))).alias("asset_hit"))


def table_cells(questions: DataFrame, outcomes: DataFrame, evidence: DataFrame, assets: DataFrame) -> DataFrame:
    """qid, doc_hit, page_hit, asset_hit, evidence_hit, citation_present, success: all of them."""
    values = gold_values(questions, outcomes, evidence, assets).select("qid", "evidence_hit", "citation_present")
    pages = page_hits(evidence, questions.select("qid", "doc_id", "page", "window"))
    rows = values.join(pages, "qid").join(asset_traces(assets, questions), "qid")
    return rows.withColumn("success", F.col("doc_hit") & F.col("page_hit") & F.col("asset_hit") & F.col("evidence_hit") & F.col("citation_present"))


def document_hits(evidence: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """qid, doc_hit: some expected document in the top k; true where none is expected."""
    rows = wanted.select("qid", "expected_doc_ids").join(evidence.where(F.col("rank") <= k).select("qid", "doc_id"), "qid", "left")
    none = F.size(F.coalesce("expected_doc_ids", F.array().cast("array<string>"))) == 0
    return rows.groupBy("qid").agg((F.bool_or(none) | F.coalesce(F.bool_or(F.array_contains("expected_doc_ids", F.col("doc_id"))), F.lit(False))).alias("doc_hit"))


def task_contracts(tasks: DataFrame, outcomes: DataFrame, evidence: DataFrame, assets: DataFrame, abstentions: tuple[str, ...] = ("insufficient_evidence", "out_of_scope")) -> DataFrame:
    """The conjunctive contract of agent tasks; refusals succeed by the right error code.

    tasks: qid, expected_doc_ids, expected_citations, expected_bundle_prompt, asset_id,
    expected_answer_groups, expected_abstain.
    """
    hay = haystack(outcomes, evidence, assets, answer=True)
    rows = tasks.join(outcomes, "qid", "left").join(hay, "qid", "left").join(document_hits(evidence, tasks), "qid").join(asset_traces(assets, tasks), "qid")
    ok = F.coalesce("ok", F.lit(False))
    flags = {
        "structured": ok,
        "doc": F.col("doc_hit"),
        "citation": ~F.coalesce("expected_citations", F.lit(False)) | (F.coalesce("n_citations", F.lit(0)) > 0),
        "bundle": ~F.coalesce("expected_bundle_prompt", F.lit(False)) | (F.coalesce("prompt", F.lit("")) != ""),
        "asset": F.col("asset_hit"),
        "answer_value": group_hit(F.coalesce("hay", F.lit("")), F.col("expected_answer_groups"), empty=True),
    }
    abstained = ~ok & F.coalesce(F.col("code").isin(*abstentions), F.lit(False))
    return rows.select("qid", *(c.alias(n) for n, c in flags.items()), F.when(F.col("expected_abstain"), abstained).otherwise(conjunction(flags.values())).alias("success"))


def tool_contracts(calls: DataFrame) -> DataFrame:
    """Eight checks of a tool call. calls: qid, tool, ok, code, n_items, doc_ids, n_citations, prompt, asset_ids, answer and the expected_ columns."""
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    refuse = F.coalesce("expected_abstain", F.lit(False))
    tool = ~F.col("tool").isin("list_reports", "list_navigator_topics") | (F.coalesce("n_items", F.lit(0)) > 0)
    wanted, groups = texts("expected_doc_ids"), F.col("expected_answer_groups")
    checks = {
        "ok": F.col("ok") != refuse,
        "abstention": ~refuse | F.array_contains(texts("expected_error_codes"), F.coalesce("code", F.lit(""))),
        "tool_specific": refuse | tool,
        "doc": refuse | (F.size(wanted) == 0) | F.arrays_overlap(wanted, texts("doc_ids")),
        "citation": refuse | ~F.coalesce("expected_citations", F.lit(False)) | (F.coalesce("n_citations", F.lit(0)) > 0),
        "bundle": refuse | ~F.coalesce("expected_bundle_prompt", F.lit(False)) | (F.coalesce("prompt", F.lit("")) != ""),
        "asset": refuse | (F.coalesce("expected_asset_id", F.lit("")) == "") | F.array_contains(texts("asset_ids"), F.col("expected_asset_id")),
        "answer_value": refuse | group_hit(F.coalesce("answer", F.lit("")), groups, empty=True),
    }
    return calls.select("qid", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items())).withColumn("passed", conjunction(F.col(n) for n in checks))


def conjunction(flags) -> Column:
    return reduce(lambda a, b: a & b, flags)


def skill_summary(details: DataFrame, profile: str = "profile", *flags: str) -> DataFrame:
    """Rates of flags in total and by profile."""
    return profile_rollup(details, profile, *flags)


def mcq_results(options: DataFrame, gold: DataFrame, evidence_text: DataFrame) -> DataFrame:
    """qid, correct, evidence_has_gold. options: qid, label, option, rank (scored); gold: qid, gold_label; evidence_text: qid, hay."""
    chosen = options.where("rank = 1").select("qid", F.col("label").alias("chosen"))
    right = options.join(gold, (options["qid"] == gold["qid"]) & (options["label"] == gold["gold_label"])).select(options["qid"], "option")
    rows = gold.join(chosen, "qid", "left").join(right, "qid", "left").join(evidence_text, "qid", "left")
    return rows.select("qid", F.coalesce(F.col("chosen") == F.col("gold_label"), F.lit(False)).alias("correct"), F.coalesce(option_in_text(F.col("option"), F.col("hay")), F.lit(False)).alias("evidence_has_gold"))


def navigator_metrics(topics: DataFrame, documents: DataFrame, topic_documents: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, topic_hit_at_1 to 3, doc_hit_at_1, 3 and 5.

    A topic hits if it holds the gold document. topics: qid, topic, rank; documents: qid,
    doc_id, rank; topic_documents: topic, doc_id; gold: qid, doc_id.
    """
    g = gold.select("qid", F.col("doc_id").alias("gold"))
    t = topics.join(topic_documents.withColumnRenamed("doc_id", "gold"), "topic").join(g, ["qid", "gold"], "left_semi").groupBy("qid").agg(F.min("rank").alias("t"))
    d = documents.withColumnRenamed("doc_id", "gold").join(g, ["qid", "gold"], "left_semi").groupBy("qid").agg(F.min("rank").alias("d"))
    rows = g.select("qid").join(t, "qid", "left").join(d, "qid", "left")
    at = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    return rows.select("qid", *(at("t", k).alias(f"topic_hit_at_{k}") for k in (1, 2, 3)), *(at("d", k).alias(f"doc_hit_at_{k}") for k in (1, 3, 5)))
