"""Contract evaluations on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import contracts as ct


def tables(spark):
    q = spark.createDataFrame([(1, "p", [["6 Gy", "six"], ["dose"]]), (2, "p", [["absent"]]), (3, "r", [])], "qid long, profile string, expected_answer_groups array<array<string>>")
    o = spark.createDataFrame([(1, True, None, "the dose", "ask dose 6 Gy", 1), (2, True, None, "x", "", 1), (3, True, None, "y", "", 0)], "qid long, ok boolean, code string, answer string, prompt string, n_citations int")
    e = spark.createDataFrame([(1, 1, "d", "T", "S", 1, 2, "c1", "limit is 6 Gy"), (2, 1, "d", "absent", "S", 1, 2, "c2", "none")], "qid long, rank int, doc_id string, title string, section string, page_start int, page_end int, citation string, text string")
    a = spark.createDataFrame([(1, 1, "a1", "cap", "prev")], "qid long, rank int, asset_id string, caption string, text_preview string")
    return q, o, e, a


def test_gold_values_and_gaps(spark):
    q, o, e, a = tables(spark)
    got = {r.qid: (r.answer_hit, r.evidence_hit, r.success) for r in ct.gold_values(q, o, e, a).collect()}
    assert got == {1: (False, True, True), 2: (False, False, False), 3: (False, False, False)}
    gaps = {r.qid: (r.evidence_hit, r.bundle_hit, r.synthesis_gap, r.retrieval_gap) for r in ct.generation_gaps(q, o, e, a).collect()}
    assert gaps == {1: (False, True, True, False), 2: (True, True, True, False), 3: (False, False, False, True)}


def test_haystack_has_only_what_is_asked_for(spark):
    _, o, e, a = tables(spark)
    hay = lambda **how: ct.haystack(o, e, a, **how).where("qid = 1").first().hay
    assert hay() == "limit is 6 Gy\ncap\nprev"
    assert hay(answer=True).startswith("the dose\n") and hay(heads=True).startswith("T\nS\nc1\n") and "ask" in hay(prompt=True)


def test_tool_contracts(spark):
    schema = "qid long, tool string, ok boolean, code string, n_items int, doc_ids array<string>, n_citations int, prompt string, asset_ids array<string>, answer string, expected_abstain boolean, expected_error_codes array<string>, expected_doc_ids array<string>, expected_citations boolean, expected_bundle_prompt boolean, expected_asset_id string, expected_answer_groups array<array<string>>"
    rows = [
        (1, "query_reports", True, None, None, ["d"], 1, "p", ["a"], "six gy", False, None, ["d", "e"], True, True, "a", [["six"]]),
        (2, "list_reports", True, None, 0, None, None, None, None, None, False, None, None, None, None, None, None),
        (3, "query_reports", False, "out_of_scope", None, None, None, None, None, None, True, ["out_of_scope"], None, True, None, None, None),
        (4, "query_reports", False, "other", None, None, None, None, None, None, True, ["out_of_scope"], None, None, None, None, None),
    ]
    got = {r.qid: (r.passed, r.tool_specific, r.abstention) for r in ct.tool_contracts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (True, True, True), 2: (False, False, True), 3: (True, True, True), 4: (False, True, False)}


def test_multiple_choice_results(spark):
    options = spark.createDataFrame([(1, "A", "proton", 1), (1, "B", "photon", 2), (2, "A", "x", 2), (2, "B", "y", 1)], "qid long, label string, option string, rank int")
    gold = spark.createDataFrame([(1, "A"), (2, "A")], "qid long, gold_label string")
    hay = spark.createDataFrame([(1, "a Proton beam"), (2, "none")], "qid long, hay string")
    got = {r.qid: (r.correct, r.evidence_has_gold) for r in ct.mcq_results(options, gold, hay).collect()}
    assert got == {1: (True, True), 2: (False, False)}


def test_asset_traces_and_document_hits(spark):
    _, _, e, a = tables(spark)
    wanted = spark.createDataFrame([(1, "a1", ["d"]), (2, "a9", ["z"]), (3, None, [])], "qid long, asset_id string, expected_doc_ids array<string>")
    assert {r.qid: r.asset_hit for r in ct.asset_traces(a, wanted).collect()} == {1: True, 2: False, 3: True}
    assert {r.qid: r.asset_hit for r in ct.asset_traces(a.withColumn("rank", F.lit(9)), wanted).collect()}[1] is False
    assert {r.qid: r.doc_hit for r in ct.document_hits(e, wanted).collect()} == {1: True, 2: False, 3: True}
