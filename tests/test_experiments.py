"""Whole evaluations on hand-made rows, and the helpers around them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import experiments as ex
from lodestar.operators import generators as gn
from lodestar.operators.nested import element_texts
from lodestar.sources import files


def test_retrieval_details_and_summary(spark):
    questions = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, None, False), (4, "a", True)], "qid long, expected_doc_id string, expected_abstain boolean")
    evidence = spark.createDataFrame([(1, "c1", "x", 1), (1, "c2", "a", 4), (2, "c3", "z", 1), (4, "c9", "a", 1)], "qid long, chunk_id string, doc_id string, rank int")
    enough = spark.createDataFrame([(1, True), (2, False), (4, False)], "qid long, sufficient boolean")
    gold = spark.createDataFrame([(1, "c2"), (1, "c2"), (2, "c8")], "qid long, chunk_id string")
    rows = {r.qid: r for r in ex.retrieval_details(questions, evidence, enough, gold).collect()}
    assert (rows[1].hit_at_3, rows[1].hit_at_5, rows[1].rr, rows[1].doc_hit_at_3, rows[1].doc_hit_at_5) == (0, 1, 0.25, 0, 1)
    assert rows[2].doc_hit_at_5 == 0 and rows[3].doc_hit_at_5 is None and rows[4].doc_hit_at_5 is None
    s = ex.retrieval_summary(ex.retrieval_details(questions, evidence, enough, gold)).first()
    assert (s.n, s.doc_hit_at_5, s.tp, s.fp, s.tn, s.fn) == (4, 0.5, 1, 2, 1, 0)
    assert {r.qid: (r.kind, r.outcome) for r in ex.outcomes(ex.retrieval_details(questions, evidence, enough, gold)).collect()} == {1: ("document", 1), 2: ("document", 0), 3: ("document", 0), 4: ("refusal", 1)}
    assert ex.retrieval_summary(ex.retrieval_details(questions.limit(0), evidence, enough, gold)).first().n == 0


def test_paired_runs_and_intervals(spark):
    """Eleven better and four worse of 61 is the golden case of the exact test."""
    outcomes = [(q, 0, 1) for q in range(12)] + [(q, 1, 0) for q in range(12, 14)] + [(q, 1, 1) for q in range(14, 36)] + [(q, 0, 0) for q in range(36, 61)]
    rows = [("lexical", q, a) for q, a, _ in outcomes] + [("semantic", q, b) for q, _, b in outcomes] + [("semantic", 99, 1)]
    r = ex.paired(spark.createDataFrame(rows, "run string, qid long, hit int"), "run", "hit", "lexical", "semantic").first()
    assert (r.n, r.challenger_better, r.challenger_worse) == (61, 12, 2) and r.p == pytest.approx(0.012939, abs=1e-6)
    assert r.difference == pytest.approx(10 / 61, abs=1e-6) and 0.02 < r.difference_low < 0.09 and 0.24 < r.difference_high < 0.31
    assert r.baseline_low < r.baseline_rate < r.baseline_high and r.challenger_low < r.challenger_rate < r.challenger_high
    t = spark.createDataFrame([(1, 0.5), (0, 0.7), (None, None), (1, 0.9)], "flag int, share double")
    got = {r.metric: r for r in ex.uncertainty({"flag": (t, "flag")}, {"share": (t, "share")}).collect()}
    assert (got["flag"].total, got["flag"].successes) == (3, 2) and got["share"].total == 3 and got["share"].rate == pytest.approx(0.7)
    assert 0.5 <= got["share"].low <= 0.7 <= got["share"].high <= 0.9


def test_selectors_exams_and_assets(spark):
    q = spark.createDataFrame([(1, "p", [["six"]]), (2, "p", [["none"]])], "qid long, profile string, expected_answer_groups array<array<string>>")
    told = {n: spark.createDataFrame(rows, "qid long, answer string, used_evidence_ids array<string>") for n, rows in (("a", [(1, "six Gy", ["E1"])]), ("b", [(1, "x", []), (2, "None", ["E1"])]))}
    got = {(r.selector, r.qid): (r.answer_hit, r.citation_present) for r in ex.selector_details(q, told).collect()}
    assert got == {("a", 1): (True, True), ("a", 2): (False, False), ("b", 1): (False, False), ("b", 2): (True, True)}
    evidence = spark.createDataFrame([(1, 1, "d", "T", "S", "U", 2, 3, "c", "the photon beam")], "qid long, rank int, doc_id string, title string, section string, subsection string, page_start int, page_end int, citation string, text string")
    options = spark.createDataFrame([(1, "which", "A", "proton"), (1, "which", "B", "photon"), (2, "what", "A", "x"), (2, "what", "B", "y")], "qid long, question string, label string, option string")
    gold = spark.createDataFrame([(1, "B"), (2, "B")], "qid long, gold_label string")
    rows = {r.qid: r for r in ex.exam(options, gold, evidence).collect()}
    assert (rows[1].chosen, rows[1].correct, rows[1].evidence_has_gold, rows[1].citation_present) == ("B", True, True, True)
    assert (rows[2].chosen, rows[2].correct, rows[2].evidence_has_gold, rows[2].citation_present) == ("A", False, False, False)
    asked = spark.createDataFrame([(1, "d", 4, 1, "t1", "table"), (2, "d", 4, 1, "t1", "table")], "qid long, doc_id string, page int, window int, asset_id string, asset_type string")
    near = spark.createDataFrame([(1, 1, "t2", "table"), (1, 6, "t1", "table")], "qid long, rank int, asset_id string, asset_type string")
    assert {r.qid: (r.doc_hit, r.page_hit, r.asset_hit, r.type_hit) for r in ex.asset_details(asked, evidence, near).collect()} == {1: (True, True, False, True), 2: (False, False, False, False)}


def test_runs_are_compared(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, True)], "qid long, correct boolean")
    b = spark.createDataFrame([(1, True), (2, True), (3, False)], "qid long, correct boolean")
    assert {r.outcome: r.n for r in ex.outcome_changes(a, b).collect()} == {"improved": 1, "regressed": 1, "both": 1, "neither": 0}
    with pytest.raises(ValueError, match="different questions"):
        ex.outcome_changes(a, b.limit(2))
    old = ex.snapshot({"chunks": a, "tables": b.limit(1)})
    value = spark.createDataFrame([("rate", 0.5)], "name string, value double")
    got = {(r.kind, r.name): (r.old, r.new, r.delta) for r in ex.compare_runs(old, ex.snapshot({"chunks": b.limit(1)}), value, value.limit(0)).collect()}
    assert got == {("artifact", "chunks"): (3, 1, -2), ("artifact", "tables"): (1, 0, -1), ("metric", "rate"): (0.5, None, None)}


def test_element_text_is_depth_first(spark):
    nested = {"kids": [{"content": " one "}, {"kids": [{"content": ""}, {"kids": [{"content": "two"}, {"x": 1}]}]}, {"content": "three", "kids": [{"content": "hidden"}]}]}
    rows = spark.createDataFrame([(json.dumps(nested),), (json.dumps({"content": "own", "kids": [{"content": "no"}]}),), ("{}",)], "j string")
    found = element_texts(rows.withColumn("v", F.parse_json("j")), "j", "v").collect()
    assert sorted((r.text, r.n_parts, r.depth) for r in found) == [("", 0, 0), ("one two three", 3, 3), ("own", 1, 0)]


def test_documents_are_added_with_a_row_an_input(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("b.pdf", "a.PDF", "c.txt"):
        (folder / name).write_bytes(b"%PDF-x")
    got = files.add_documents(spark, [str(folder), str(folder / "c.txt"), f"{tmp_path}/none.pdf"], f"{tmp_path}/out").collect()
    assert [r.problem for r in got] == [None, None, "only .pdf files are supported", "file does not exist"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a.PDF", "b.pdf"]
    assert len(files.init_workspace(spark, f"{tmp_path}/w")) == 7 and (tmp_path / "w" / "navigator").is_dir()
    files.write_json(spark.createDataFrame([("é", 1)], "a string, b int"), f"{tmp_path}/s.json")
    assert (tmp_path / "s.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    with pytest.raises(ValueError, match="one row"):
        files.write_json(spark.range(2), f"{tmp_path}/s.json")


def test_markdown_files_hold_a_document_in_order(spark, tmp_path):
    chunks = spark.createDataFrame([("d", "T", 3, 3, "c2", "b\n b"), ("d", "T", 1, 2, "c9", "a"), ("e", "U", 1, 1, "c1", "x")], "doc_id string, title string, page_start int, page_end int, chunk_id string, text string")
    files.write_markdown(chunks, f"{tmp_path}/md")
    text = "".join(p.read_text() for p in sorted((tmp_path / "md" / "doc_id=d").glob("*.txt")))
    assert text == "# T\n- [c9; pp. 1-2] a\n- [c2; p. 3] b b\n"


def test_generated_targets_and_tasks(spark):
    groups = "array<array<string>>"
    external = spark.createDataFrame([(1, "E?", [["x"]])], f"pos int, question string, groups {groups}")
    targets = spark.createDataFrame([(2, "d2", "B?", [["y"]]), (1, "d1", "A?", [["z"]])], f"pos int, doc_id string, question string, groups {groups}")
    catalog = spark.createDataFrame([("d1", "http://d1")], "doc_id string, source_url string")
    got = [(r.qid, r.question, r.expected_doc_ids, r.source_urls, r.expected_abstain) for r in gn.gold_targets(external, targets, catalog).orderBy("qid").collect()]
    assert got == [("gold_q0001", "E?", [], [], False), ("gold_q0002", "A?", ["d1"], ["http://d1"], False), ("gold_q0003", "B?", ["d2"], [""], False)]
    inside = spark.createDataFrame([(1, "t", "answer", "Q?", ["d1"], True)], "pos int, task string, mode string, question string, expected_doc_ids array<string>, expected_bundle_prompt boolean")
    outside = spark.createDataFrame([(1, "o", "answer", "R?")], "pos int, task string, mode string, question string")
    got = {r.qid: (r.expected_abstain, r.expected_citations, r.expected_bundle_prompt, r.profile) for r in gn.agent_tasks(inside, outside).collect()}
    assert got == {"agent_task_q0001": (False, True, True, "agent_task"), "agent_task_q0002": (True, None, None, "agent_task_hard_ood")}
