"""What round 3's findings were about."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions import predicates as pr
from lodestar.functions import text as tx
from lodestar.operators import evidence as ev
from lodestar.operators import held as held_
from lodestar.operators import nested
from lodestar.operators import rerank as rr
from lodestar.operators import retrieve as rt
from lodestar.operators import segments
from lodestar.operators.held import Held, runs
from lodestar.plans import catalog
from lodestar.sources import adapters

CORPUS = ["dose dose beam", "beam plan", "audit plan plan dose", "beam", None, "other words"]


def corpus(spark):
    return spark.createDataFrame([(f"c{i}", "d", i, t) for i, t in enumerate(CORPUS)], "chunk_id string, doc_id string, corpus_pos long, text string")


def ask(spark):
    return spark.createDataFrame([(1, "beam plan"), (2, "dose audit dose"), (3, "none")], "qid long, question string")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "chunk_id", "score", "rank").collect())


@pytest.mark.parametrize("split", [tx.sentences, tx.answer_sentences])
def test_sentences_keep_the_digits_of_their_own_number(spark, split):
    """trimming was given the sentence's index as the characters to trim."""
    got = spark.range(1).select(split(F.lit("0 a. 1st 11. 20 mm2. 33 3")).alias("x")).first().x
    assert got == ["0 a.", "1st 11.", "20 mm2.", "33 3"]


def test_held_rows_are_the_first_k_and_copies_do_not_pile_up():
    """What a task holds is bounded by k a question, whatever the scores."""
    rng, k, n = np.random.default_rng(7), 3, 5
    scores = np.round(rng.random((4000, n)), 2)
    scores[1000:3000] = 0.99  # copies
    held = Held(k, n, 1e-6)
    held.limit = 100
    for at in range(0, 4000, 250):
        part = np.arange(at, at + 250)
        held.put(scores[part], pa.record_batch({"pos": pa.array(part)}), part)
    assert held.limit == 100 and held.n <= 100
    got = {q: [] for q in range(n)}
    for q, score, batch in held.found():
        for a, s, p in zip(q, score, batch.column("pos").to_pylist(), strict=True):
            got[a].append((-s, p))
    want = {q: sorted(zip(-scores[:, q], range(4000), strict=True))[:k] for q in range(n)}
    assert {q: sorted(x)[:k] for q, x in got.items()} == want


def test_held_rows_without_an_entry_go(monkeypatch):
    """A task kept the ids of all its rows, which grew with the input."""
    monkeypatch.setattr(held_, "SPARE_ROWS", 500)
    rng, k, n = np.random.default_rng(8), 3, 5
    scores = np.where(rng.random((20_000, n)) < 0.3, -np.inf, np.round(rng.random((20_000, n)), 2))
    scores[:2000] = -np.inf  # no entry at all when rows go for the first time
    held, most = Held(k, n, 1e-6), 0
    for at in range(0, 20_000, 250):
        part = np.arange(at, at + 250)
        held.put(scores[part], pa.record_batch({"pos": pa.array(part)}), part)
        most = max(most, sum(r.num_rows for r in held.rows))
    assert most < 1000
    got = {q: [] for q in range(n)}
    for q, score, batch in held.found():
        for a, s, p in zip(q, score, batch.column("pos").to_pylist(), strict=True):
            got[a].append((-s, p))
    assert {q: sorted(x)[:k] for q, x in got.items()} == {q: sorted(zip(-scores[:, q], range(20_000), strict=True))[:k] for q in range(n)}


def test_deep_elements_take_few_rounds(spark, monkeypatch):
    """every level of the deepest page was written and counted by jobs of its own."""
    node = {"content": "end"}
    for i in range(60):
        node = {"kids": [{"content": f"a{i}"}, {"kids": []}, node]}
    made, rounds = nested.saved, []
    monkeypatch.setattr(nested, "saved", lambda df, folder, name: rounds.append(name) or made(df, folder, name))
    rows = spark.createDataFrame([(json.dumps(node),)], "j string")
    got = nested.element_texts(rows.select(F.lit(1).alias("k"), F.parse_json("j").alias("v")), "k", "v").first()
    assert (got.text, got.n_parts, got.depth) == (" ".join(f"a{i}" for i in reversed(range(60))) + " end", 61, 60)
    assert len(rounds) <= 6


def test_backends_share_one_search(spark, monkeypatch):
    """the ablation's sparse and hybrid backends each searched all chunks, and chunks without a hit were read word by word."""
    search, documents, n = rt.bm25_search, adapters.document_chunks, []
    monkeypatch.setattr(rt, "bm25_search", lambda *a, **k: n.append("search") or search(*a, **k))
    monkeypatch.setattr(adapters, "document_chunks", lambda d: n.append("LeftSemi" in d._jdf.queryExecution().optimizedPlan().toString()) or documents(d))
    assert catalog.REGISTRY.queries["ev_ablation"](spark, "/root/testdata/sf0.001").count() == 6
    assert n == ["search", False, True] or n == [False, "search", True]


def test_runs_bound_the_cost_of_a_slice():
    assert list(runs(np.array([1, 1, 9, 2, 0, 2, 1]), 4, 3)) == [(0, 2), (2, 1), (3, 3), (6, 1)]
    assert list(runs(np.zeros(0), 4, 3)) == []


def test_okapi_ranks_in_the_tasks(spark, monkeypatch):
    """the okapi variant joined all postings with the questions."""
    chunks, asked = corpus(spark), ask(spark)
    want = rows(rt.best(3, "score")(rt.bm25(asked, rt.postings(chunks, "text"), rt.lengths(chunks, "text", "doc_id", "corpus_pos"), variant="okapi")))
    monkeypatch.setattr(rt, "postings", None)
    got = rows(rt.bm25_search(asked, chunks, "text", 3, variant="okapi"))
    assert got == want and any(r[2] <= 0 for r in got) == any(r[2] <= 0 for r in want)


def test_hashed_search_makes_vectors_in_the_task(spark, monkeypatch):
    """the corpus' buckets were exchanged by (chunk, bucket) and gathered again."""
    chunks, asked = corpus(spark), ask(spark)
    vectors = rt.hash_vectors(chunks, "text").join(chunks.select("chunk_id", "doc_id", "corpus_pos"), "chunk_id")
    want = rows(rt.dense_search(rt.hash_vectors(asked, "question", id_col="qid").withColumnRenamed("embedding", "query"), vectors, 3, tie="corpus_pos").where("score > 0"))
    made, of = rt.hash_embedding, []
    monkeypatch.setattr(rt, "hash_embedding", lambda rows_, *a, **k: of.append(rows_.columns) or made(rows_, *a, **k))
    assert rows(rt.hash_dense_search(asked, chunks, "text", 3)) == want
    assert of == [asked.columns]


def test_heuristics_read_a_text_once_a_chunk(spark):
    """F1: both scores normalised and searched a chunk's text again for every pair; facts give the same scores."""
    said = ["What is nontarget dose according to TG-158?", "Define output factor", "Which section covers beams?", "Compare HDR and LDR", "tg 158 dose", ""]
    asked = spark.createDataFrame(list(enumerate(said)), "qid long, question string")
    texts = [" FIG. 1 Contents ... 12", "Nontarget dose  refers to dose outside. Photons.", "An output factor is defined as a ratio. We compare.", None, "summary of electron beams"]
    heads = ["REFERENCES", "1. INTRODUCTION", "8. RECOMMENDATIONS", None, "4. MEASUREMENT"]
    kinds = ["standard", "definition_microchunk", None, "standard", "standard"]
    schema = "chunk_id string, doc_id string, title string, source_path string, section string, subsection string, text string, tags array<string>, chunk_kind string, page_start int, token_count int"
    chunks = spark.createDataFrame([(f"c{i}", "d", "Nontarget dose", ("tg-158.pdf", None)[i % 2], h, "UNKNOWN", t, (["definition"], None)[i % 2], k, i, 400 * i) for i, (t, h, k) in enumerate(zip(texts, heads, kinds, strict=True))], schema)
    pairs = asked.select("qid").crossJoin(chunks.select("chunk_id"))
    inline = chunks.crossJoin(asked).select("qid", "chunk_id", F.round(pr.chunk_bonus(F.col("question")), 6).alias("bonus"), F.round(pr.rerank_adjustment(F.col("question")), 6).alias("adjustment"))
    got = sorted(map(tuple, rr.heuristic_scores(pairs, asked, chunks).collect()))
    assert got == sorted(map(tuple, inline.collect())) and len({r[2:] for r in got}) > 8


def test_postings_are_counted_in_their_rows(monkeypatch):
    """postings were exchanged to be counted, again to be put in blocks, and a third time to be sorted."""
    monkeypatch.setattr(segments, "TOKENS", 5)
    tokens = [["a", "b", "a"], [], None, ["b"], ["c"] * 9 + ["a"]]
    batch = pa.record_batch({"p": pa.array([7, 8, 9, 10, 11], pa.int64()), "t": pa.array(tokens, pa.list_(pa.string()))})
    got = sorted(tuple(r.values()) for out in segments._counted([batch]) for r in out.to_pylist())
    assert got == sorted((t, 7 + i, len(x), n) for i, x in enumerate(tokens) if x for t, n in Counter(x).items())


def test_most_shared_gathers_no_question(spark):
    """a question's matches went through one task's window."""
    have = spark.createDataFrame([(1, f"p{i}", t) for i in range(40) for t in ("www", "site", f"n{i % 4}")], "all int, id string, token string")
    asked = spark.createDataFrame([(1, 1, t) for t in ("www", "n3", "no")] + [(2, 1, "no")], "qid long, all int, token string")
    got = ev.most_shared(asked, have, ["all"])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((1, f"p{i}", 2) for i in range(3, 40, 4))
