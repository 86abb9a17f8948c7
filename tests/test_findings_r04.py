"""What round 4's findings were about."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.functions import predicates as pr
from lodestar.functions import rules
from lodestar.functions import text as tx
from lodestar.operators import held as held_
from lodestar.operators import scan
from lodestar.operators.held import Held
from lodestar.plans import catalog

TEXTS = [None, "", " ", " a", "a ", "a\n", "\na", "a\r", "a\r\n", "\r", "\t", "\x01", '"', '""', ' "a" ', "a, b ", "\\", '\\"', "plain"]


def test_csv_keeps_empty_texts_and_white_space_at_the_ends(spark, tmp_path):
    docs = [(i, t, s) for i, (t, s) in enumerate([*((t, "s") for t in TEXTS), *(("t", s) for s in TEXTS)])]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.REGISTRY.queries["src_csv"](spark, str(tmp_path)).collect()
    want = {(str(i), s, t if t is None else hashlib.md5(t.encode()).hexdigest(), t if t is None else len(t)) for i, t, s in docs}
    assert len(got) == len(docs) and {tuple(r) for r in got} == want


def test_common_tokens_are_left_to_a_matrix_product_and_give_the_same_hits(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*rng.choice(words, 6), "the", "of"]) if i % 9 else None for i in range(300)]
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 3}", i, t) for i, t in enumerate(texts)], "chunk_id string, doc_id string, corpus_pos long, text string")
    asked = spark.createDataFrame([(i, " ".join([*rng.choice(words, 3), "the", "of the"]), f"d{i % 4}" if i % 2 else None) for i in range(25)] + [(99, "none", None)], "qid long, question string, report_id string")
    left, of = [], scan._score

    def score(block, *how):
        left.append(len(block.value[4]))
        return of(block, *how)

    monkeypatch.setattr(scan, "_score", score)
    for how in ({}, {"inside": True}, {"variant": "okapi"}):
        got = []
        for common in (0, 2, 200):
            monkeypatch.setattr(scan, "COMMON", common)
            got.append(sorted(map(tuple, scan.bm25_scan(asked, chunks, "text", 7, **how).collect())))
        assert got[0] == got[1] == got[2] and len(got[0]) > 100
        assert left[-3] == 0 and left[-2] == 2 and left[-1] > 2


def test_held_thins_out_by_plain_sorts_and_keeps_the_first(monkeypatch):
    monkeypatch.setattr(held_, "SLACK", 50)
    dropped, whole = [], Held._drop
    monkeypatch.setattr(Held, "_drop", lambda self, place: dropped.append(len(place)) or whole(self, place))
    for seed in range(3):
        dropped.clear()
        rng, k, n = np.random.default_rng(seed), 4, 6
        scores = rng.random((3000, n)) * 40 - (20 if seed else 0)
        scores[rng.random(scores.shape) < 0.2] = 0.0
        held, want = Held(k, n, 1e-6, 0.0), []
        for at in range(0, 3000, 30):
            held.put(scores[at : at + 30], pa.record_batch({"i": pa.array(range(at, at + 30))}), np.arange(at, at + 30))
        assert len(dropped) <= 3
        got = [(int(q), float(s), i) for qs, ss, rows in held.found() for q, s, i in zip(qs, ss, rows.column("i").to_pylist(), strict=True)]
        for q in range(n):
            first = sorted((-s, i) for i, s in enumerate(scores[:, q]) if s > 0)[:k]
            want += [(q, -s, i) for s, i in first]
        assert set(want) <= set(got) and len(got) <= 2 * len(want)


def test_phrases_are_looked_for_before_patterns(spark):
    texts = ["It Is Defined As x. Y refers TO z", "is  defined as", "misrefers to", "refers tok", "İs defined as \u212a", "REFERS TO", "", None, "A. B is referred to as C. Then d", "can be subdivided into\u00a0parts; this refers\nto it. New"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = [rf"\b{c}\b" for c in rules.DEFINITION_CUES]
    by_pattern = F.transform(F.filter(tx.sentences("text"), lambda s: pr.any_match(s, pattern)), lambda s: F.lower(s))
    got = df.select(pr.any_phrase(F.col("text"), rules.DEFINITION_CUES), pr.any_match(F.col("text"), pattern), pr.cued_sentences(F.col("text")), by_pattern, pr.any_phrase(F.col("text"), ["re(fers|x) to"]), pr.any_match(F.col("text"), [r"\bre(fers|x) to\b"])).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in got) and any(r[2] for r in got)
