"""The saved index, the scan and shared-token search against scoring everything; streams that are run again."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators import evidence as ev
from lodestar.operators import retrieve as rt
from lodestar.operators import scan, segments
from lodestar.sources.shared import CommitLog
from lodestar.streaming import events as st
from lodestar.streaming import index_append

WORDS = ["the", "of", "dose", "beam", "été", "plan", *(f"w{i}" for i in range(40))]


def text_of(rng):
    return " ".join(rng.choices(WORDS, weights=[40, 30, 5, 5, 3, 3, *[1] * 40], k=rng.randrange(1, 60)))


def chunks_of(spark, rows):
    return spark.createDataFrame([(f"c{i}", i, f"d{i % 4}", t) for i, t in rows], "chunk_id string, corpus_pos long, doc_id string, text string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    return {i: text_of(rng) for i in range(300)} | {300: "", 301: None, 302: "the the the"}


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(12)
    return spark.createDataFrame([*((i, text_of(rng), "d1" if i % 3 == 0 else None) for i in range(12)), (20, "nothing known here", None), (21, "", "d1"), (22, "the", "d9"), (23, None, None)], "qid long, question string, report_id string")


def everything(spark, questions, rows, k):
    """All pairs, by joining postings."""
    chunks = chunks_of(spark, rows)
    length = rt.lengths(chunks, "text", "doc_id", "corpus_pos")
    return found(rt.best(k, "score")(rt.bm25(questions, rt.postings(chunks, "text"), length)))


def found(hits):
    return sorted((r.qid, r["rank"], r.chunk_id, r.doc_id, r.corpus_pos, round(r.score, 5)) for r in hits.collect())


def test_scan_is_what_joining_postings_gives(spark, corpus, questions, monkeypatch):
    chunks = chunks_of(spark, corpus.items()).repartition(5)
    assert found(scan.bm25_scan(questions, chunks, "text", 7)) == everything(spark, questions, corpus.items(), 7)
    inside = {(q, c) for q, _, c, *_ in found(scan.bm25_scan(questions, chunks, "text", 400, inside=True))}
    of = {r.qid: r.report_id for r in questions.collect()}
    assert inside == {(q, c) for q, _, c, d, *_ in everything(spark, questions, corpus.items(), 400) if of[q] in (None, d)}
    monkeypatch.setattr(scan, "BLOCK_TERMS", 20)
    monkeypatch.setattr(scan, "CELLS", 8)
    assert found(scan.bm25_scan(questions, chunks, "text", 7)) == everything(spark, questions, corpus.items(), 7)
    monkeypatch.setattr(scan, "VOCABULARY", 3)
    assert scan.bm25_scan(questions, chunks, "text", 7) is None
    assert found(rt.bm25_search(questions, chunks, "text", 7)) == everything(spark, questions, corpus.items(), 7)
    assert found(scan.bm25_scan(questions.where("qid = 21"), chunks, "text")) == []


def test_index_with_changes_is_one_of_what_is_left(spark, corpus, questions, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "RANGE", 16)
    monkeypatch.setattr(segments, "SEED_POSTINGS", 30)
    index = segments.SegmentIndex(spark, f"{tmp_path}/index")
    assert found(index.search(questions)) == []
    keyed = lambda rows: chunks_of(spark, rows).withColumn("key", F.concat(F.lit("k"), F.floor(F.col("corpus_pos") / 3).cast("string")))
    live = dict(corpus)
    assert index.apply("a", keyed(live.items()))
    assert not index.apply("a", keyed([(1, "again")]))
    assert found(index.search(questions, 5)) == everything(spark, questions, live.items(), 5)
    changed = {i: "dose beam plan w1 " + str(i) for i in range(30, 60)} | {900: "a new dose", 901: "the"}
    assert index.apply("b", keyed(changed.items()), spark.createDataFrame([("k5",), ("k99",), (None,), ("unknown",)], "key string"))
    for i in [15, 16, 17, 297, 298, 299]:
        live.pop(i)
    live |= changed
    assert index.apply("c", deletes=spark.createDataFrame([("k300",)], "key string"))
    live = {i: t for i, t in live.items() if i // 3 != 300}
    assert index.apply("d", keyed([(15, "dose dose"), (31, "only one of three")]))  # a key's other chunks go with it
    live = {i: t for i, t in live.items() if i // 3 != 10} | {15: "dose dose", 31: "only one of three"}
    want = everything(spark, questions, live.items(), 5)
    assert found(index.search(questions, 5)) == want
    lengths = {r.corpus_pos: r.dl for r in index.lengths().collect()}
    assert set(lengths) == set(live) and index.statistics() == (len(live), pytest.approx(sum(lengths.values()) / len(live)))
    df = Counter(t for x in live.values() for t in set((x or "").split()))
    assert {r.token: r.df for r in index.frequencies().collect()} == dict(df)
    assert index.compact("e") and not index.compact("e")
    assert found(index.search(questions, 5)) == want and not index.apply("a", keyed([(1, "again")]))
    assert index.apply("f", deletes=spark.createDataFrame([("k0",)], "key string"))
    live = {i: t for i, t in live.items() if i > 2}
    assert found(index.search(questions, 5)) == everything(spark, questions, live.items(), 5)
    counts = index.scored(questions, 5).first()
    assert counts.hits <= counts.looked_up <= counts.partial <= counts.sharing


def test_a_failed_attempt_leaves_no_trace(spark, tmp_path, corpus, questions, monkeypatch):
    index = segments.SegmentIndex(spark, f"{tmp_path}/index")
    rows = chunks_of(spark, corpus.items()).withColumn("key", F.col("chunk_id"))
    monkeypatch.setattr(CommitLog, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        index.apply("a", rows)
    monkeypatch.undo()
    assert index.lengths().count() == 0 and index.apply("a", rows) and index.lengths().count() == len(corpus)
    assert found(index.search(questions, 3)) == everything(spark, questions, corpus.items(), 3)


def test_most_shared_tokens(spark):
    rng = random.Random(4)
    tokens = ["all", *(f"t{i}" for i in range(8))]
    asked = {(q, "g", t) for q in range(30) for t in rng.sample(tokens, rng.randrange(1, 6))} | {(99, "g", "unknown"), (98, "h", "t1")}
    have = {("g", i, t) for i in range(60) for t in ["all", *rng.sample(tokens[1:], rng.randrange(4))]} | {("h", 5, "t1"), ("h", 7, "t2")}
    got = ev.most_shared(spark.createDataFrame(list(asked), "qid int, g string, token string"), spark.createDataFrame(list(have), "g string, id int, token string"), ["g"])
    count = defaultdict(Counter)
    for q, g, t in asked:
        for h, i, u in have:
            if (g, t) == (h, u):
                count[q][i] += 1
    want = {(q, i, n) for q, c in count.items() for i, n in c.items() if n == max(c.values())}
    assert {tuple(r) for r in got.collect()} == want


def test_streams_go_on_from_their_checkpoint(spark, tmp_path):
    start = datetime(2024, 1, 1)
    folder = f"file:{tmp_path}"
    rows = lambda hours: spark.createDataFrame([("u", start + timedelta(hours=h)) for h in hours] + [(None, start)], "user string, ts timestamp")
    run = lambda: st.drained(st.first_seen(spark.readStream.schema("user string, ts timestamp").parquet(f"{folder}/in"), "user", timedelta(hours=6)), folder, "out", rocks=True)
    rows([0, 1, 9]).write.parquet(f"{folder}/in")
    assert run().count() == 2
    rows([10, 16.5]).write.mode("append").parquet(f"{folder}/in")
    rows([40]).write.mode("append").parquet(f"{folder}/in")
    assert sorted((r.ts - start).total_seconds() / 3600 for r in run().collect()) == [0, 9, 16.5, 40]


def test_stream_replaces_documents_in_the_index(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    source, index = f"{tmp_path}/in", f"{tmp_path}/index"
    for batch in ({1: "dose beam", 2: "dose"}, {1: "plan only", 3: "beam"}):
        rows = [(i, t, "en", "s", len(t)) for i, t in batch.items()]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        index_append.follow_segments(spark, source, schema, index, f"{tmp_path}/cp").awaitTermination()
    asked = spark.createDataFrame([(1, "dose beam plan")], "qid long, question string")
    live = segments.SegmentIndex(spark, index)
    assert {r.chunk_id for r in live.search(asked).collect()} == {"c1", "c2", "c3"}
    assert {r.token: r.df for r in live.frequencies().collect()} == {"dose": 1, "beam": 1, "plan": 1, "only": 1}
