"""Operators against loops, golden values and properties on small tables."""

from __future__ import annotations

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestar.engine import Engine
from lodestar.functions import predicates as pr
from lodestar.functions import text as tx
from lodestar.operators import answers as an
from lodestar.operators import audit as au
from lodestar.operators import chunking as ck
from lodestar.operators import evaluate as el
from lodestar.operators import evidence as ev
from lodestar.operators import generators as gn
from lodestar.operators import ingest as ig
from lodestar.operators import rerank as rr
from lodestar.operators import retrieve as rt
from lodestar.operators import routing
from lodestar.operators import stats as st
from lodestar.sources import files
from lodestar.streaming import index_append

CORPUS = ["dose dose beam", "beam plan", "audit plan plan dose"]
CHUNK = "chunk_id string, doc_id string, title string, section string, subsection string, page_start int, page_end int, text string, token_count int, tags array<string>, chunk_kind string, parent_chunk_id string, source_path string, corpus_pos long"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def chunk(i, text, doc="d", title="t", section="S", page=1, end=None, tags=(), kind="standard"):
    return (f"{doc}_c{i:04d}", doc, title, section, "UNKNOWN", page, end or page, text, len(text.split()), list(tags), kind, None, None, i)


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def ask(spark, *texts):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "qid long, question string")


# --- scalar functions ---------------------------------------------------------


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: tx.token_count(F.lit("This is a short sentence.")), 5),
        (lambda: tx.normalize_ws(F.lit("a­b –\tc—d ﬁn ﬂy ")), "ab - c-d fin fly"),
        (lambda: tx.sentences(F.lit("One. Two? three. \"No\" (4) it. 5 end")), ["One.", "Two? three.", "\"No\" (4) it.", "5 end"]),
        (lambda: tx.answer_sentences(F.lit("a b; C d. e f; g")), ["a b;", "C d.", "e f; g"]),
        (lambda: tx.slug(F.lit("TG-100: Report (2016)")), "tg_100_report_2016"),
        (lambda: tx.report_cues(F.lit("Compare AAPM TG 100, TG-142, IAEA TRS 398, and TECDOC1540.")), ["tecdoc:1540", "tg:100", "tg:142", "trs:398"]),
        (lambda: tx.query_focus(F.lit("What is nontarget dose according to TG 158?")), "nontarget dose"),
        (lambda: tx.query_focus(F.lit("Define  Output Factor?")), "output factor"),
        (lambda: tx.query_focus(F.lit("Compare")), None),
        (lambda: tx.requested_page(F.lit("figure on page 14")), 14),
        (lambda: tx.requested_page(F.lit("page")), None),
        (lambda: tx.page_range(F.lit(4), F.lit(5)), "pp. 4-5"),
        (lambda: tx.citation(F.lit("E1"), F.lit("Doc"), F.lit("UNKNOWN"), F.lit("p. 1"), F.lit("c")), "[E1] Doc; section unknown; p. 1; chunk c"),
        (lambda: tx.safe_int(F.lit("x"), 7), 7),
        (lambda: tx.safe_bbox(F.array(F.lit("1"), F.lit("2"), F.lit("3"))), None),
        (lambda: tx.claim_text(F.lit("Said.\n\nSupporting evidence excerpts:\nyou should")), "Said."),
        (lambda: tx.phrase(F.lit(" The  Dose. ")), "the Dose"),
        (lambda: tx.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))), [0.6, 0.8]),
        (lambda: tx.l2_normalize(F.array(F.lit(0.0))), [0.0]),
        (lambda: tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), 0.5),
        (lambda: tx.group_hit(F.lit("5–6 Gy"), F.array(F.array(F.lit("5-6"), F.lit("x")))), True),
        (lambda: tx.group_hit(F.lit("a"), F.array().cast("array<array<string>>"), empty=False), False),
        (lambda: F.size(tx.tokens(F.lit(None).cast("string"))), 0),
        (lambda: F.round(tx.enumeration_bonus(F.lit("List the tests"), F.lit("These are QA, QC, and MLC tests"), r"(?i)\blist\b.*\btests\b"), 6), 0.20),
        (lambda: tx.enumeration_bonus(F.lit("Who?"), F.lit("a, b, c"), r"(?i)\blist\b"), 0.0),
        (lambda: tx.front_matter_field(F.lit("---\nname: x\nlevel: 1\n---\nbody"), "level"), "1"),
        (lambda: F.try_variant_get(tx.json_object(F.lit('noise {"answer": "yes"} more')), "$.answer", "string"), "yes"),
        (lambda: pr.out_of_scope(F.lit("Should my mother choose surgery?")), True),
        (lambda: pr.out_of_scope(F.lit("Best bread recipe")), True),
        (lambda: pr.out_of_scope(F.lit("Monthly QA of a linac")), False),
        (lambda: pr.asset_query(F.lit("image-guided radiotherapy")), False),
        (lambda: pr.asset_query(F.lit("the detected image")), True),
        (lambda: pr.query_type(F.lit("Which section is it?")), "section_locator"),
        (lambda: pr.overclaims(F.lit("You should start now")), True),
        (lambda: pr.report_match(F.lit("TG 100 risk"), F.lit("tg_100 Risk analysis")) > 0.35, True),
        (lambda: pr.report_match(F.lit("TG 100"), F.lit("tg_142")) < 0, True),
    ],
)
def test_scalar_values(spark, column, want):
    got = one(spark, column())
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_table_preview(spark):
    df = spark.createDataFrame([([(["a ", "", "b"],), ([""],), (["c"],)],)], "rows array<struct<cells:array<string>>>")
    assert df.select(tx.table_preview(F.col("rows"))).first()[0] == "a | b || c"
    assert df.select(tx.table_preview(F.col("rows"), 4)).first()[0] == "a |..."


def test_rerank_adjustment_prefers_definitions(spark):
    rows = chunks(
        spark,
        chunk(1, "This report provides recommendations for dose.", section="8. RECOMMENDATIONS", tags=["recommendation"]),
        chunk(2, "The dose outside the PTV is referred to as nontarget dose.", section="1. INTRODUCTION", kind="definition_microchunk", tags=["definition"]),
    ).withColumn("question", F.lit("Define nontarget dose."))
    got = [r[0] for r in rows.orderBy("corpus_pos").select(pr.rerank_adjustment(F.col("question"))).collect()]
    assert got[0] < 0 < got[1]
    bonus = [r[0] for r in rows.orderBy("corpus_pos").select(pr.chunk_bonus(F.col("question"))).collect()]
    assert bonus[1] == pytest.approx(0.18 + 0.22 + 0.18 + 0.06 + 0.10 + 0.24)


# --- retrieval ----------------------------------------------------------------


def corpus(spark):
    return chunks(spark, *(chunk(i, t) for i, t in enumerate(CORPUS)))


def test_bm25_golden_values(spark):
    c = corpus(spark)
    length = rt.lengths(c, "text", "doc_id", "corpus_pos")
    for query, want in (("dose beam", [1.141437, 0.552945, 0.408699]), ("dose dose", [1.342868, None, 0.817398])):
        got = {r.corpus_pos: r.score for r in rt.bm25(ask(spark, query), rt.postings(c, "text"), length).collect()}
        assert [got.get(i) for i in range(3)] == [pytest.approx(w, abs=2e-6) if w else None for w in want]
    idf = {r.token: r.x for r in rt.document_frequencies(rt.postings(c, "text")).select("token", rt.idf(F.lit(3), F.col("df")).alias("x")).collect()}
    assert idf["dose"] == pytest.approx(0.470004, abs=1e-6) and idf["audit"] == pytest.approx(0.980829, abs=1e-6)
    padded = rt.fill_zero(rt.bm25_search(ask(spark, "dose dose"), c, "text"), ask(spark, "dose dose"), c, 3).orderBy("rank").collect()
    assert [(r.corpus_pos, r.score > 0) for r in padded] == [(0, True), (2, True), (1, False)]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, chunk_id string, corpus_pos long, score double, rank int")


def test_rrf_golden_values_and_symmetry(spark):
    a = ranked(spark, [(1, "x", 0, 3.0, 1), (1, "y", 1, 2.0, 2), (1, "z", 2, 1.0, 3)])
    b = ranked(spark, [(1, "x", 0, 9.0, 1), (1, "w", 3, 7.0, 2), (1, "y", 1, 1.0, 1)])
    got = {r.chunk_id: r.fusion_score for r in rt.rrf(a, b).collect()}
    assert got == {r.chunk_id: r.fusion_score for r in rt.rrf(b, a).collect()}
    assert got["x"] == pytest.approx(0.032787, abs=1e-6) and got["y"] == pytest.approx(0.032522, abs=1e-6) and got["z"] == pytest.approx(0.015873, abs=1e-6)


def test_hash_embedding_is_unit_and_by_crc32(spark):
    rows = rt.hash_embedding(corpus(spark), "text", 64).where("chunk_id = 'd_c0000'").collect()
    assert {r.d for r in rows} == {zlib.crc32(w) % 64 for w in (b"dose", b"beam")}
    assert sum(r.x**2 for r in rows) == pytest.approx(1)
    best = rt.hash_dense_search(ask(spark, "beam plan"), corpus(spark), "text", 1).first()
    assert best.chunk_id == "d_c0001" and best.score == pytest.approx(1)


@pytest.mark.parametrize("block", [4_096, 2])
def test_dense_blocks_agree(spark, block):
    rng = random.Random(1)
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(40)], "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id < 5").selectExpr("chunk_id AS qid", "embedding AS query")
    got = sorted(tuple(r) for r in rt.dense_search(queries, vectors.repartition(3), 3, block=block).select("qid", "rank", "chunk_id").collect())
    rows = {r.chunk_id: r.embedding for r in vectors.collect()}
    want = [(q, n + 1, c) for q in range(5) for n, c in enumerate(sorted(rows, key=lambda c: (-round(sum(x * y for x, y in zip(rows[q], rows[c], strict=True)), 6), c))[:3])]
    assert got == want
    odd = vectors.unionAll(spark.createDataFrame([(90, None), (91, [1.0]), (92, [9.0, 9.0, 9.0, float("nan")])], "chunk_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in rt.dense_search(queries, odd, 3, block=block).select("qid", "rank", "chunk_id").collect()) == want
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(3000)], "chunk_id long, embedding array<double>")  # all tie
    assert [r.chunk_id for r in rt.dense_search(same.where("chunk_id = 7").selectExpr("chunk_id AS qid", "embedding AS query"), same, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert rt.dense_search(queries.limit(0), vectors).count() == 0 and rt.dense_search(queries, vectors.limit(0)).count() == 0


def test_minmax_and_blend(spark):
    rows = chunks(spark, chunk(0, "alpha beta"), chunk(1, "alpha"), chunk(2, "none")).withColumns({"qid": F.lit(1), "question": F.lit("alpha beta"), "final_retrieval_score": F.lit(0.5), "retrieval_rank": F.col("corpus_pos") + 1})
    out = rr.rerank(rows, 2).orderBy("rank").collect()
    assert [(r.corpus_pos, r.rerank_score) for r in out] == [(0, pytest.approx(0.65 + 0.35 * 0.5)), (1, pytest.approx(0.65 * 0.5 + 0.35 * 0.5))]


def test_model_hooks(spark):
    embed = rt.model_embedding(lambda texts: [[len(t), 1.0, 2.0] for t in texts], 2)
    assert one(spark, embed(F.lit("four"))) == [4.0, 1.0]
    score = rr.model_scorer(lambda pairs: [[0.0, len(q) + len(t)] for q, t in pairs])
    assert one(spark, score(F.lit("ab"), F.lit("c"))) == 3.0
    assert an.generated(spark.createDataFrame([(1, "p")], "qid long, prompt string"), lambda ps: [p * 2 for p in ps]).first().raw == "pp"
    rt.check_index_meta(spark.createDataFrame([(4, "m")], "dimension int, model string"), dimension=4)
    with pytest.raises(ValueError, match="mismatch"):
        rt.check_index_meta(spark.createDataFrame([(4,)], "dimension int"), dimension=5)


def test_refine_keeps_all_if_too_few_would_stay(spark):
    good = chunk(0, "X is defined as y.", section="1. INTRODUCTION")
    drift = [chunk(i, "brachytherapy notes", section="9") for i in (1, 2)]
    rows = chunks(spark, good, *drift).withColumns({"qid": F.lit(1), "question": F.lit("What is x?"), "rank": F.col("corpus_pos") + 1})
    assert rr.refine(rows).count() == 3
    more = rows.unionByName(rows.where("corpus_pos = 0").withColumn("rank", F.lit(4)))
    assert sorted(r.rank for r in rr.refine(more).collect()) == [1, 2]
    assert rr.refine(rows.withColumn("question", F.lit("list")), 2).count() == 2


def test_option_scores(spark):
    options = spark.createDataFrame([(1, "which beam", "A", "dose"), (1, "which beam", "B", "plan"), (2, "q", "A", "z")], "qid long, question string, label string, option string")
    evidence = chunks(spark, chunk(0, "beam plan")).withColumn("qid", F.lit(1).cast("long"))
    got = {(r.qid, r.label): (r.score, r.rank) for r in rr.option_scores(options, evidence).collect()}
    assert got[1, "B"][1] == 1 and got[1, "A"][1] == 2 and got[2, "A"] == (0.0, 1)


# --- evidence -----------------------------------------------------------------


def test_sufficiency_rules(spark):
    evidence = chunks(spark, chunk(0, "beam output constancy")).withColumns({"rank": F.lit(1), "qid": F.explode(F.array(*map(F.lit, (1, 2, 3))))})
    q = ask(spark, "beam output dose", "how is it?", "bread recipe", "unseen words here")
    got = {r.qid: (r.sufficient, r.max_overlap) for r in ev.sufficiency(q, evidence).collect()}
    assert got == {1: (True, 0.6667), 2: (True, 1.0), 3: (False, 0.0), 4: (False, 0.0)}


def test_named_asset_page_is_injected(spark):
    c = chunks(spark, chunk(0, "intro", doc="tg_100", page=1), chunk(1, "values", doc="tg_100", page=14), chunk(2, "end", doc="tg_100", page=30))
    docs = spark.createDataFrame([("tg_100", "TG 100 risk", 0)], "doc_id string, title string, pos int")
    assets = spark.createDataFrame([("tg_100", "t1", "table", 14, "Table II severity", "6-30 Gy"), ("tg_100", "t2", "table", 30, "Table III", "")], "doc_id string, asset_id string, asset_type string, page int, caption string, text_preview string")
    q = ask(spark, "What does TG 100 Table II say on severity?")
    had = spark.createDataFrame([(1, "tg_100_c0000", 1, "tg_100")], "qid long, chunk_id string, rank int, doc_id string")
    doc = ev.infer_document(q, docs, had)
    target = ev.named_asset_targets(q, doc, assets)
    assert target.first().page == 14
    out = ev.inject(had, ev.page_neighbourhood(target, c), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.asset_page_injected) for r in out] == [("tg_100_c0001", True), ("tg_100_c0000", False)]
    paged = ev.page_targets(ask(spark, "TG 100 table on page 30"), doc)
    assert paged.first().page == 30
    near = ev.nearby_assets(c, assets)
    rows = c.where("corpus_pos = 1").withColumns({"qid": F.lit(1), "rank": F.lit(3), "question": F.lit("table")})
    told = an.asset_answers(rows, near).first()
    assert "6-30 Gy" in told.answer and told.used_evidence_ids == ["E3"]


# --- answers ------------------------------------------------------------------

FRONT = "This cover page names the report and its many authors and the date of issue."
BODY = "The monthly output constancy check of the beam should stay within two percent."


def test_body_sentence_beats_front_matter(spark):
    rows = chunks(spark, chunk(0, FRONT, section="FRONT_MATTER"), chunk(1, BODY, section="3. QA")).withColumns({"qid": F.lit(1), "rank": F.col("corpus_pos").cast("int") + 1, "question": F.lit("report output constancy")})
    for selector in ("lexical", "auto"):
        told = an.extractive_answers(rows, selector).first()
        assert BODY in told.answer and FRONT not in told.answer and told.used_evidence_ids == ["E2"]
    with pytest.raises(ValueError, match="selector"):
        an.extractive_answers(rows, "x")
    short = rows.withColumn("text", F.lit("too short"))
    assert an.extractive_answers(short).first().answer.endswith("- too short [E1]")


def greedy_loop(rows, most, per_chunk, same):
    out = []
    for score, rank, idx, cid, s in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        t = set(re.findall(r"\w+", s.lower()))
        if len(out) >= most or any(s.lower() == o[4].lower() for o in out) or (out and score < 0.08):
            continue
        if per_chunk and sum(o[3] == cid for o in out) >= per_chunk:
            continue
        if same and any(len(t & set(re.findall(r"\w+", o[4].lower()))) / len(t | set(re.findall(r"\w+", o[4].lower()))) >= same for o in out):
            continue
        out.append((score, rank, idx, cid, s))
    return [(o[1], o[4]) for o in out]


def test_greedy_is_the_loop(spark):
    rng = random.Random(5)
    data = {q: [(round(rng.random(), 2), rng.randint(1, 4), i, f"c{rng.randint(0, 3)}", " ".join(rng.choices("a b c d e f g h".split(), k=5))) for i in range(12)] for q in range(15)}
    df = spark.createDataFrame([(q, *r) for q, rows in data.items() for r in rows], "qid long, score double, rank int, sentence_idx int, chunk_id string, sentence string")
    for most, per, same in ((4, 2, 0.82), (3, None, None)):
        got = {}
        for r in an.greedy(df, most, per, same).orderBy("qid", "place").collect():
            got.setdefault(r.qid, []).append((r["rank"], r.sentence))
        assert got == {q: greedy_loop(rows, most, per, same) for q, rows in data.items()}


def test_envelope_and_model_answers(spark):
    q = ask(spark, "fine question", " ", "weak question")
    told = spark.createDataFrame([(1, "A"), (3, "B")], "qid long, answer string")
    enough = spark.createDataFrame([(1, True), (3, False)], "qid long, sufficient boolean")
    got = {r.qid: (r.ok, r.code, r.answer, r.abstained) for r in an.envelope(q, told, enough).collect()}
    assert got == {1: (True, None, "A", False), 2: (False, "out_of_scope", None, True), 3: (False, "insufficient_evidence", None, True)}
    raw = spark.createDataFrame([(1, 'so {"answer": "x", "used_evidence_ids": ["E1", "E9"]}'), (2, "none")], "qid long, raw string")
    ids = spark.createDataFrame([(1, ["E1", "E2"])], "qid long, evidence_ids array<string>")
    got = {r.qid: (r.answer, r.used_evidence_ids, r.parsed) for r in an.model_answers(raw, ids).collect()}
    assert got == {1: ("x", ["E1"], True), 2: (None, [], False)}


# --- chunking -----------------------------------------------------------------


def blocks(spark, texts, doc="d"):
    rows = [(doc, f"{doc}_b{i}", "T", p, p, s, u, t, k, None, i) for i, (s, u, t, k, p) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, block_id string, title string, page_start int, page_end int, section string, subsection string, text string, block_type string, source_path string, block_ord int")


def count(t):
    return len(re.findall(r"\w+", t))


def pack_loop(rows, size, overlap):
    groups = {}
    for s, u, t, k, p in rows:
        if k != "heading":
            groups.setdefault((s, u), []).append((t, p))
    out = []
    for (s, u), items in groups.items():
        now = []
        for t, p in items:
            if now and sum(count(x) for x, _ in now) + count(t) > size:
                out.append((s, u, "\n".join(x for x, _ in now), now[0][1], now[-1][1]))
                target, kept, n = (min(20, overlap) if s == "UNKNOWN" else overlap), [], 0
                for x, q in reversed(now):
                    if count(x) > target and s != "UNKNOWN":
                        continue
                    kept.insert(0, (x, q))
                    n += count(x)
                    if n >= target:
                        break
                now = kept
            now.append((t, p))
        out.append((s, u, "\n".join(x for x, _ in now), now[0][1], now[-1][1]))
    return out


def test_pack_is_the_loop(spark):
    rng = random.Random(2)
    for seed in range(4):
        rows = [(rng.choice(["A", "B", "UNKNOWN"]), rng.choice(["u", "UNKNOWN"]), " ".join(rng.choices("ab cd ef gh".split(), k=rng.randint(1, 30))), rng.choice(["paragraph"] * 5 + ["heading"]), 1 + i // 5) for i in range(60)]
        got = ck.pack(ck.presplit(blocks(spark, rows), 40), 40, 10).orderBy("chunk_ord").collect()
        assert [(r.section, r.subsection, r.text, r.page_start, r.page_end) for r in got] == pack_loop(rows, 40, 10), seed


def test_presplit_packs_sentences(spark):
    text = "One two three. Four five six seven. Eight nine. Ten eleven twelve thirteen fourteen."
    rows = ck.presplit(blocks(spark, [("S", "u", text, "paragraph", 1), ("S", "u", "Short one.", "paragraph", 1), ("S", "u", "no end " * 9, "paragraph", 1), ("S", "u", text, "heading", 1)]), 7).orderBy("block_ord", "sub_ord").collect()
    assert [(r.block_id, r.text, r.tok) for r in rows[:3]] == [("d_b0_s00", "One two three. Four five six seven.", 7), ("d_b0_s01", "Eight nine. Ten eleven twelve thirteen fourteen.", 7), ("d_b1", "Short one.", 2)]
    assert len(rows) == 5


def repeats_loop(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        last = kept[-1] if kept else None
        a, b = (set(last[1].lower().split()), set(r[1].lower().split())) if last else (set(), set())
        if last and last[2] == r[2] and a and b and len(a & b) / min(len(a), len(b)) > 0.88:
            continue
        kept.append(r)
    return {r[0] for r in kept}


def test_drop_repeats_is_the_loop(spark):
    rng = random.Random(8)
    rows = [(f"c{i:03d}", " ".join(rng.choices("a b c".split(), k=rng.randint(1, 4))), rng.choice("ST"), rng.randint(1, 3)) for i in range(60)]
    df = chunks(spark, *((i, "d", "t", s, "UNKNOWN", p, p, t, 1, [], "standard", None, None, 0) for i, t, s, p in rows))
    assert {r.chunk_id for r in ck.drop_repeats(df).collect()} == repeats_loop(rows)


def test_chunker_keeps_definitions_and_numbers_in_order(spark):
    text = "Background text. The dose outside the PTV is referred to as nontarget dose. Additional context sentence."
    filler = " ".join(f"w{i}" for i in range(120)) + "."
    out = ck.chunk_documents(blocks(spark, [("1. INTRODUCTION", "UNKNOWN", text, "paragraph", 1), ("2. X", "UNKNOWN", filler, "paragraph", 2)])).orderBy("corpus_pos").collect()
    assert [r.chunk_id for r in out] == [f"d_c{i:04d}" for i in range(len(out))]
    micro = [r for r in out if r.chunk_kind == "definition_microchunk"]
    assert len(micro) == 1 and micro[0].parent_chunk_id in {r.chunk_id for r in out} and "definition" in micro[0].tags
    assert ck.chunk_documents(blocks(spark, [("S", "u", "twelve words " * 6, "paragraph", 1)]), 10, 2, 1).count() >= 1
    tags = one(spark, pr.infer_tags(F.lit("S"), F.lit("u"), F.lit("It is referred to as nontarget dose and should be minimized."), F.lit(False)))
    assert "recommendation" not in tags and "definition" in tags


def test_results_don_t_depend_on_partitions(spark):
    rows = [("A", "u", f"Sentence {i} has words. Another one {i}.", "paragraph", 1 + i // 4) for i in range(30)]
    a, b = (ck.chunk_documents(blocks(spark, rows).repartition(n), 30, 8, 5).orderBy("corpus_pos").collect() for n in (1, 7))
    assert a == b


# --- ingest -------------------------------------------------------------------


def test_section_fill_and_captions(spark):
    rows = [(1, 0, "paragraph", 1, None, "pre"), (1, 1, "heading", 1, 1, "One"), (1, 2, "heading", 1, 3, "Sub"), (1, 3, "text block", 1, None, "body"), (1, 4, "heading", 2, None, "Deep"), (1, 5, "heading", 2, 2, "Two"), (1, 6, "list", 2, None, " "), (1, 7, "image", 2, None, "pic"), (1, 8, "list", 2, None, "item")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, type string, page int, heading_level int, content string")
    got = [(r.block_ord, r.block_type, r.section, r.subsection) for r in ig.section_fill(df).orderBy("block_ord").collect()]
    assert got == [(0, "paragraph", "UNKNOWN", "UNKNOWN"), (1, "heading", "One", "UNKNOWN"), (2, "heading", "One", "Sub"), (3, "text_block", "One", "Sub"), (4, "heading", "One", "Deep"), (5, "heading", "Two", "UNKNOWN"), (6, "list", "Two", "UNKNOWN")]
    catalog = spark.createDataFrame([("a.pdf", "tg_1", "First", "o", "u", 0), ("a.pdf", "tg_2", "Second", "o", "u", 1), ("z", "b_c", "Slug", "o", "u", 2)], "file string, doc_id string, title string, organization string, source_url string, pos int")
    listed = spark.createDataFrame([("a.pdf", None), ("B c.pdf", None), ("x.pdf", "Own"), ("y.pdf", " ")], "file string, pdf_title string")
    assert {r.file: (r.doc_id, r.title) for r in ig.manifest(listed, catalog).collect()} == {"a.pdf": ("tg_2", "Second"), "B c.pdf": ("b_c", "Slug"), "x.pdf": ("x", "Own"), "y.pdf": ("y", "y")}


# --- statistics ---------------------------------------------------------------


def test_statistics_golden_values(spark):
    for s, n, want in ((13, 14, (0.685313, 0.987278)), (0, 5, (0.0, 0.434482)), (35, 35, (0.901099, 1.0)), (0, 0, (0.0, 0.0))):
        i = one(spark, st.wilson(F.lit(s), F.lit(n)))
        assert (i.low, i.high) == (pytest.approx(want[0], abs=1e-6), pytest.approx(want[1], abs=1e-6))
    for a, b, want in ((11, 4, 0.118469), (12, 2, 0.012939), (1, 1, 1.0), (0, 0, 1.0), (400, 300, None)):
        exact = min(1.0, 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)) if a + b else 1.0
        assert one(spark, st.mcnemar(F.lit(a).cast("long"), F.lit(b).cast("long"))) == pytest.approx(exact if want is None else want, abs=1e-6)
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "v double")
    assert values.agg(F.percentile("v", F.lit(0.025))).first()[0] == pytest.approx(1.075) and values.agg(F.percentile("v", F.lit(0.95))).first()[0] == pytest.approx(7.4)
    assert el.latency(values, "v").first().p95 == 8.0


def test_quantiles_are_exact(spark):
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [5.0], None: [1e9, 1e9, -1e9, 3.0, 3.0, 3.0, 3.5], "c": [rng.choice([1.0, 2.0, 1e6]) for _ in range(50)]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double").repartition(3)
    for buckets in (1, 7, 1024):
        got = {r.k: r for r in el.quantiles(rows, "v", {"low": (0.025, False), "mid": (0.5, False), "near": (0.95, True)}, ["k"], buckets).collect()}
        for k, vs in groups.items():
            vs = sorted(vs)
            at = lambda p: vs[int(p * (len(vs) - 1))] + (vs[min(int(p * (len(vs) - 1)) + 1, len(vs) - 1)] - vs[int(p * (len(vs) - 1))]) * (p * (len(vs) - 1) % 1)  # noqa: E731, B023
            assert got[k].low == pytest.approx(at(0.025)) and got[k].mid == pytest.approx(at(0.5)) and got[k].near == vs[math.ceil(0.95 * len(vs)) - 1]
    assert el.quantiles(rows.limit(0), "v", {"mid": (0.5, False)}, ["k"]).count() == 0


def test_passage_gold_is_any_run(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "short item"), (3, ""), (4, None)], "qid long, question string")
    texts = spark.createDataFrame([(1, "x Three, four five six seven EIGHT nine ten y"), (2, "a short item here"), (3, "one two three four five six seven"), (4, None)], "doc_id long, text string")
    for rows in (1_000_000, 0):
        assert sorted(tuple(r) for r in el.passage_gold(items, texts, "doc_id", rows=rows).collect()) == [(1, 1), (2, 2)]


def test_bootstrap_is_near_theory(spark):
    rows = spark.createDataFrame([(i, float(i % 4 == 0)) for i in range(200)], "id long, v double")
    r = st.bootstrap_mean(rows, "v", 2000).first()
    half = 1.96 * math.sqrt(0.25 * 0.75 / 200)
    assert r.mean == 0.25 and abs(r.low - (0.25 - half)) < 0.015 and abs(r.high - (0.25 + half)) < 0.015
    many = spark.createDataFrame([(float(i),) for i in range(500)], "v double")  # several buckets of values
    r = st.bootstrap_mean(many, "v", 2000, bucket_values=50).first()
    half = 1.96 * math.sqrt((500**2 - 1) / 12 / 500)
    assert r.mean == 249.5 and abs(r.low - (249.5 - half)) < 1 and abs(r.high - (249.5 + half)) < 1
    assert st.bootstrap_mean(many.limit(0), "v", 10).first().mean is None
    low, high = st.bootstrap_reference([1.0, 0.0, 1.0, 1.0], 200, 7)
    assert 0 <= low <= 0.75 <= high <= 1


# --- validation, generators, routing ------------------------------------------


def test_host_answers_are_validated_and_scored(spark):
    q = spark.createDataFrame([("q1", [("A", "x"), ("B", "y")], "A"), ("q2", [("A", "x"), ("B", "y")], "B")], "qid string, options array<struct<label:string,text:string>>, gold_label string")
    a = spark.createDataFrame([("q1", "A", 1, 1.0), ("q2", "A", 0, 3.0)], "qid string, selected_label string, n_citations int, latency_seconds double")
    assert au.validate_benchmark(q, 2).count() == 0 and au.validate_answers(a, q).count() == 0
    s = au.host_scores(a, q).first()
    assert (s.accuracy, s.citation_rate, s.mean_latency) == (0.5, 0.5, 2.0)
    bad = a.unionByName(a.limit(1)).unionByName(spark.createDataFrame([("q2", "Z", 0, float("nan")), ("q9", "A", 0, 1.0)], a.schema))
    assert {r.problem for r in au.validate_answers(bad, q).collect()} == {"duplicate", "label not offered", "bad latency", "unknown question"}
    worse = spark.createDataFrame([("q1", [("A", "x"), ("A", "y")], "C"), ("q1", [("A", "x")], "A")], q.schema)
    assert {r.problem for r in au.validate_benchmark(worse, 3).collect()} == {"repeated label", "gold label not among options", "fewer than two options", "duplicate", "unexpected number of questions"}
    assert {c for c in gn.host_view(q).columns} == {"qid", "options"}
    tasks = spark.createDataFrame([("q1", '{"a": {"goldAnswer": 1}, "b": 2}')], "qid string, json string")
    assert [r.path for r in au.gold_paths(tasks, "qid", "json").collect()] == ["$.a.goldAnswer"]
    listing = spark.createDataFrame([("src/a.py",), ("data/x.pdf",)], "path string")
    assert {tuple(r) for r in au.release_files(listing, (r"\.pdf$",), ("README.md", "src/a.py")).collect()} == {("data/x.pdf", "forbidden"), ("README.md", "missing")}


def test_required_assets_abort(spark):
    t = spark.createDataFrame([("a",), ("b",)], "asset_id string")
    with pytest.raises(ValueError, match="without asset_id: b"):
        gn.with_required(t, t.limit(0).unionByName(spark.createDataFrame([("a",)], t.schema)))


def test_routing_without_a_dense_index(spark):
    scenes = routing.with_scene(ask(spark, "Compare HDR and LDR sources", "x"))
    got = {r.qid: r.strategy for r in routing.select_strategy(scenes, False).collect()}
    assert got == {1: "broad_sparse_synthesis", 2: "sparse_direct"}
    assert routing.backends("auto", "missing")[0] == "sparse" and routing.backends("auto", "semantic") == ("hybrid", [])
    with pytest.raises(ValueError, match="dense"):
        routing.backends("hybrid", "missing")
    assert routing.dense_status(None) == "missing"


# --- files, streaming, engine -------------------------------------------------


def test_readers_and_writers(spark, tmp_path):
    path = f"{tmp_path}/x"
    df = spark.createDataFrame([(1, "é"), (2, None)], "id long, t string")
    files.write_jsonl(df, path)
    assert files.read_jsonl(spark, path, "id long, t string").orderBy("id").collect() == df.collect()
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnope\n\n[1]\n')
    assert files.read_jsonl_permissive(spark, f"{tmp_path}/bad.jsonl", "id long").where("id IS NOT NULL").count() >= 1
    assert files.read_jsonl_permissive(spark, f"{tmp_path}/none.jsonl", "id long").count() == 0
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "id long").collect()
    assert [(r.line_no, r.error) for r in files.jsonl_errors(spark, f"{tmp_path}/bad.jsonl").orderBy("line_no").collect()] == [(2, "invalid JSON"), (4, "not an object")]
    (tmp_path / "empty.jsonl").write_text("\n")
    assert [r.error for r in files.jsonl_errors(spark, f"{tmp_path}/empty.jsonl").collect()] == ["empty file"]
    (tmp_path / "q.csv").write_text("﻿Question,Choice\na,b\n")
    assert files.read_csv(spark, f"{tmp_path}/q.csv", ["Question"]).first().Question == "a"
    with pytest.raises(ValueError, match="missing columns"):
        files.read_csv(spark, f"{tmp_path}/q.csv", ["Correct"])
    (tmp_path / "q.json").write_text('[{"id": 1},\n{"id": 2}]')
    assert files.read_json_array(spark, f"{tmp_path}/q.json", "id long").count() == 2
    (tmp_path / "c").mkdir()
    for name, n in (("b", 2), ("a", 1)):
        (tmp_path / "c" / f"{name}.chunks.jsonl").write_text("".join(f'{{"id": "{name}{i}"}}\n' for i in range(n)))
    assert [r.id for r in files.read_chunk_files(spark, f"{tmp_path}/c", "id string").orderBy("corpus_pos").collect()] == ["a0", "b0", "b1"]
    hashes = files.file_hashes(spark, f"{tmp_path}/c")
    assert hashes.count() == 2 and all(len(r.sha256) == 64 for r in hashes.collect())
    files.write_by(df.withColumn("k", F.lit("v")), f"{tmp_path}/by", "k")
    assert spark.read.parquet(f"{tmp_path}/by").count() == 2
    files.append_log(df, f"{tmp_path}/log")
    files.append_log(df, f"{tmp_path}/log")
    assert files.read_log(spark, f"{tmp_path}/log").where("timestamp_utc IS NOT NULL").count() == 4


def test_stream_keeps_the_index(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    source, index = f"{tmp_path}/in", f"{tmp_path}/index"
    for i, t in enumerate(CORPUS):
        spark.createDataFrame([(i, t, "en", "s", len(t))], schema).coalesce(1).write.mode("append").parquet(source)
        index_append.follow(spark, source, schema, index, f"{tmp_path}/cp").awaitTermination()
    post, length = index_append.read_index(spark, index)
    got = {r.corpus_pos: r.score for r in rt.bm25(ask(spark, "dose beam"), post, length).collect()}
    assert got[0] == pytest.approx(1.141437, abs=2e-6) and length.count() == 3


def engine_of(spark, **how):
    rows = [
        chunk(1, "Synthetic quality assurance checks cover output constancy of the beam every month.", doc="qa_doc", title="Synthetic QA Report", page=4, end=5),
        chunk(2, "A table of tolerance levels for output constancy stands on this page of the report.", doc="qa_doc", title="Synthetic QA Report", page=9, end=9),
        chunk(1, "Output constancy of brachytherapy sources is checked before every treatment.", doc="br_doc", title="Source Report", page=1, end=1),
    ]
    return Engine(spark, chunks(spark, *rows), **how)


def test_engine_answers_with_citations(spark, tmp_path):
    engine = engine_of(spark)
    rows = engine.query("output constancy checks", "evidence").orderBy("rank").collect()
    assert rows[0].page_range == "pp. 4-5" and rows[0].citation.startswith("[E1] Synthetic QA Report") and rows[0].ok
    assert rows[0].backend == "sparse" and [w.code for w in rows[0].warnings] == ["hybrid_retrieval_unavailable"]
    told = engine.query("output constancy checks of the beam").first()
    assert told.ok and not told.abstained and "[E1]" in told.answer
    assert "Evidence:" in engine.query("output constancy of the beam", "bundle").first().prompt
    engine.save(f"{tmp_path}/index")
    assert engine.missing(spark, f"{tmp_path}/index") == [] and engine.missing(spark, f"{tmp_path}/index", "hybrid") == ["vectors", "dense_meta"]
    assert engine.load(f"{tmp_path}/index").query("output constancy", "evidence", "routed").count() == 3
    assert engine.chunk("qa_doc").first().chunk_id == "qa_doc_c0001" and engine.chunk("none").first().code == "out_of_scope"
    assert engine.reports().count() == 2 and engine.topics().count() >= 1
    with pytest.raises(FileNotFoundError, match="postings"):
        engine.load(f"{tmp_path}/nothing")
    manifest = spark.createDataFrame([("qa_doc", 1, "old", None), ("qa_doc", 2, "Org", "http://x")], "doc_id string, pos int, organization string, source_url string")
    assert {(r.doc_id, r.organization) for r in engine.navigator(manifest).collect()} == {("qa_doc", "Org"), ("br_doc", None)}
    engine.build_navigator(f"{tmp_path}/navigator", manifest)
    assert spark.read.parquet(f"{tmp_path}/navigator/topics").count() == 3


def test_engine_errors_are_rows(spark):
    engine = engine_of(spark)
    asked = spark.createDataFrame([(1, "output constancy checks", "qa_doc"), (2, " ", None), (3, "output constancy", "gone"), (4, "sourdough bread", None), (5, "output constancy", None)], "qid long, question string, report_id string")
    rows = engine.query(asked, "evidence").collect()
    codes = {r.qid: r.code for r in rows}
    assert codes == {1: None, 2: "out_of_scope", 3: "out_of_scope", 4: "insufficient_evidence", 5: None}
    assert {r.doc_id for r in rows if r.qid == 1} == {"qa_doc"} and {r.doc_id for r in rows if r.qid == 5} == {"qa_doc", "br_doc"}
    code = lambda **how: engine.query("output constancy", **how).first().code
    assert code(mode="poem") == code(backend="psychic") == code(selector="x") == code(answerer="y") == "out_of_scope"
    assert code(backend="hybrid") == "missing_index" and code(answerer="model") == "missing_model_path"
    assert engine.query("output constancy", report_id="gone").first().code == "out_of_scope"
    assert Engine(spark, engine.chunks.limit(0)).query("output").first().code == "empty_corpus"
    assert set(an.ERRORS) == {"missing_index", "out_of_scope", "insufficient_evidence", "missing_model_path", "empty_corpus", "ocr_required", "runtime_failure"}


def test_engine_with_vectors_memory_assets_and_a_generator(spark, tmp_path):
    base = engine_of(spark)
    vectors = base.chunks.select("chunk_id", "corpus_pos", F.when(F.col("doc_id") == "br_doc", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("embedding"))
    embed = lambda q: F.array(F.lit(1.0), F.lit(0.0))
    engine = engine_of(spark, vectors=vectors, embed=embed, meta=rt.dense_meta(vectors, "toy", "toy"))
    assert engine.dense == "semantic" and engine.query("output constancy", "evidence").first().backend == "hybrid"
    engine.save(f"{tmp_path}/index")
    assert engine_of(spark, embed=embed).load(f"{tmp_path}/index", embedding_model_name="toy", dimension=2).dense == "semantic"
    with pytest.raises(ValueError, match="mismatch"):
        base.load(f"{tmp_path}/index", embedding_model_name="other")
    hashed = engine_of(spark, vectors=vectors, embed=embed, meta=rt.dense_meta(vectors, "x", "hash_fallback"))
    assert hashed.dense == "hash" and hashed.query("output constancy", "evidence").first().backend == "sparse"
    log = f"{tmp_path}/log"
    engine.remember(engine.query("Define output constancy", "evidence", "routed"), log)
    memory = files.read_log(spark, log).withColumn("pos", F.lit(1).cast("long"))
    assert memory.first().evidence_status == "sufficient" and memory.first().strategy_used == "definition_sparse_microchunk"
    memory = memory.withColumn("strategy_used", F.lit("learned")).withColumn("evidence_top_k", F.lit(1))
    routed = engine_of(spark, memory=memory).query("Define output constancy", "evidence", "routed").collect()
    assert len(routed) == 1 and routed[0].strategy == "learned" and "1 remembered" in routed[0].warnings[0].message
    assets = spark.createDataFrame([("qa_doc", "t1", "table", 9, "Tolerance levels", "2 %")], "doc_id string, asset_id string, asset_type string, page int, caption string, text_preview string")
    shown = engine_of(spark, assets=assets).query("What does the table on page 9 of the Synthetic QA Report show about output constancy tolerance levels?").first()
    assert shown.ok and "table t1 (p. 9): Tolerance levels; 2 %" in shown.answer
    told = engine_of(spark, generate=lambda prompts: ['{"answer": "monthly", "used_evidence_ids": ["E1", "E77"]}'] * len(prompts)).query("output constancy checks").first()
    assert told.answer == "monthly" and told.used_evidence_ids == ["E1"]


def test_command_line(spark, tmp_path, capsys):
    import json

    from lodestar import cli

    index = f"{tmp_path}/index"
    assert cli.main(["--index", index, "reports"], spark) == 2
    engine_of(spark).save(index)
    capsys.readouterr()
    assert cli.main(["--index", index, "query", "output constancy checks", "--limit", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["rows"][0]["chunk_id"] == "qa_doc_c0001"
    assert cli.main(["--index", index, "query", " "], spark) == 3 and cli.main(["--index", index, "query", "sourdough bread"], spark) == 4
    assert cli.main(["--index", index, "query", "x", "--backend", "hybrid"], spark) == 2 and cli.main(["--index", index, "chunk", "zz"], spark) == 3
    assert cli.main(["--index", index, "topics"], spark) == 0 and cli.main(["--index", index, "chunk", "br_doc"], spark) == 0


def test_host_responses_are_checked_strictly(spark):
    labels = F.array(F.lit("A"), F.lit("B"), F.lit("A"))
    schema = __import__("json").loads(one(spark, an.response_schema(labels)))
    assert schema["properties"]["selected_label"] == {"type": "string", "enum": ["A", "B"]} and schema["required"] == ["selected_label", "citations"] and schema["additionalProperties"] is False
    assert one(spark, an.response_schema(F.array(F.lit("A"), F.lit("")))) is None and one(spark, an.response_schema(F.array().cast("array<string>"))) is None
    cases = {
        ' {"selected_label": "A", "citations": ["E1"]} ': None,
        '{"selected_label": "B", "citations": []}': None,
        "no": "not JSON",
        "[1]": "violates the schema",
        '{"selected_label": "A"}': "violates the schema",
        '{"selected_label": "A", "citations": [], "more": 1}': "violates the schema",
        '{"selected_label": "C", "citations": []}': "invalid label",
        '{"selected_label": 1, "citations": []}': "invalid label",
        '{"selected_label": "A", "citations": "E1"}': "invalid citations",
        '{"selected_label": "A", "citations": [1]}': "invalid citations",
        '{"selected_label": "A", "citations": ["E1", null]}': "invalid citations",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("r", an.parse_response(F.col("t"), labels)).collect()
    assert {r.t: r.r.problem for r in rows} == cases
    assert rows[0].r.selected_label == "A" and rows[0].r.citations == ["E1"]
