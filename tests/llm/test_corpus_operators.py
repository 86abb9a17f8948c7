"""Token alignment, source divergence and substring dedup against brute force, on odd rows and on the smallest data set."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import alignment, divergence, substrings
from lodestar.llm.queries import OP12_SQL, REGISTRY
from tests.test_queries import compare, duck, rows_of  # noqa: F401

DATA = "/root/testdata/sf0.001"


def long_text(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(50, size=n))


SHARED = " ".join(f"s{i}" for i in range(60))
ODD = [
    (0, "", "en", "a"), (1, None, None, None), (2, " \t\n ", "en", None), (3, "one", "en", "a"), (3, "one", "en", "a"), (None, f"x {SHARED} y", "en", "b"), (5, f"{SHARED}", None, "b"),
    (6, f"{long_text(300, 1)} {SHARED[:200]} z", "de", "a"), (7, f"q\n{SHARED}\t{SHARED} é", "de", "c"), (8, long_text(9000, 2) + " " + SHARED, "en", "c"), (9, "ÀÉ été Été 日本 Foo-foo FOO foo", "fr", "a"), (10, "été foo", "fr", "b"), (11, "été foo 日本", "fr", "b"), (12, "x" * 400 + " " + "y" * 300, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    # columns named as the operators' own
    return spark.createDataFrame([(*r, "p", 1, b"k") for r in ODD], SCHEMA + ", part string, key long, k0 binary").repartition(3)


# --- substring dedup ----------------------------------------------------------


def removed_by_hand(texts, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode()) for x in texts]
    seen = Counter(tuple(w[s : s + window]) for w in words for s in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {s + k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_substrings_of_odd_rows(odd, monkeypatch):
    for window, block in ((35, 1 << 20), (35, 300), (4, 64), (1, 64)):
        monkeypatch.setattr(substrings, "BLOCK", block)
        want = sorted(zip((str(r[0]) for r in ODD), removed_by_hand([r[1] for r in ODD], window), strict=True))
        found = substrings.substring_dedup(odd, window=window, bucket_words=500 if window == 4 else 10**6).collect()
        assert sorted((str(r[0]), tuple(r)[1:]) for r in found) == want


def test_substrings_keep_columns_and_text(odd):
    from pyspark.sql import functions as F

    rows = substrings.substring_dedup(odd, keep=[F.col("part"), F.col("k0")], keep_text=True).collect()
    texts = {r[0]: r[1] for r in ODD}
    assert all(r.part == "p" and r.k0 == b"k" for r in rows) and len(rows) == len(ODD)
    for r in rows:
        assert r.kept_text == texts[r.doc_id] if not r.n_removed else r.kept_text is not None and hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_substrings_of_an_empty_table(spark):
    assert substrings.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 62), max_size=60), st.integers(1, 40))
def test_rolling_hashes_are_of_the_run_alone(values, n):
    h = np.array(values, np.uint64)
    got = substrings.rolling(h, n, substrings._A)
    assert len(got) == max(0, len(values) - n + 1)
    assert [int(x) for x in got] == [int(substrings.rolling(h[i : i + n], n, substrings._A)[0]) for i in range(len(got))]


def test_every_window_holds_a_block():
    for window in range(1, 60):
        block = (window + 1) // 2
        assert all(any(s <= b and b + block <= s + window for b in range(0, s + window, block)) for s in range(200))


# --- source divergence --------------------------------------------------------


def test_divergence_of_odd_rows_is_what_sql_says(odd, duck, monkeypatch):  # noqa: F811
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", ODD)
    want = con.execute(OP12_SQL)
    columns = [d[0] for d in want.description]
    want = rows_of(columns, want.fetchall())
    for block, entries, sources in ((1 << 22, 300_000, 1024), (64, 5, 2), (1 << 22, 1, 1)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "ENTRIES", entries)
        found = divergence.source_divergence(odd, sources=sources)
        assert rows_of(found.columns, found.collect()) == want
    assert divergence.source_divergence(odd.where("false")).collect() == []


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 5, 10**13 - 2, 123_456_789_012])
    total = np.array(10**13)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (c + 1) // 10**13 for c in counts.tolist()]


def test_a_long_text_counts_as_one_document(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 16)
    text = "alpha beta gamma " * 20
    df = spark.createDataFrame([(1, text, "en", "a"), (2, text, "en", "b")], SCHEMA)
    assert divergence.source_divergence(df).where("part = 'term'").count() == 0  # two documents keep no term


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_op12_is_what_sql_says(spark, duck):  # noqa: F811
    compare(spark, duck, REGISTRY.queries["op12_source_divergence"], OP12_SQL)


# --- token alignment ----------------------------------------------------------


class Hand:
    """Both tokenizers through their libraries, whole texts, and a plain sweep."""

    def __init__(self):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        self.a_bytes = {i: bytes(letter[c] for c in t) for t, i in self.a.get_vocab().items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return None
        a = [(i, self.a_bytes[i]) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, self.b_bytes(i)) for i in self.b.encode(text)]
        raw = (" " + text).encode()
        return (a, b) if all(b"".join(x for _, x in side) == raw for side in (a, b)) else None

    def rows(self, texts):
        made, count = [], Counter()
        for text in texts:
            sides = self.tokens(text)
            if sides is None:
                made.append(None)
                continue
            ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in sides]
            groups, links = [], []
            for low, high in zip([0, *(c := sorted(set(ends[0]) & set(ends[1])))], c, strict=False):
                part = [[i for (i, _), e in zip(side, end, strict=True) if low < e <= high] for side, end in zip(sides, ends, strict=True)]
                groups.append("|".join(",".join(map(str, p)) for p in part))
                links.append((part[0][-1], part[1][-1]))
            count.update(links)
            made.append((len(sides[0]), len(sides[1]), groups, links))
        best = defaultdict(int)
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        return [
            (0, 0, 0, 0, 0, 0, "") if m is None else (m[0], m[1], len(m[2]), len(m[3]), sum(count[x] == best[x[1]] for x in m[3]), sum(count[x] for x in m[3]), hashlib.sha256(";".join(m[2]).encode()).hexdigest())
            for m in made
        ]


@pytest.fixture(scope="module")
def hand():
    return Hand()


TEXTS = ["", None, " ", "a", " a b", "a  b ", "x\n\ny", "a\n \nb", "▁x", "日本語 テキスト", "é́ ñ", "<|endoftext|> <s> </s>", "tab\there \t x", "a b   c", "🙂🙃 x", "don't we'll", "\x1c \x1d!", "ǅ ʰ ١٢٣ ½", "word " * 900 + "end", "日" * 700, "\x00a", "a \x00", "Das ist gut.", "Das ist gut."]


@pytest.mark.parametrize("block,piece", [(1 << 16, 1 << 20), (64, 1 << 20), (50, 40)])
def test_alignment_of_odd_texts(spark, hand, monkeypatch, block, piece):
    monkeypatch.setattr(alignment.pieces_of, "__defaults__", (piece,))
    df = spark.createDataFrame([(i if i % 5 else None, x, 1, "k") for i, x in enumerate(TEXTS)], "doc_id long, text string, key int, id string").repartition(3)
    got = [tuple(r) for r in alignment.token_alignment(df, block=block).collect()]
    want = [(i if i % 5 else None, *row) for i, row in enumerate(hand.rows(TEXTS))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_alignment_links_and_bad_bytes(spark, hand):
    df = spark.createDataFrame([(1, bytearray(b"ab\xff c")), (2, bytearray(b"the cat"))], "doc_id long, text binary").selectExpr("doc_id", "cast(text AS string) AS text")
    rows = {r.doc_id: r for r in alignment.token_alignment(df, keep_links=True).collect()}
    assert rows[1].n_a == 0 and rows[1].groups_sha256 == "" and rows[1].links == b""
    codes = np.frombuffer(rows[2].links, "<u4")
    a, b = hand.tokens("the cat")
    assert len(codes) == rows[2].n_links and codes[-1] == a[-1][0] * 32000 + b[-1][0]
    assert alignment.token_alignment(df.where("false")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n\té’—日本語абвΩ한글"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60))
def test_plain_texts_by_ranks_are_the_librarys(text):
    a, b = alignment.tokenizers(None, None)
    assert a.encode(text) == a.tokenizer.encode(" " + text, None, False, False).ids
    parts = list(alignment.pieces_of(text, 5))
    assert " ".join(parts) == text
    for side in (a, b):
        assert [i for p in parts for i in side.encode(p)] == list(side.encode(text))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_op11_and_op13_by_hand(spark, hand):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    for name, made in (("op11_token_alignment", hand.rows([d["text"] for d in docs])), ("op13_substring_dedup", removed_by_hand([d["text"] for d in docs], 35))):
        got = {r[0]: tuple(r)[1:] for r in REGISTRY.queries[name](spark, DATA).collect()}
        assert got == {d["doc_id"]: row for d, row in zip(docs, made, strict=True)}
