"""Fragments of oracle SQL that several queries share."""

from __future__ import annotations

WORDS = r"[\p{L}\p{N}_]+"


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{WORDS}')"


def tokset(x: str) -> str:
    return f"list_distinct({tok(x)})"


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple], *columns: str) -> str:
    """(VALUES ...) AS t(columns) of strings, numbers and nulls."""
    cell = lambda v: "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({', '.join(columns)})"


def any_match(x: str, patterns) -> str:
    return f"regexp_matches({x}, " + lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)) + ")"


NORM = r"trim(regexp_replace(translate({x}, '‐‑‒–—', '-----'), '\s+', ' ', 'g'))"

CHUNKS = f"""chunks AS (SELECT 'c' || doc_id AS chunk_id, doc_id AS corpus_pos, source AS doc_id, source AS title, lang AS section, 'UNKNOWN' AS subsection,
 CAST(doc_id % 10 + 1 AS INTEGER) AS page_start, CAST(doc_id % 10 + 1 + length(text) // 2000 AS INTEGER) AS page_end, text, CAST(len({tok('text')}) AS INTEGER) AS dl FROM documents)"""

BM25 = f"""{CHUNKS},
post AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest({tok('text')}) AS token FROM chunks) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM chunks),
qt AS (SELECT qid, token, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({tok('text')}) AS token FROM benchmark) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
scored AS (SELECT q.qid, c.chunk_id, c.doc_id, c.corpus_pos, round(sum(q.qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
 FROM qt q JOIN post p USING (token) JOIN dfs USING (token) JOIN chunks c USING (chunk_id), stats GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, corpus_pos) AS rank FROM scored QUALIFY rank <= 24)"""

DENSE = """dense AS (SELECT q.item_id AS qid, 'c' || v.vec_id AS chunk_id, v.vec_id AS corpus_pos, round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score,
 row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank
 FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id CROSS JOIN embeddings v QUALIFY rank <= 24)"""

HYBRID = f"""{BM25}, {DENSE},
merged AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, coalesce(d.corpus_pos, s.corpus_pos) AS corpus_pos,
 coalesce(d.score, 0.0) AS dense_score, coalesce(s.score, 0.0) AS bm25_score, d.rank IS NOT NULL AS dense_hit, s.rank IS NOT NULL AS bm25_hit,
 round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 8) AS fusion_score FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.chunk_id = s.chunk_id),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fusion_score DESC, corpus_pos) AS retrieval_rank FROM merged QUALIFY retrieval_rank <= 20)"""

#: chunks, sparse and hybrid rankings
RERANK_HEAD = HYBRID
