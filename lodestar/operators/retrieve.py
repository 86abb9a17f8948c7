"""Sparse, dense and fused retrieval of a whole table of questions against a chunk table.

The inverted index is three tables (postings, document frequencies, lengths). A search
joins question terms with postings on the token, so only chunks that share a word with a
question are touched; document frequencies ride on the question's terms, which are few,
and top-k windows are cut per partition before they are exchanged (WindowGroupLimit).
Scores are rounded to six places before ranking, with corpus position as the tie break.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import tokens
from lodestar.operators.held import CELLS, Held, places
from lodestar.sources.shared import ship

K1, B = 1.5, 0.75
TOP_K, FUSED_K, RRF_K = 24, 20, 60
DIGITS = 6
#: rows of a question side that may be broadcast; larger ones are joined by shuffle
BROADCAST_ROWS = 100_000
#: query vectors that are sent to the tasks at a time
QUERY_BLOCK = 4_096


def sized(df: DataFrame, n: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if its known bound of n rows is at most `rows`; else joined by shuffle."""
    return F.broadcast(df) if n <= rows else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same for a cheap table, by a count that stops early."""
    return sized(df, df.limit(rows + 1).count(), rows)


def top_k(df: DataFrame, k: int, by: list[str | Column], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group, ranked from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def best(k: int, score: str, rank: str = "rank", by: str = "qid", tie: str = "corpus_pos"):
    return lambda df: top_k(df, k, [by], [F.col(score).desc(), F.col(tie).asc()], rank)


#: a chunk that a question's scope allows
INSIDE = "report_id IS NULL OR report_id = doc_id"


# --- inverted index -----------------------------------------------------------


def postings(chunks: DataFrame, text: Column | str, id_col: str = "chunk_id", only: DataFrame | None = None) -> DataFrame:
    """(token, chunk_id, tf); `only` (token) keeps other tokens out of the exchange."""
    each = chunks.select(F.col(id_col), F.explode(tokens(text)).alias("token"))
    if only is not None:
        each = each.join(only, "token", "left_semi")
    return each.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))


def lengths(chunks: DataFrame, text: Column, *keep: str, id_col: str = "chunk_id") -> DataFrame:
    """(id, keep, dl), dealt by id: the exchange keeps tokenising out of the joins' inner loops."""
    return chunks.select(F.col(id_col), *keep, F.size(tokens(text)).alias("dl")).repartition(F.col(id_col))


def document_frequencies(posting: DataFrame) -> DataFrame:
    return posting.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def statistics(length: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return length.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def raw_okapi(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def okapi(n: Column, df: Column, mean: Column, epsilon: float = 0.25) -> Column:
    """The variant whose negative values become epsilon times the mean."""
    return F.when(raw_okapi(n, df) < 0, mean * epsilon).otherwise(raw_okapi(n, df))


def mean_okapi_idf(chunks: DataFrame, text: Column | str, n: int) -> float:
    """Over all tokens; frequencies are counted in the tasks, so no posting is exchanged."""
    each = chunks.select(F.explode(F.array_distinct(tokens(text))).alias("token"))
    return document_frequencies(each).agg(F.avg(raw_okapi(F.lit(n), F.col("df")))).first()[0] or 0.0


def okapi_idf(frequencies: DataFrame, n: Column, epsilon: float = 0.25) -> DataFrame:
    """The variant whose negative values become epsilon times the mean."""
    mean = frequencies.agg(F.avg(raw_okapi(n, F.col("df"))).alias("mean"))
    return frequencies.crossJoin(F.broadcast(mean)).select("token", "df", okapi(n, F.col("df"), F.col("mean"), epsilon).alias("idf"))


def question_terms(questions: DataFrame) -> DataFrame:
    """(qid, token, qtf): multiplicity in the question counts."""
    return questions.select("qid", F.explode(tokens("question")).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qtf"))


def bm25_scores(questions: DataFrame, posting: DataFrame, length: DataFrame, key: str = "chunk_id", k1: float = K1, b: float = B, variant: str = "plain") -> DataFrame:
    """(qid, key, score) for pairs that share a term; key is a column of `length` that names a chunk.

    A posting's part that doesn't depend on the question is computed once, before it meets
    the questions, and sums are kept per two narrow keys.
    """
    stats = statistics(length)
    terms = question_terms(questions)
    n_terms = terms.count()
    wanted = sized(terms.select("token").distinct(), n_terms)
    frequencies = document_frequencies(posting if variant == "okapi" else posting.join(wanted, "token", "left_semi"))
    if variant == "okapi":
        weights = okapi_idf(frequencies, F.lit(length.count()))
    else:
        weights = frequencies.crossJoin(F.broadcast(stats)).select("token", idf(F.col("n"), F.col("df")).alias("idf"))
    terms = sized(terms.join(weights, "token").select("qid", "token", (F.col("qtf") * F.col("idf")).alias("tw")), n_terms)
    norm = length.crossJoin(F.broadcast(stats.select("avgdl"))).select("chunk_id", *({key} - {"chunk_id"}), (k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))).alias("norm"))
    part = posting.join(norm, "chunk_id").select("token", key, (F.col("tf") * (k1 + 1) / (F.col("tf") + F.col("norm"))).alias("pw"))
    return part.join(terms, "token").groupBy("qid", key).agg(F.round(F.sum(F.col("tw") * F.col("pw")), DIGITS).alias("score"))


def bm25(questions: DataFrame, posting: DataFrame, length: DataFrame, **how) -> DataFrame:
    """(qid, chunk_id, columns of `length`, score) for pairs that share a term."""
    key = "corpus_pos" if "corpus_pos" in length.columns else "chunk_id"
    return bm25_scores(questions, posting, length, key, **how).join(length.drop("dl"), key)


def bm25_search(questions: DataFrame, chunks: DataFrame, text: Column | str, k: int = TOP_K, scope: str = "none", **how) -> DataFrame:
    """Top k a question: qid, chunk_id, doc_id, corpus_pos, score, rank.

    scope="pre" ranks only chunks of the question's report_id, scope="post" drops others
    after ranking, so it may leave fewer than k. Scores are summed and ranked where the
    chunks are (see `scan`); postings are joined only for other parameters, or a vocabulary
    of questions that is too large to send.
    """
    if how in ({}, {"variant": "plain"}, {"variant": "okapi"}):
        from lodestar.operators.scan import bm25_scan

        hits = bm25_scan(questions, chunks, text, k, inside=scope == "pre", **how)
        if hits is not None and scope == "post":
            hits = hits.join(questions.select("qid", "report_id"), "qid").where(INSIDE).drop("report_id")
        if hits is not None:
            return hits
    length = lengths(chunks, text, "doc_id", "corpus_pos")
    asked = question_terms(questions).select("token").distinct()
    only = None if how.get("variant") == "okapi" else small(asked)
    posting = postings(chunks, text, only=only)
    if scope == "pre":
        scoped = questions.select("qid", "report_id")
        return best(k, "score")(bm25(questions, posting, length, **how).join(scoped, "qid").where(INSIDE)).drop("report_id")
    ranked = best(k, "score")(bm25_scores(questions, posting, length, "corpus_pos", **how))
    hits = ranked.join(length.drop("dl"), "corpus_pos")
    if scope == "none":
        return hits
    return hits.join(questions.select("qid", "report_id"), "qid").where(INSIDE).drop("report_id")


def fill_zero(hits: DataFrame, questions: DataFrame, length: DataFrame, k: int = TOP_K) -> DataFrame:
    """Pads each question to k rows with chunks of score zero in corpus order.

    A question has at most k hits, so the padding is among the first 2k chunks: the corpus
    isn't crossed with the questions.
    """
    first = length.orderBy("corpus_pos").limit(2 * k).select("chunk_id", "corpus_pos")
    missing = questions.select("qid").crossJoin(F.broadcast(first)).join(hits.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    both = hits.select("qid", "chunk_id", "corpus_pos", "score").unionByName(missing.withColumn("score", F.lit(0.0)))
    return best(k, "score")(both)


# --- dense --------------------------------------------------------------------


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, id_col: str = "chunk_id", tie: str | None = None, block: int = QUERY_BLOCK, hashed: int | None = None) -> DataFrame:
    """Exact inner product of a stated query set with all vectors: qid, id, columns of vectors, score, rank.

    queries: qid, query; vectors: id_col, embedding and what else is kept. Queries are sent
    to the tasks in blocks of at most `block`; a task multiplies a batch of vectors with
    them and keeps k rows a query (and ties), so no product becomes a row before that.
    Vectors and queries without numbers, or of another length, have no product. With
    `hashed`, a dimension, embedding lists a row's buckets, whose counts at norm 1 are the vector.
    """
    ship(vectors.sparkSession)
    columns = [c for c in vectors.columns if c != "embedding"]
    n, out = queries.count(), None
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else queries
        part = _dense_block(some, vectors, columns, k, tie or id_col, hashed)
        part = part.withColumn("score", F.round("score", DIGITS))
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, ["qid"], [F.col("score").desc(), F.col(tie or id_col)])


def _dense_block(queries: DataFrame, vectors: DataFrame, columns: list[str], k: int, tie: str, hashed: int | None = None) -> DataFrame:
    """Rows of each task that may be among a query's first k."""
    held = queries.where("query IS NOT NULL").toArrow()
    asked = [np.array(q, float) for q in held["query"].to_pylist()]
    width = len(asked[0]) if asked else 0
    fit = [i for i, q in enumerate(asked) if len(q) == width and not np.isnan(q).any()]
    shipped = queries.sparkSession.sparkContext.broadcast((np.array([asked[i] for i in fit]).reshape(len(fit), width), held["qid"].take(pa.array(fit, pa.int64())).combine_chunks()))
    if hashed is None:
        rows = vectors.where(F.size("embedding") == width).select(*columns, F.col("embedding").cast("array<double>").alias("embedding"))
    else:
        rows = vectors.where(F.size("embedding") > 0).select(*columns, "embedding")
    tied = columns.index(tie)
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), *rows.select(*columns).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, qids = shipped.value
        if not len(matrix):
            return
        held, step = Held(k, len(matrix), 10.0**-DIGITS), max(1, CELLS // max(matrix.shape))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(part.num_columns - 1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                if hashed is None:
                    vectors_ = flat.reshape(part.num_rows, width)
                else:
                    row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                    vectors_ = np.bincount(row * hashed + flat, minlength=part.num_rows * hashed).reshape(part.num_rows, hashed).astype(float)
                    vectors_ /= np.sqrt((vectors_ * vectors_).sum(axis=1, keepdims=True))
                scores = vectors_ @ matrix.T
                scores[np.isnan(scores)] = -np.inf
                held.put(scores, part.select(columns), places(part.column(tied)))
        for q, score, rows in held.found():
            yield pa.record_batch([qids.take(pa.array(q)), *rows.columns, pa.array(score)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def hash_bucket(token: Column, dimension: int) -> Column:
    return (F.crc32(token.cast("binary")) % dimension).cast("int")


def hash_embedding(chunks: DataFrame, text: Column, dimension: int = 768, id_col: str = "chunk_id") -> DataFrame:
    """Sparse long form (id, d, x): token counts by crc32 bucket, unit norm per row."""
    buckets = chunks.select(F.col(id_col), F.explode(tokens(text)).alias("token")).select(id_col, hash_bucket(F.col("token"), dimension).alias("d"))
    counts = buckets.groupBy(id_col, "d").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(id_col)))
    return counts.select(id_col, "d", (F.col("c") / norm).alias("x"))


def hash_vectors(chunks: DataFrame, text: Column | str, dimension: int = 768, id_col: str = "chunk_id") -> DataFrame:
    """id, embedding: hashed embeddings as arrays; texts without tokens have none."""
    entries = F.map_from_entries(F.collect_list(F.struct("d", "x")))
    values = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda d: F.coalesce(F.col("m")[d], F.lit(0.0)))
    return hash_embedding(chunks, text, dimension, id_col).groupBy(id_col).agg(entries.alias("m")).select(id_col, values.alias("embedding"))


def hash_dense_search(questions: DataFrame, chunks: DataFrame, text: Column, k: int = TOP_K, dimension: int = 768) -> DataFrame:
    """Inner products of hashed embeddings; chunks that share no bucket with a question have no row.

    A chunk's buckets stay with its row, and its vector is made where it is multiplied: of
    the corpus nothing is exchanged but each task's top k (dense_search).
    """
    asked = hash_vectors(questions, F.col("question"), dimension, "qid").withColumnRenamed("embedding", "query")
    buckets = F.transform(tokens(text), lambda t: hash_bucket(t, dimension))
    return dense_search(asked, chunks.select("chunk_id", "doc_id", "corpus_pos", buckets.alias("embedding")), k, tie="corpus_pos", hashed=dimension).where("score > 0")


def model_embedding(encode, dimension: int):
    """A column function that embeds text with `encode`, a function of a list of strings.

    The hook for neural encoders: texts travel in Arrow batches and `encode` is shipped
    once a task.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v))[:dimension] for v in encode(texts.fillna("").tolist())])

    return embed


#: tables of a saved index by backend
SPARSE_TABLES, DENSE_TABLES = ("postings", "lengths", "chunks"), ("vectors", "dense_meta")


def required_tables(backend: str = "auto") -> tuple[str, ...]:
    """Only hybrid retrieval can't do without the dense tables."""
    return DENSE_TABLES + SPARSE_TABLES if backend == "hybrid" else SPARSE_TABLES


def dense_meta(vectors: DataFrame, model: str, backend: str, query_prefix: str = "", document_prefix: str = "") -> DataFrame:
    """One row that says what the vectors are; their dimension is that of the longest."""
    row = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))
    return row.select(F.lit(model).alias("embedding_model_name"), F.lit(backend).alias("embedding_backend"), "dimension", F.lit(query_prefix).alias("query_prefix"), F.lit(document_prefix).alias("document_prefix"))


def check_index_meta(meta: DataFrame, **expected) -> None:
    """Raises unless the one-row metadata table has the expected values."""
    row = meta.first()
    if row is None:
        raise ValueError("the index has no metadata")
    wrong = {k: (row[k], v) for k, v in expected.items() if row[k] != v}
    if wrong:
        raise ValueError(f"index mismatch: {wrong}")


# --- fusion -------------------------------------------------------------------


def rrf(dense: DataFrame, sparse: DataFrame, k: int = FUSED_K, constant: int = RRF_K, bonus: Column | None = None) -> DataFrame:
    """Full outer merge of two ranked lists by reciprocal ranks.

    Both have qid, chunk_id, corpus_pos, score, rank. A missing score is 0. `bonus` may
    use any column of the merged row.
    """
    d = dense.select("qid", "chunk_id", F.col("corpus_pos").alias("d_pos"), F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("qid", "chunk_id", F.col("corpus_pos").alias("s_pos"), F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    part = lambda r: F.coalesce(1.0 / (constant + F.col(r)), F.lit(0.0))
    merged = d.join(s, ["qid", "chunk_id"], "full").select(
        "qid",
        "chunk_id",
        F.coalesce("d_pos", "s_pos").alias("corpus_pos"),
        F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"),
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"),
        F.col("dense_rank").isNotNull().alias("dense_hit"),
        F.col("bm25_rank").isNotNull().alias("bm25_hit"),
        F.round(part("dense_rank") + part("bm25_rank"), 8).alias("fusion_score"),
    )
    merged = merged.withColumn("heuristic_bonus", bonus if bonus is not None else F.lit(0.0))
    merged = merged.withColumn("final_retrieval_score", F.round(F.col("fusion_score") + F.col("heuristic_bonus"), 8))
    return best(k, "final_retrieval_score", "retrieval_rank")(merged)


def sparse_only(sparse: DataFrame, k: int = FUSED_K, constant: int = RRF_K) -> DataFrame:
    """The same columns from the sparse list alone; its rank before any scope filter counts."""
    fusion = F.round(1.0 / (constant + F.col("rank")), 8)
    rows = sparse.select("qid", "chunk_id", "corpus_pos", F.lit(0.0).alias("dense_score"), F.col("score").alias("bm25_score"), F.lit(False).alias("dense_hit"), F.lit(True).alias("bm25_hit"), fusion.alias("fusion_score"), F.lit(0.0).alias("heuristic_bonus"), fusion.alias("final_retrieval_score"))
    return best(k, "final_retrieval_score", "retrieval_rank")(rows)
