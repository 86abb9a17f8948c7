"""BM25 of a stated set of questions against all chunks, with the top k kept in the task.

Joining postings with questions makes a row of nearly every pair, as most chunks share some
common word with a question. Here the corpus is tokenised once into a forward table (a row a
chunk: its length and the counts of the questions' tokens); document frequencies and the
mean length are sums over it; and a second pass multiplies each batch of chunks with the
questions' weights (those of the few tokens that many pairs share by a matrix product, the
others one by one) and keeps k chunks a question and task. No pair becomes a row before
that, and what is exchanged grows with tasks and questions, not with their product with the
corpus. Questions go to the tasks in blocks of a bounded size; beyond a vocabulary of
VOCABULARY tokens postings are joined instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokens
from lodestar.operators.held import CELLS, Held, places, runs
from lodestar.operators.retrieve import DIGITS, K1, TOP_K, B, idf, mean_okapi_idf, okapi, question_terms, top_k
from lodestar.sources.shared import fresh_folder, saved, ship

#: distinct tokens of all questions that may go to the tasks at once; (question, token) rows in a block
VOCABULARY, BLOCK_TERMS = 2_000_000, 1_000_000
#: of a slice of a batch: products that are summed into its score matrix, tokens that are counted
PRODUCTS, TOKENS = 1 << 20, 1 << 19
#: tokens of a block that are left to a matrix product, at most; cells of their matrix; the share of pairs from which that is cheaper
COMMON, COMMON_CELLS, DENSE = 160, 1 << 23, 1 / 250
#: tasks of the second pass for each core: what is exchanged grows with them
TASKS = 4


def _count(vocabulary, columns: list[str]):
    """Token lists to (columns, dl, ids, tfs) of known tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for whole in batches:
            width = whole.column(whole.num_columns - 1).value_lengths().fill_null(0).to_numpy()
            for at, n in runs(width, TOKENS, whole.num_rows):
                batch = whole.slice(at, n)
                lists = batch.column(batch.num_columns - 1)
                dl = width[at : at + n].astype(np.int64)
                flat = lists.flatten().dictionary_encode()
                code = np.array([known.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)
                token = code[flat.indices.to_numpy()] if len(code) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(n), dl)
                keep = token >= 0
                both, tf = np.unique(row[keep] * (len(known) + 1) + token[keep], return_counts=True)
                row, token = both // (len(known) + 1), both % (len(known) + 1)
                offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (token, tf)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(dl.astype(np.int32)), *lists], names=[*columns, "dl", "ids", "tfs"])

    return run


def _score(block, k: int, average: float, columns: list[str]):
    """Forward rows to the (qid, columns, score) that may be among a question's first k."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, first, question, weight, common, reports = block.value
        n = len(qids)
        if not n:
            return
        # where all weights are positive, a zero is a pair without a shared token
        any_sign = bool(len(weight)) and weight.min() <= 0
        held, times = Held(k, n, 10.0**-DIGITS, -np.inf if any_sign else 0.0), np.diff(first)
        slot, matrix = np.full(len(times), -1, np.int32), np.zeros((0 if any_sign else len(common), n))
        for i in range(len(matrix)):
            of = slice(first[common[i]], first[common[i] + 1])
            matrix[i, question[of]] = weight[of]
            slot[common[i]], times[common[i]] = i, 0
        asked_of = None if reports is None else np.array([-2 if r is None else i for i, r in enumerate(reports)])
        place = {} if reports is None else {r: [] for r in reports if r is not None}
        for i, r in enumerate(reports or ()):
            if r is not None:
                place[r].append(i)
        for whole in batches:
            width = whole.column(whole.num_columns - 2).value_lengths().to_numpy()
            token = whole.column(whole.num_columns - 2).flatten().to_numpy()
            cost = np.concatenate([[0], np.cumsum(times[token])])
            ends = np.cumsum(width)
            for at, count in runs(cost[ends] - cost[ends - width], PRODUCTS, max(1, CELLS // n)):
                rows = whole.slice(at, count)
                dl, ids, tfs = (rows.column(rows.num_columns - i) for i in (3, 2, 1))
                token, tf = ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(float)
                norm = K1 * (1 - B + B * dl.to_numpy() / average)
                row = np.repeat(np.arange(count), width[at : at + count])
                w = tf * (K1 + 1) / (tf + norm[row])
                shared, left = np.flatnonzero(slot[token] >= 0), np.zeros((count, len(matrix)))
                left[row[shared], slot[token[shared]]] = w[shared]
                scores = left @ matrix
                some = np.flatnonzero(times[token])
                of, many = token[some], times[token[some]]
                inner = np.repeat(first[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
                cell = np.repeat(row[some] * n, many) + question[inner]
                np.add.at(scores.reshape(-1), cell, np.repeat(w[some], many) * weight[inner])
                if any_sign:
                    scores[(np.bincount(cell, minlength=count * n) == 0).reshape(count, n)] = -np.inf
                if asked_of is not None:
                    inside = np.broadcast_to(asked_of == -2, scores.shape).copy()
                    for i, doc in enumerate(rows.column("doc_id").to_pylist()):
                        inside[i, place.get(doc, [])] = True
                    scores[~inside] = -np.inf
                rows = rows.select(columns)
                held.put(scores, rows, places(rows.column("corpus_pos")))
        for q, score, rows in held.found():
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), *rows.columns, pa.array(score)], names=["qid", *columns, "score"])

    return run


def bm25_scan(questions: DataFrame, chunks: DataFrame, text: Column | str, k: int = TOP_K, inside: bool = False, variant: str = "plain") -> DataFrame | None:
    """Top k a question: qid, chunk_id, doc_id, corpus_pos, score, rank; None if the questions' vocabulary is too large.

    Chunks without a token of the question have no row. `inside` ranks, for questions with a
    report_id, only chunks whose doc_id it is. Scores are rounded before ranking, ties go by
    corpus position. The okapi variant needs the mean over all of the corpus' tokens: their
    document frequencies are summed in the tasks before they are exchanged.
    """
    spark, columns = chunks.sparkSession, ["chunk_id", "doc_id", "corpus_pos"]
    ship(spark)
    folder = fresh_folder(spark, "scan")
    terms = saved(question_terms(questions), folder, "terms")
    vocabulary = terms.select("token").distinct().orderBy("token").limit(VOCABULARY + 1).toArrow().column("token").to_pylist()
    if len(vocabulary) > VOCABULARY:
        return None
    known = {t: i for i, t in enumerate(vocabulary)}
    rows = chunks.select(*columns, tokens(text).alias("tokens"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    forward = rows.mapInArrow(_count(spark.sparkContext.broadcast(known), columns), f"{kinds}, dl int, ids array<int>, tfs array<int>")
    forward = saved(forward, folder, "forward")
    n, average = forward.agg(F.count(F.lit(1)), F.avg("dl")).first()
    average = average or 1.0
    weight = okapi(F.lit(n), F.col("df"), F.lit(mean_okapi_idf(chunks, text, n))) if variant == "okapi" else idf(F.lit(n), F.col("df"))
    frequencies = forward.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).select("id", "df", weight.alias("idf"))
    ids = spark.createDataFrame(pa.table({"token": pa.array(vocabulary, pa.string()), "id": pa.array(range(len(vocabulary)), pa.int32())})) if vocabulary else spark.createDataFrame([], "token string, id int")
    weighted = terms.join(ids, "token").join(frequencies, "id").select("qid", "id", "df", (F.col("qtf") * F.col("idf")).alias("tw"))
    weighted = saved(weighted, folder, "weights")
    blocks, parts = max(1, -(-weighted.count() // BLOCK_TERMS)), None
    scoped = questions.select("qid", "report_id") if inside else None
    dealt = forward.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b
        some = weighted.where(mine).orderBy("id").toArrow()
        qids = some.column("qid").unique()
        code = some.column("qid").combine_chunks().dictionary_encode() if len(some) else None
        order = np.zeros(0, np.int64) if code is None else code.indices.to_numpy().astype(np.int64)
        qids = qids if code is None else code.dictionary
        token = some.column("id").to_numpy() if len(some) else np.zeros(0, np.int64)
        first = np.searchsorted(token, np.arange(len(vocabulary) + 1))
        # how many pairs share a token of the block
        pairs = np.zeros(len(vocabulary))
        pairs[token] = some.column("df").to_numpy() if len(some) else 0
        pairs *= np.diff(first)
        most = np.argsort(-pairs, kind="stable")[: min(COMMON, COMMON_CELLS // max(1, len(qids)))]
        common = most[pairs[most] > DENSE * n * len(qids)]
        reports = None
        if scoped is not None:
            of = dict(zip(*(c.to_pylist() for c in scoped.where(mine).toArrow().columns), strict=True))
            reports = [of.get(q) for q in qids.to_pylist()]
        shipped = spark.sparkContext.broadcast((qids, first, order, some.column("tw").to_numpy() if len(some) else np.zeros(0), common, reports))
        kind = terms.schema["qid"].dataType.simpleString()
        part = dealt.mapInArrow(_score(shipped, k, float(average), columns), f"qid {kind}, {kinds}, score double")
        parts = part if parts is None else parts.unionByName(part)
    return top_k(parts.withColumn("score", F.round("score", DIGITS)), k, ["qid"], [F.col("score").desc(), F.col("corpus_pos")])
