"""Quality classifier: a factorisation machine.

Inputs of a text: hashed words (buckets of the lower-cased words, weighted by the square
root of their share), structure statistics (ratios of letters, capitals, digits, marks,
line and word lengths, repeated words and lines, echoed words, each in steps of its own quantiles) and
numeric metadata columns that are named (as logarithms, in steps too; the registered query
names n_chars). Labels, language, source and id are never inputs. With weights w and factor rows v of RANK numbers,

    y = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

takes time linear in the inputs, and the score is 1 / (1 + exp(-y)).

The model is fitted on at most TRAIN labelled rows, those with the smallest hash of their
id; that bound is a parameter and the only sample here. Fitting is deterministic: an id with
clashing labels is left out, and of rows that repeat a labelled id one is taken, whatever
their order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import importable
from lodestar.llm.memory import serve

from lodestar.llm.wordhash import KEPT, span_hashes, spans

BUCKETS = 1 << 13
STEPS = 16
RANK = 6
TRAIN = 6_000
THRESHOLD = 0.3
STATISTICS = ("length", "words", "word_length", "capitals", "capital_words", "digits", "marks", "symbols", "bars", "exclamations", "line_length", "repeated_words", "repeated_lines", "top_word", "top_line", "spaces", "echoes", "symbol_runs")

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LINE = np.ones(256, bool)
_LINE[10] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 sentence mark, 4 symbol, 5 bar, 6 exclamation, 7 blank
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 4
_SYMBOL = _CLASS == 4
_CLASS[ord("|")], _CLASS[ord("!")], _CLASS[[9, 10, 11, 12, 13, 32]] = 5, 6, 7


def _tally(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)


def describe(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, word buckets and their values of one whole text, read in blocks of lines or words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words, lines, kinds, capital_words, n_words, echoes, symbol_runs = [], [], np.zeros(8, np.int64), 0, 0, 0, 0
    at = 0
    while at < len(raw):
        end = min(len(raw), at + KEPT)
        if end < len(raw):
            blanks = np.flatnonzero(_CLASS[raw[at:end]] == 7)
            end = at + int(blanks[-1]) + 1 if len(blanks) else end
        block = raw[at:end]
        lower = _LOWER[block]
        s, e = spans(lower, _WORD)
        hashes = span_hashes(lower, s, e)
        words.append(hashes)
        echoes += int((hashes[1:] == hashes[:-1]).sum())
        symbol_runs += len(spans(block, _SYMBOL)[0])
        capital_words += int(((block[s] >= 65) & (block[s] <= 90) & (block[np.minimum(s + 1, len(block) - 1)] >= 65) & (block[np.minimum(s + 1, len(block) - 1)] <= 90)).sum())
        n_words += len(s)
        lines.append(span_hashes(block, *spans(block, _LINE)))
        kinds += np.bincount(_CLASS[block], minlength=8)
        at = end
    w, w_n = _tally(words)
    _, l_n = _tally(lines)
    size, total, n_lines = max(1, len(raw)), max(1, n_words), max(1, int(l_n.sum()))
    letters = len(raw) - int(kinds[2:].sum())
    stats = np.array([
        np.log1p(len(raw)), np.log1p(n_words), letters / total, kinds[1] / size, capital_words / total, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        np.log1p(len(raw) / n_lines), 1 - len(w) / total, 1 - len(l_n) / n_lines, w_n.max(initial=0) / total, l_n.max(initial=0) / n_lines, kinds[7] / size, echoes / total, symbol_runs / total,
    ])
    bucket, where = np.unique((w % np.uint64(buckets)).astype(np.int64), return_inverse=True)
    return stats, bucket, np.sqrt(np.bincount(where, weights=w_n, minlength=len(bucket)) / total)


@dataclass
class Model:
    edges: np.ndarray  # statistics x STEPS - 1
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    buckets: int
    metadata: tuple[str, ...] = ()

    def inputs(self, described: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        stats, bucket, value = described
        step = (stats[:, None] > self.edges).sum(axis=1) + np.arange(len(stats)) * (self.edges.shape[1] + 1)
        return np.concatenate([step + self.buckets, bucket]), np.concatenate([np.full(len(step), 0.5), value])

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of rows whose inputs lie end to end; each row has some."""
        return 1 / (1 + np.exp(-np.clip(self._sum(index, value, starts)[0], -30, 30)))

    def _sum(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled * scaled).sum(axis=1), starts)
        y = self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)
        return y, sums, scaled


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, metadata: tuple[str, ...] = (), rank: int = RANK, epochs: int = 30, rate: float = 0.08, decay: float = 2e-5, seed: int = 5) -> Model:
    """Adagrad on the logistic loss in batches of 64; an empty or one-sided sample gives its rate as a constant."""
    n_stats = len(STATISTICS) + len(metadata)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    stats = np.array([r[0] for r in rows]).reshape(-1, n_stats)
    cuts = np.linspace(0, 1, STEPS + 1)[1:-1]
    edges = np.quantile(stats, cuts, axis=0).T if len(rows) else np.zeros((n_stats, STEPS - 1))
    size, rng = buckets + n_stats * STEPS, np.random.default_rng(seed)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)), buckets, metadata)
    if not len(labels) or labels.min() == labels.max():
        model.factors[:] = 0
        return model
    inputs = [model.inputs(r) for r in rows]
    g_bias, g_linear, g_factors = 1.0, np.ones(size), np.ones((size, rank))
    for _ in range(epochs):
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            lengths = np.array([len(inputs[i][0]) for i in chosen])
            index, value = (np.concatenate([inputs[i][k] for i in chosen]) for k in (0, 1))
            starts = np.concatenate([[0], lengths.cumsum()[:-1]])
            y, sums, scaled = model._sum(index, value, starts)
            error = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[chosen]
            each = np.repeat(error, lengths)
            d_linear = each * value
            d_factors = (each * value)[:, None] * (np.repeat(sums, lengths, axis=0) - scaled)
            touched, slot = np.unique(index, return_inverse=True)
            s_linear = np.bincount(slot, weights=d_linear) + decay * model.linear[touched]
            s_factors = np.stack([np.bincount(slot, weights=d_factors[:, f]) for f in range(rank)], axis=1) + decay * model.factors[touched]
            g_linear[touched] += s_linear**2
            g_factors[touched] += s_factors**2
            model.linear[touched] -= rate * s_linear / np.sqrt(g_linear[touched])
            model.factors[touched] -= rate * s_factors / np.sqrt(g_factors[touched])
            g_bias += error.sum() ** 2
            model.bias -= rate * error.sum() / np.sqrt(g_bias)
    return model


def _metadata(names: Iterable[str]) -> list[Column]:
    """Numeric columns as logarithms; null and negative values are -1."""
    number = lambda n: F.col(n).cast("double")
    return [F.coalesce(F.when(number(n) >= 0, F.log1p(number(n))), F.lit(-1.0)).alias(f"m{i}") for i, n in enumerate(names)]


def _described(part: pa.RecordBatch, first: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What describe() says of the texts in column `first`, with the metadata of the columns after it."""
    stated = np.array([c.to_pylist() for c in part.columns[first + 1 :]]).reshape(-1, part.num_rows)
    made = (describe(t.as_py(), buckets) for t in part.column(first))
    return [(np.concatenate([stats, stated[:, i]]), bucket, value) for i, (stats, bucket, value) in enumerate(made)]


def train(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: Iterable[str] = (), limit: int = TRAIN, buckets: int = BUCKETS) -> Model:
    """Fits on labelled rows for whose id `usable` (over column "id") holds, at most `limit` of them.

    Null ids and labels are left out, as are ids with two labels; of rows that repeat an id,
    the one with the least text (nulls first) counts. No labelled rows, or labels of one kind only,
    give a constant score.
    """
    metadata = tuple(metadata)
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(usable & F.col("id").isNotNull() & F.col("label").isNotNull())
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(limit)
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.col(text_col).alias("text"), *_metadata(metadata)).alias("row")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("row").alias("row")).orderBy("id").select("label", "row.*")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = _described(part, 1, buckets)
                yield pa.record_batch([part.column(0), pa.array([m[0] for m in made], pa.list_(pa.float64())), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.float64()))], names=["label", "stats", "bucket", "value"])

    got = importable(rows).mapInArrow(run, "label int, stats array<double>, bucket array<long>, value array<double>").toArrow()
    kept = [(np.array(s.as_py()), np.array(b.as_py(), dtype=np.int64), np.array(v.as_py())) for s, b, v in zip(got["stats"], got["bucket"], got["value"], strict=True)]
    return fit(kept, np.array(got["label"].to_pylist(), dtype=float), buckets, metadata)


def classify(df: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None, keep_text: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """The `keep` columns of each row, text by `keep_text`, then score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts are scored by their statistics alone. The model's metadata columns
    are read from df; other columns are ignored, repeated rows are scored one by one, an
    empty table gives an empty result.
    """
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    names = df.select(*(keep or [])).columns
    rows = df.select(*kept, F.col(text_col).alias("text"), *_metadata(model.metadata))
    first, passed = len(kept), len(kept) + keep_text
    schema = rows.select(*rows.columns[:passed]).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                inputs = [model.inputs(d) for d in _described(part, first, model.buckets)]
                starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in inputs])[:-1]]).astype(np.int64)
                score = model.score(np.concatenate([i for i, _ in inputs]), np.concatenate([v for _, v in inputs]), starts)
                yield pa.record_batch([*part.columns[:passed], pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.fieldNames())

    return importable(rows).mapInArrow(run, schema).toDF(*names, *(["text"] if keep_text else []), "score", "predicted")
