"""Language identification with hyperdimensional profiles.

Every letter, of any script, has a random vector of +1 and -1, derived from a hash of its code
point; what is no letter is one boundary with a vector of its own. A letter trigram is bound as the
element-wise product of its letters' vectors, the first rotated by two places and the
second by one, so order matters; the vectors of different trigrams are nearly orthogonal.
A document's vector bundles (sums) its trigrams' vectors, a language's prototype those of
all its training documents, and a document gets the language whose prototype has the
largest cosine with it.

Prototypes are sums, so each partition counts trigrams per language and binds each
distinct trigram of a block once; per partition and language one vector of DIMENSIONS sums
goes through the shuffle. The model that reaches the driver has languages x DIMENSIONS numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import importable
from lodestar.llm.memory import remembered, serve
from lodestar.llm.wordhash import mix

DIMENSIONS = 1024
SEED = 11
#: bits of a code point in a trigram's code
BITS = 21
POINT = (1 << BITS) - 1
UNDETERMINED = "und"
#: documents whose counts are multiplied at a time, code points read at a time, and trigrams bound at a time
GROUP, SLICE, BIND = 128, 1 << 19, 4096
#: bound trigrams and letters' vectors that a worker remembers
MEMORY, LETTERS = 16_384, 8_192


@remembered(1)
def letter_table() -> np.ndarray:
    """Each code point's letter: itself, or 0 (the boundary) if it is none."""
    points = np.arange(0x110000, dtype=np.uint32)
    return np.where(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000), points, np.uint32(0))


def trigrams(text: str | None) -> np.ndarray:
    """Codes of the trigrams of a whole text, runs of non-letters being one boundary.

    Trigrams whose middle is a boundary are left out. Long texts are read in slices.
    """
    parts, carry = [], np.zeros(1, np.uint32)
    text = text or ""
    for at in range(0, len(text) or 1, SLICE):
        points = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kinds = letter_table()[points]
        last = at + SLICE >= len(text)
        kinds = np.concatenate([carry, kinds, np.zeros(int(last), np.uint32)])
        keep = np.ones(len(kinds), bool)
        keep[1:] = (kinds[1:] != 0) | (kinds[:-1] != 0)
        kinds = kinds[keep]
        if len(kinds) >= 3:
            wide = kinds.astype(np.int64)
            codes = (wide[:-2] << 2 * BITS) | (wide[1:-1] << BITS) | wide[2:]
            parts.append(codes[kinds[1:-1] != 0])
        carry = kinds[-2:]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Binder:
    """Vectors of trigrams; the most recent MEMORY of them are kept bound."""

    def __init__(self, dimensions: int, seed: int) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.known: dict[int, np.ndarray] = {}
        self.codes, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bound = np.zeros((MEMORY, dimensions), np.float32)

    def letters(self, points: list[int]) -> np.ndarray:
        """A row of +1 and -1 for each code point: the bits of hashes of it."""
        if len(self.known) > LETTERS:
            self.known.clear()
        new = np.array([p for p in points if p not in self.known], np.uint64)
        if len(new):
            words = np.arange(-(-self.dimensions // 64), dtype=np.uint64) + np.uint64(self.seed << 40)
            hashes = mix(mix(words)[None, :] ^ (new + np.uint64(1))[:, None] * np.uint64(0x9E3779B97F4A7C15))
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : self.dimensions]
            self.known.update(zip(new.tolist(), (2 * bits.astype(np.int8) - 1), strict=True))
        return np.array([self.known[p] for p in points], np.int8).reshape(-1, self.dimensions)

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        points, at = np.unique(np.concatenate([codes >> 2 * BITS, (codes >> BITS) & POINT, codes & POINT]), return_inverse=True)
        vectors = self.letters(points.tolist())
        first, second, third = at.reshape(3, -1)
        return np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct codes in ascending order, at most BIND of them."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(self.codes) + len(new) > MEMORY:
            self.codes, self.place, new = self.codes[:0], self.place[:0], codes
        if len(new):
            slots = np.arange(len(self.codes), len(self.codes) + len(new))
            self.bound[slots] = self._bind(new)
            merged = np.concatenate([self.codes, new])
            order = np.argsort(merged, kind="stable")
            self.codes, self.place = merged[order], np.concatenate([self.place, slots])[order]
        return self.bound[self.place[np.searchsorted(self.codes, codes)]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """counts: documents x codes; sums of counted vectors."""
        out = np.zeros((len(counts), self.dimensions), np.float32)
        for at in range(0, len(codes), BIND):
            out += counts[:, at : at + BIND] @ self.vectors(codes[at : at + BIND])
        return out


@remembered(1)
def binder(dimensions: int, seed: int) -> Binder:
    return Binder(dimensions, seed)


def bundles(texts: Iterable[str | None], bind: Binder) -> np.ndarray:
    """A row a text: its vector; zero where it has no letter."""
    rows, codes, counts = [], [], []
    for i, text in enumerate(texts):
        code, count = np.unique(trigrams(text), return_counts=True)
        rows.append(np.full(len(code), i))
        codes.append(code)
        counts.append(count)
    if not rows:
        return np.zeros((0, bind.dimensions), np.float32)
    distinct, column = np.unique(np.concatenate(codes), return_inverse=True)
    dense = np.zeros((len(rows), len(distinct)), np.float32)
    dense[np.concatenate(rows), column] = np.concatenate(counts)
    return bind.bundle(distinct.astype(np.int64), dense)


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order and their prototypes, from all rows with a language and a text.

    Repeated rows count one by one. A table without such rows gives no languages.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("language ID")
        totals: dict[str, np.ndarray] = {}
        bind = binder(dimensions, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    held.setdefault(lang, []).append(trigrams(text.as_py()))
                for lang, codes in held.items():
                    code, count = np.unique(np.concatenate(codes), return_counts=True)
                    total = totals.setdefault(lang, np.zeros(dimensions))
                    total += bind.bundle(code.astype(np.int64), count[None, :].astype(np.float32))[0]
        names, sums = list(totals), [t.tolist() for t in totals.values()]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(sums, pa.list_(pa.float64()))], names=["lang", "sums"])

    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = importable(rows).mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("d", "x"))
    summed = parts.groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r.lang for r in summed})
    prototypes, row = np.zeros((len(langs), dimensions)), {x: i for i, x in enumerate(langs)}
    for r in summed:
        prototypes[row[r.lang], r.d] = r.x
    return langs, prototypes


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[Column] | None = None, seed: int = SEED) -> DataFrame:
    """The `keep` columns of each row, then lang_pred and score.

    score is the cosine with the predicted language's prototype, 0 where it is negative.
    Texts that are null or have no letter, and all texts of a model without languages, are
    `und` with score 0. Of equal cosines the first language in order wins. Repeated rows are
    judged one by one, other columns are ignored, an empty table gives an empty result.
    """
    langs, prototypes = model
    dimensions = prototypes.shape[1]
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(norms == 0, 1, norms)).astype(np.float32)
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    names = df.select(*(keep or [])).columns
    rows = df.select(*kept, F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("language ID")
        bind = binder(dimensions, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                vectors = bundles((t.as_py() for t in part.column(part.num_columns - 1)), bind)
                size = np.linalg.norm(vectors, axis=1)
                if langs:
                    cosines = (vectors @ unit.T) / np.where(size == 0, 1, size)[:, None]
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)
                else:
                    best, score = np.zeros(len(size), int), np.zeros(len(size))
                known = (size > 0) & bool(langs)
                said = [langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                columns = [*part.columns[:-1], pa.array(said, pa.string()), pa.array(np.where(known, score, 0.0))]
                yield pa.record_batch(columns, names=schema.fieldNames())

    return importable(rows).mapInArrow(run, schema).toDF(*names, "lang_pred", "score")
