"""License scans: MinHash bands over overlapping text windows, then exact containment.

A template is a set of shingles of SHINGLE words (a template of fewer words is one shingle
of its own number of words, and has windows of such shingles). Documents are read in
overlapping windows, of a length and stride that follow from a template's number of
shingles t: up to eight, t and 1; beyond, six or eight strides, of a power of two, so that
some window covers any occurrence wholly.

Every window gets a MinHash signature, cut into bands of ROWS values; the templates that
share a band with it are retrieved. A window that contains the share CONTAINMENT of a
template has, in the worst case, the Jaccard similarity

    s = c / (length + t - c),    c = ceil(CONTAINMENT * t),

with it, and shares one of b bands with probability 1 - (1 - s^ROWS)^b. Each length has as
many bands as make that COLLISION at least. Retrieved templates are verified exactly: the share
of the template's distinct shingles that occur in the window must be CONTAINMENT at least.

Windows begin at a document's first word and never cross its end, so every document is
judged whole and by itself, and nothing is exchanged. Long documents are read in segments
that overlap by the longest window.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import importable
from lodestar.llm.license_texts import TEMPLATES
from lodestar.llm.memory import remembered, serve
from lodestar.llm.wordhash import KEPT, mix, span_hashes, spans

SHINGLE = 5
CONTAINMENT = 0.8
COLLISION = 0.999
ROWS = 2
#: shingles of a document that are read at a time (a multiple of all strides), and of a batch of documents
SEGMENT, BATCH = 1 << 16, 1 << 15
#: blocks of a window at most; that many less one separate documents that are read together
BLOCKS = 8

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: bytes) -> np.ndarray:
    """Hashes of the words (lower-cased A-Z, digits and all non-ASCII bytes), in blocks of bytes."""
    buffer, parts, at = np.frombuffer(raw, np.uint8), [], 0
    while at < len(buffer):
        end = min(len(buffer), at + KEPT)
        if end < len(buffer):
            gaps = np.flatnonzero(~_WORD[_LOWER[buffer[at:end]]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        lower = _LOWER[buffer[at:end]]
        parts.append(span_hashes(lower, *spans(lower, _WORD)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles_of(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Order-dependent hashes of runs of k words; fewer words make one shingle, none make none."""
    k = min(k, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    out = np.full(n, 0x1234567 + k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def window_of(t: int) -> tuple[int, int]:
    """Length and stride of the windows for a template of t shingles."""
    if t <= BLOCKS:
        return t, 1
    stride = 2
    while True:
        for blocks in (6, BLOCKS):
            if blocks * stride >= t + stride - 1:
                return blocks * stride, stride
        stride *= 2


def bands_for(distinct: int, length: int, containment: float = CONTAINMENT, collision: float = COLLISION, rows: int = ROWS) -> int:
    """Bands that retrieve a template of so many distinct shingles from a window that contains enough of them."""
    common = max(1, math.ceil(containment * distinct - 1e-9))
    s = min(1.0, common / (length + distinct - common))
    return 1 if s == 1 else math.ceil(math.log(1 - collision) / math.log1p(-(s**rows)))


@dataclass
class Windows:
    """Templates that are searched in windows of one length."""

    length: int
    stride: int
    bands: int = 0
    templates: list[int] = field(default_factory=list)
    #: by band: values of the band -> templates, and a bit for the low bits of each key
    tables: list[dict[tuple[int, ...], list[int]]] = field(default_factory=list)
    seen: list[np.ndarray] = field(default_factory=list)


def _low(values: list[np.ndarray]) -> np.ndarray:
    """Sixteen bits of a band's values."""
    out = values[0]
    for v in values[1:]:
        out = out * np.uint32(0x9E3779B1) ^ v
    return out & np.uint32(0xFFFF)


class Scanner:
    """Matches documents against the templates."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, collision: float = COLLISION, rows: int = ROWS, seed: int = 3) -> None:
        self.names = sorted(templates)
        words = [words_of(templates[n].encode()) for n in self.names]
        self.sets = [np.unique(shingles_of(w)) for w in words]
        self.containment, self.rows = containment, rows
        #: by words a shingle: windows by length
        self.windows: dict[int, dict[int, Windows]] = {}
        for t, (w, s) in enumerate(zip(words, self.sets, strict=True)):
            if len(s):
                k = min(SHINGLE, len(w))
                length, stride = window_of(len(w) - k + 1)
                held = self.windows.setdefault(k, {}).setdefault(length, Windows(length, stride))
                held.templates.append(t)
                held.bands = max(held.bands, bands_for(len(s), length, containment, collision, rows))
        most = max((w.bands for by in self.windows.values() for w in by.values()), default=0)
        self.factors = np.random.default_rng(seed).integers(1, 1 << 63, most * rows, dtype=np.uint64) | np.uint64(1)
        for by in self.windows.values():
            for w in by.values():
                for band in range(w.bands):
                    table: dict[tuple[int, ...], list[int]] = {}
                    seen = np.zeros(1 << 16, bool)
                    for t in w.templates:
                        values = [self._hash(self.sets[t], f).min(keepdims=True) for f in self._functions(band)]
                        table.setdefault(tuple(int(v[0]) for v in values), []).append(t)
                        seen[_low(values)] = True
                    w.tables.append(table)
                    w.seen.append(seen)

    def _functions(self, band: int) -> range:
        return range(band * self.rows, (band + 1) * self.rows)

    def _hash(self, shingles: np.ndarray, f: int) -> np.ndarray:
        return (shingles * self.factors[f] >> np.uint64(32)).astype(np.uint32)

    def retrieved(self, documents: list[np.ndarray], k: int) -> set[tuple[int, int, int, int]]:
        """(document, length, first shingle, template) of each window of k-word shingles and template that share a band."""
        by_length, found = self.windows[k], set()
        gap, sizes = BLOCKS - 1, np.array([len(d) for d in documents])
        strides = sorted({w.stride for w in by_length.values()})
        # where each document begins, by stride; gaps of the largest value separate them
        layout, gather, stride = {}, {}, 1
        while stride <= strides[-1]:
            n = -(-sizes // stride)
            begin = np.concatenate([[0], np.cumsum(n + gap)])
            layout[stride] = (begin, n)
            if stride > 1:
                above = layout[stride // 2][0]
                first = np.full(begin[-1], above[-1] - 1, np.int64)
                for d, m in enumerate(n.tolist()):
                    first[begin[d] : begin[d] + m] = above[d] + 2 * np.arange(m)
                gather[stride] = (first, np.minimum(first + 1, above[-1] - 1))
            stride *= 2
        begin = layout[1][0]
        whole, blank = np.zeros(begin[-1], np.uint64), np.full(begin[-1], 0xFFFFFFFF, np.uint32)
        for d, shingles in enumerate(documents):
            whole[begin[d] : begin[d] + len(shingles)] = shingles
            blank[begin[d] : begin[d] + len(shingles)] = 0
        for band in range(max(w.bands for w in by_length.values())):
            least: dict[int, list[np.ndarray]] = {}
            for f in self._functions(band):
                at_stride = self._hash(whole, f) | blank
                for stride in layout:
                    if stride > 1:
                        first, second = gather[stride]
                        at_stride = np.minimum(at_stride[first], at_stride[second])
                    of = [w for w in by_length.values() if w.stride == stride and band < w.bands]
                    sliding = [at_stride]
                    for w in of:
                        blocks = w.length // stride
                        while 2 << (len(sliding) - 1) <= blocks:
                            half = 1 << (len(sliding) - 1)
                            sliding.append(np.minimum(sliding[-1][:-half], sliding[-1][half:]))
                        power = blocks.bit_length() - 1
                        rest = blocks - (1 << power)
                        v = sliding[power]
                        least.setdefault(w.length, []).append(np.minimum(v[:-rest], v[rest:]) if rest else v)
            for length, values in least.items():
                w = by_length[length]
                begin, n = layout[w.stride]
                for i in np.flatnonzero(w.seen[band][_low(values)]).tolist():
                    for t in w.tables[band].get(tuple(int(v[i]) for v in values), ()):
                        d = int(np.searchsorted(begin, i, "right")) - 1
                        if i - begin[d] < n[d]:
                            found.add((d, length, int(i - begin[d]) * w.stride, t))
        return found

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (license, first word, words, containment), one row for each run of matching windows."""
        words = [words_of((t or "").encode()) for t in texts]
        hits: list[dict[int, list[tuple[int, int, float]]]] = [{} for _ in texts]
        for k, by_length in self.windows.items():
            longest = max(by_length)
            # parts of documents: (document, first shingle, shingles)
            parts: list[tuple[int, int, np.ndarray]] = []
            held = 0
            for d, w in enumerate(words):
                shingles = shingles_of(w, k) if len(w) >= k else w[:0]
                for at in range(0, len(shingles), SEGMENT):
                    parts.append((d, at, shingles[at : at + SEGMENT + longest]))
                    held += len(parts[-1][2])
                    if held >= BATCH:
                        self._verify(parts, k, hits)
                        parts, held = [], 0
            if parts:
                self._verify(parts, k, hits)
        out = []
        for w, found in zip(words, hits, strict=True):
            rows = [(self.names[t], a, min(b, len(w)) - a, share) for t, spans_of in found.items() for a, b, share in _merged(spans_of)]
            out.append(sorted(rows, key=lambda m: (m[1], m[0])))
        return out

    def _verify(self, parts: list[tuple[int, int, np.ndarray]], k: int, hits: list[dict[int, list[tuple[int, int, float]]]]) -> None:
        for p, length, first, t in self.retrieved([x for _, _, x in parts], k):
            d, at, shingles = parts[p]
            window = shingles[first : first + length]
            share = float(np.isin(self.sets[t], window).mean())
            if share >= self.containment - 1e-9:
                inside = at + first + np.flatnonzero(np.isin(window, self.sets[t]))
                hits[d].setdefault(t, []).append((int(inside[0]), int(inside[-1]) + k, share))


def _merged(hits: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Joins overlapping spans; the largest containment counts."""
    out: list[tuple[int, int, float]] = []
    for a, b, share in sorted(hits):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(share, out[-1][2]))
        else:
            out.append((a, b, share))
    return out


@remembered(4)
def _scanner(templates: tuple[tuple[str, str], ...], containment: float) -> Scanner:
    return Scanner(dict(templates), containment)


def license_scan(df: DataFrame, text_col: str = "text", keep: list[Column] | None = None, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """The `keep` columns of each row, then matches: array of (license, first_word, n_words, containment).

    Matches are ordered by first word and name; templates that match the same words, equal
    ones too, are all reported. Null, empty and word-less texts have an empty array, as have
    all texts if there are no templates; templates without words never match. Other columns
    are ignored, repeated rows are judged one by one, an empty table gives an empty result.
    """
    fixed = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    names = df.select(*(keep or [])).columns
    rows = df.select(*kept, F.col(text_col).alias("text"))
    schema = rows.drop("text").schema.add("matches", T.ArrayType(T.StructType().add("license", "string").add("first_word", "integer").add("n_words", "integer").add("containment", "double")))
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))
    fields = ("license", "first_word", "n_words", "containment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("license scan")
        scanner = _scanner(fixed, containment)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [[dict(zip(fields, m, strict=True)) for m in found] for found in scanner.scan(part.column(part.num_columns - 1).to_pylist())]
                yield pa.record_batch([*part.columns[:-1], pa.array(got, kind)], names=schema.fieldNames())

    return importable(rows).mapInArrow(run, schema).toDF(*names, "matches")
