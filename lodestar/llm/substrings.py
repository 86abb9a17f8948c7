"""Removal of long passages that repeat anywhere, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of (window + 1) / 2 words, so any
window holds a whole block of its text. The blocks are indexed and probed with every rolling
run of as many words: where two windows are equal, the block in one is met by the rolling
run at the same place in the other. A run that is met is an anchor, and each anchor is
extended to both sides to all windows that hold it. Equal windows meet by a 128-bit hash;
consecutive windows that repeat make up the maximal exact repeats, whose words go.

Nothing is paired: the index keeps a value once a part of the table, with marks whether it
is a block there and whether it stands there more than once, so a passage with a million
copies costs its parts' entries, not their products. Both rounds send, by part and bucket of
the hash, an array of values and get back, by part, those that repeat. Buckets are dealt by
the number of words, so each has some 10^6 values whatever the table's size; within one, an
anchor's 30 bits only serve as a filter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import wordhash
from lodestar.llm.common import Scratch, importable
from lodestar.llm.memory import serve
from lodestar.llm.replies import Replies, packed, runs, save_replies

WINDOW = 35
#: words a bucket aims at
BUCKET_WORDS = 1_000_000
#: bytes of texts that are hashed at a time, and words whose entries are sent at a time
BLOCK, SEGMENT = 1 << 20, 1 << 21
_SPACES = b" \t\n\x0b\x0c\r"
_INSIDE = np.ones(256, bool)
_INSIDE[list(_SPACES)] = False
_LETTERS = np.random.default_rng(35).integers(1 << 62, size=256).astype(np.uint64)
#: words of more bytes than that get a hash that no choice of letters can make collide
LONG_WORD = 256
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool) -> list[np.ndarray]:
    """One or two independent 64-bit hashes of each word; the buffer is at most a block, or one word."""
    n = len(buffer)
    powers, inverse = wordhash._kept() if n <= wordhash.KEPT else (wordhash._powers(wordhash.BASE, n), wordhash._powers(pow(wordhash.BASE, -1, 1 << 64), n))
    out, prefix = [], np.zeros(n + 1, np.uint64)
    for letters in (_LETTERS, np.roll(_LETTERS, 97) ^ np.uint64(_A))[: 1 + second]:
        np.cumsum(letters[buffer] * powers[:n], out=prefix[1:])
        out.append(wordhash.mix((prefix[ends] - prefix[starts]) * inverse[starts]))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        digest = np.frombuffer(hashlib.blake2b(buffer[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), "<u8")
        for h, own in zip(out, digest, strict=False):
            h[i] = own
    return out


def rolling(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """Hash of each run of n values, put together from runs whose lengths are powers of two."""
    if len(h) < n:
        return h[:0]
    out, done, power, width = None, 0, h, 1
    while True:
        if n & width:
            out = power if out is None else out[: len(power) - done] + np.uint64(pow(factor, done, 1 << 64)) * power[done:]
            done += width
        if 2 * width > n:
            return wordhash.mix(out)
        power = power[: len(power) - width] + np.uint64(pow(factor, width, 1 << 64)) * power[width:]
        width *= 2


def blocks(raw: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text in blocks cut at white space, so that no word is cut."""
    at = 0
    while at < len(raw):
        end = at + size
        if end < len(raw):
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            end = cut if cut > at else end
            while end < len(raw) and raw[end] not in _SPACES:  # a word longer than a block
                end += 1
        yield raw[at:end]
        at = end


class Stream:
    """Words of a part's texts as hashes, a group of short texts or a block of a long one at a time."""

    def __init__(self, window: int, second: bool) -> None:
        self.window, self.second = window, second

    def groups(self, texts: Iterable[bytes | None]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """(hashes, text's number a word, word's place in its text), in order.

        A later block of a long text begins with the last window - 1 words of the one before.
        """
        held, size = [], 0
        for i, raw in enumerate(texts):
            if raw is not None and len(raw) > BLOCK:
                if held:
                    yield self._short(held)
                    held, size = [], 0
                yield from self._long(i, raw)
            elif raw:
                held.append((i, raw))
                size += len(raw)
                if size > BLOCK // 2:
                    yield self._short(held)
                    held, size = [], 0
        if held:
            yield self._short(held)

    def _short(self, held: list[tuple[int, bytes]]) -> tuple:
        buffer = np.frombuffer(b" ".join(raw for _, raw in held), np.uint8)
        starts, ends = wordhash.spans(buffer, _INSIDE)
        first = np.cumsum([0] + [len(raw) + 1 for _, raw in held[:-1]])
        which = np.searchsorted(first, starts, side="right") - 1
        number = np.array([i for i, _ in held], np.int64)[which]
        at = np.arange(len(starts)) - np.searchsorted(which, which)
        return word_hashes(buffer, starts, ends, self.second), number, at

    def _long(self, i: int, raw: bytes) -> Iterator[tuple]:
        tail: list[np.ndarray] | None = None
        done = 0
        for block in blocks(raw):
            buffer = np.frombuffer(block, np.uint8)
            h = word_hashes(buffer, *wordhash.spans(buffer, _INSIDE), self.second)
            n = len(h[0])
            if tail is not None:
                h = [np.concatenate(x) for x in zip(tail, h, strict=True)]
            at = np.arange(len(h[0])) + done + n - len(h[0])
            yield h, np.full(len(at), i, np.int64), at
            done += n
            tail = [x[max(0, len(x) - self.window + 1) :] for x in h]


def _whole(number: np.ndarray, n: int) -> np.ndarray:
    """For each run of n words whether it lies in one text."""
    return number[: len(number) - n + 1] == number[n - 1 :] if len(number) >= n else np.zeros(0, bool)


def _anchors(h: np.ndarray, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 30 bits of each rolling run of `block` words, in one number each."""
    g = rolling(h, block, _B)
    return (g >> np.uint64(34)) % np.uint64(buckets) << np.uint64(30) | g & np.uint64((1 << 30) - 1)


def _windows(h: list[np.ndarray], window: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window: the bucket is a function of the first half."""
    return rolling(h[0], window, _A), rolling(h[1], window, _B)


def _bucket(first: np.ndarray, buckets: int) -> np.ndarray:
    return (first >> np.uint64(20)) % np.uint64(buckets)


_ASKED = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("asked", pa.binary())])


def _dealt(part: int, bucket: np.ndarray, record: np.ndarray) -> pa.RecordBatch:
    """A row a bucket; records are sorted by bucket."""
    first, n = runs(bucket)
    return packed({"bucket": bucket[first].astype(np.int32), "part": [part] * len(first), "asked": [record[a : a + k].tobytes() for a, k in zip(first, n, strict=True)]}, _ASKED)


def _by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes | None], pa.RecordBatch]]:
    """Rows of one part at a time: its number, the texts, the rows."""
    for batch in batches:
        parts = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                rows = batch.slice(a, b - a)
                yield int(parts[a]), rows.column(1).to_pylist(), rows


class _Held:
    """Gathers a part's values up to SEGMENT words; then, or when the part ends, they are sent."""

    def __init__(self, send) -> None:
        self.send, self.part, self.n, self.kept = send, None, 0, []

    def put(self, part: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if part != self.part or self.n >= SEGMENT:
            yield from self.flush()
        self.part = part
        self.kept.append(columns)
        self.n += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield self.send(self.part, *(np.concatenate(c) for c in zip(*self.kept, strict=True)))
        self.n, self.kept = 0, []


def _ask_anchors(block: int, window: int, buckets: int):
    def send(part: int, value: np.ndarray, is_block: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(value, kind="stable")
        value, is_block = value[order], is_block[order]
        first, n = runs(value)
        marks = np.maximum.reduceat(is_block, first).astype(np.uint32) | (n > 1).astype(np.uint32) << np.uint32(1)
        value = value[first]
        return _dealt(part, value >> np.uint64(30), (value & np.uint64((1 << 30) - 1)).astype(np.uint32) << np.uint32(2) | marks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("substrings")
        stream, held = Stream(block, False), _Held(send)
        for part, texts, _ in _by_part(batches):
            for (h,), number, at in stream.groups(texts):
                ok = _whole(number, block)
                yield from held.put(part, _anchors(h, block, buckets)[ok], (at[: len(ok)] % block == 0)[ok])
        yield from held.flush()

    return run


def _anchors_met(table: pa.Table) -> pa.Table:
    """Of a bucket: the values that are a block somewhere and stand in more than one place, back to their parts."""
    asked = [np.frombuffer(x, np.uint32) for x in table["asked"].to_pylist()]
    flat = np.concatenate(asked)
    order = np.argsort(flat >> np.uint32(2), kind="stable")
    value = (flat >> np.uint32(2))[order]
    first, n = runs(value)
    marks = np.bitwise_or.reduceat(flat[order] & np.uint32(3), first)
    met = np.zeros(len(flat), bool)
    met[order] = np.repeat((marks & 1 > 0) & ((n > 1) | (marks & 2 > 0)), n)
    return _answered(table, asked, met, lambda x, bucket: (np.uint64(bucket) << np.uint64(30) | (x >> np.uint32(2)).astype(np.uint64)).tobytes())


def _answered(table: pa.Table, asked: list[np.ndarray], met: np.ndarray, form) -> pa.Table:
    parts, answers, at = [], [], 0
    for bucket, part, x in zip(table["bucket"].to_pylist(), table["part"].to_pylist(), asked, strict=True):
        mine = met[at : at + len(x)]
        at += len(x)
        if mine.any():
            parts.append(part)
            answers.append(form(x[mine], bucket))
    return pa.table({"part": pa.array(parts, pa.int32()), "answer": pa.array(answers, pa.binary())})


def _ask_windows(block: int, window: int, buckets: int, anchors: str):
    def send(part: int, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        bucket = _bucket(first, buckets)
        order = np.lexsort((second, first, bucket))
        bucket, both = bucket[order], np.stack([first[order], second[order]], axis=1)
        new = np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])
        at = np.flatnonzero(new)
        repeats = np.diff(np.append(at, len(both))) > 1
        record = np.zeros(len(at), _RECORD)
        record["first"], record["second"], record["repeats"] = both[at, 0], both[at, 1], repeats
        return _dealt(part, bucket[at], record)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("substrings")
        stream, held = Stream(window, True), _Held(send)
        known = Replies(anchors, lambda found: np.unique(np.frombuffer(found.get("answer", b""), np.uint64)))
        for part, texts, _ in _by_part(batches):
            live = known.of(part)
            if not len(live):
                continue
            for h, number, _ in stream.groups(texts):
                ok = _whole(number, window)
                if not len(ok):
                    continue
                value = _anchors(h[0], block, buckets)
                hit = live[np.minimum(np.searchsorted(live, value), len(live) - 1)] == value
                seen = np.concatenate([[0], np.cumsum(hit)])
                inside = window - block + 1  # places of an anchor in a window
                ok &= seen[inside : inside + len(ok)] > seen[: len(ok)]
                first, second = _windows(h, window, buckets)
                yield from held.put(part, first[ok], second[ok])
        yield from held.flush()

    return run


_MADE = ("n_words", "n_removed", "kept_sha256", "kept_text")
_RECORD = np.dtype([("first", "<u8"), ("second", "<u8"), ("repeats", "u1")])


def _windows_repeated(table: pa.Table) -> pa.Table:
    """Of a bucket: the windows that begin in more than one place, back to their parts."""
    asked = [np.frombuffer(x, _RECORD) for x in table["asked"].to_pylist()]
    flat = np.concatenate(asked)
    order = np.lexsort((flat["second"], flat["first"]))
    a, b = flat["first"][order], flat["second"][order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    n = np.diff(np.append(at, len(a)))
    again = np.maximum.reduceat(flat["repeats"][order], at)
    met = np.zeros(len(flat), bool)
    met[order] = np.repeat((n > 1) | (again > 0), n)
    return _answered(table, asked, met, lambda x, _: np.stack([x["first"], x["second"]], axis=1).tobytes())


def _kept_words(raw: bytes, covered: np.ndarray | None) -> tuple[int, str]:
    """Number of words, and the checksum of those not covered, joined by one space."""
    sha, n, any_yet = hashlib.sha256(), 0, False
    for block in blocks(raw):
        words = block.split()
        keep = words if covered is None else list(compress(words, (~covered[n : n + len(words)]).tolist()))
        n += len(words)
        if keep:
            sha.update(b" " + b" ".join(keep) if any_yet else b" ".join(keep))
            any_yet = True
    return n, sha.hexdigest()


def _remove(window: int, buckets: int, windows: str, texts_too: bool):
    both = np.dtype([("a", "<u8"), ("b", "<u8")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("substrings")
        stream = Stream(window, True)
        known = Replies(windows, lambda found: np.unique(np.frombuffer(found.get("answer", b""), both)))
        for part, texts, rows in _by_part(batches):
            live = known.of(part)
            live_a = live["a"]
            covered: dict[int, np.ndarray] = {}
            for h, number, at in stream.groups(texts) if len(live) else ():
                ok = _whole(number, window)
                if not len(ok):
                    continue
                first, second = _windows(h, window, buckets)
                lo = np.searchsorted(live_a, first)
                maybe = np.flatnonzero(ok & (live_a[np.minimum(lo, len(live_a) - 1)] == first))
                if not len(maybe):
                    continue
                pairs = np.zeros(len(maybe), both)
                pairs["a"], pairs["b"] = first[maybe], second[maybe]
                where = maybe[live[np.minimum(np.searchsorted(live, pairs), len(live) - 1)] == pairs]
                for i in np.unique(number[where]).tolist():
                    mine = at[where[slice(*np.searchsorted(number[where], [i, i + 1]))]]
                    edge = covered.get(i, np.zeros(0, np.int32))
                    size = int(at[np.searchsorted(number, i + 1) - 1]) + 2
                    edge = np.concatenate([edge, np.zeros(max(0, size - len(edge)), np.int32)])
                    edge[mine] += 1
                    edge[mine + window] -= 1
                    covered[i] = edge
            out = []
            for i, raw in enumerate(texts):
                gone = np.cumsum(covered[i])[:-1] > 0 if i in covered else None
                if gone is not None:  # words after the last block with a repeat
                    gone = np.concatenate([gone, np.zeros(max(0, len(raw or b"") // 2 + 1 - len(gone)), bool)])
                n, sha = _kept_words(raw or b"", gone)
                out.append((n, 0 if gone is None else int(gone.sum()), sha, b" ".join(compress((raw or b"").split(), (~gone).tolist())) if texts_too and gone is not None else raw))
            n, removed, sha, text = zip(*out, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
            if texts_too:
                made.append(pa.array(text, pa.binary()))
            yield pa.RecordBatch.from_arrays([*rows.columns[2:], *made], names=[*rows.schema.names[2:], *_MADE[: len(made)]])

    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: list[Column] | None = None, keep_text: bool = False, bucket_words: int = BUCKET_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, then the `keep` columns and, by `keep_text`, kept_text.

    Words are runs of bytes other than ASCII white space. Of every window of `window` words
    that begins in more than one place of the table, the same text included, all words go;
    windows are judged on the input. kept_sha256 is that of the kept words joined by one
    space; kept_text is those words where some went, else the text as it was. Null and empty
    texts have no words; rows that repeat one another repeat each other's windows; a text of
    fewer words than a window stays. Ids may be null, repeated and of any type, other columns
    are ignored whatever their names. An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    kept = [c.alias(f"k{i}") for i, c in enumerate(keep or [])]
    names = df.select(*(keep or [])).columns
    block = (window + 1) // 2
    rows = df.select(F.spark_partition_id().alias("part"), F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"), *kept)
    rows = scratch.save(rows.withColumn("size", F.octet_length("text").cast("long")), "rows")  # fixes which part a row belongs to
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, int(size) // (6 * bucket_words))
    rows = importable(rows.drop("size"))
    asked = "bucket int, part int, asked binary"
    answer = "part int, answer binary"
    texts = rows.select("part", "text")
    anchors = texts.mapInArrow(_ask_anchors(block, window, buckets), asked).groupBy("bucket").applyInArrow(_anchors_met, answer)
    anchors = save_replies(anchors, scratch, "anchors")
    repeated = texts.mapInArrow(_ask_windows(block, window, buckets, anchors), asked).groupBy("bucket").applyInArrow(_windows_repeated, answer)
    repeated = save_replies(repeated, scratch, "windows")
    kinds = [F.lit(None).cast(kind).alias(name) for name, kind in zip(_MADE, ("long", "long", "string", "binary"), strict=True)]
    out = rows.select(*rows.columns[2:], *kinds[: 3 + keep_text])
    made = rows.mapInArrow(_remove(window, buckets, repeated, keep_text), out.schema)
    return made.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_removed",
        "kept_sha256",
        *(F.col(f"k{i}").alias(n) for i, n in enumerate(names)),
        *([F.col("kept_text").cast("string").alias("kept_text")] if keep_text else []),
    )
