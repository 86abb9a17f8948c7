"""Harmonic packing of documents into fixed-capacity sequences.

Class i (1 to CLASSES) holds pieces of length in (C/(i+1), C/i]; a bin of class i takes
exactly i of them. Cutting is free, so what a class would waste is bounded: a remainder
whose class would leave more than SLACK of its share unused gives its largest reciprocal
share C/(i+1) to that class as a full piece, and the rest is classed again. Each task packs
its own documents and keeps at most i - 1 open pieces a class. At its end those leftovers
are laid end to end and cut at the capacity; the last run is split by powers of two,
which need no padding. No exchange is needed, and a task holds the ids of its open pieces
(fewer than CLASSES sequences) and of the document at hand, however many documents it packs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import importable
from lodestar.llm.memory import serve

from lodestar.llm.tokens import END_ID, encoder

CAPACITY = 4096
CLASSES = 64
SLACK = 1 / 32

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long"

#: doc_id, start, ids, tokens of the document
Piece = tuple[int | None, int, np.ndarray, int]


def cut(length: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[tuple[int, int]]:
    """(class, length) of the pieces of a document; class 0: shorter than any class."""
    out = [(1, capacity)] * (length // capacity)
    rest = length % capacity
    while rest:
        i = capacity // rest
        if i > classes:
            out.append((0, rest))
            break
        if capacity - i * rest <= slack * capacity or i == classes:
            out.append((i, rest))
            break
        share = capacity // (i + 1)
        out.append((i + 1, share)) if i + 1 <= classes else out.append((0, share))
        rest -= share
    return out


class Packer:
    """Packs pieces as they come; flush() gives what is left."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> None:
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.next, self.open = first_id, {}

    def _close(self, pieces: list[Piece], out: list[tuple]) -> None:
        used = sum(len(p[2]) for p in pieces)
        padded = used if used & (used - 1) == 0 else self.capacity
        at = 0
        for doc_id, start, ids, total in pieces:
            out.append((doc_id, start, len(ids), ids.tobytes(), total, self.next, at, used, padded))
            at += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray, out: list[tuple]) -> None:
        start = 0
        for kind, n in cut(len(ids), self.capacity, self.classes, self.slack):
            part = ids[start : start + n]
            # a piece that stays open is a copy, not a view that would keep its whole document
            piece = (doc_id, start, part.copy() if kind != 1 else part, len(ids))
            start += n
            held = self.open.setdefault(kind, [])
            held.append(piece)
            if kind and len(held) == kind:
                self._close(held, out)
                self.open[kind] = []
            elif not kind and sum(len(p[2]) for p in held) >= self.capacity:
                self.open[0] = self._fill(held, out)

    def _fill(self, pieces: Iterable[Piece], out: list[tuple], size: int | None = None) -> list[Piece]:
        """Lays pieces end to end and closes sequences of exactly `size`; what is left over."""
        size, held, used = size or self.capacity, [], 0
        for doc_id, start, ids, total in pieces:
            while len(ids):
                n = min(len(ids), size - used)
                held.append((doc_id, start, ids[:n], total))
                start, ids, used = start + n, ids[n:], used + n
                if used == size:
                    self._close(held, out)
                    held, used = [], 0
        return held

    def flush(self, out: list[tuple]) -> None:
        held = self._fill([p for kind in sorted(self.open) for p in self.open[kind]], out)
        self.open = {}
        while held:
            used = sum(len(p[2]) for p in held)
            size = 1 << (used.bit_length() - 1)
            head, room = [], size
            rest: list[Piece] = []
            for doc_id, start, ids, total in held:
                n = min(len(ids), room)
                if n:
                    head.append((doc_id, start, ids[:n], total))
                if len(ids) > n:
                    rest.append((doc_id, start + n, ids[n:], total))
                room -= n
            self._close(head, out)
            held = rest


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, sequence_tokens, padded_to.

    A document's ids are those of its whole text and `end_id`; null and empty texts are that
    id alone. Ids are numbers, and text that isn't one raises; rows with a null or repeated
    id are packed like any others. sequence_id holds
    the task's number in its upper bits. Other columns are ignored. An empty table gives no
    rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serve("tokens")
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4")
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, classes, slack)
        out: list[tuple] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                for doc_id, raw in zip(ids[lo : lo + 256], encode.encode(texts.slice(lo, 256).to_pylist()), strict=True):
                    packer.add(doc_id, np.concatenate([np.frombuffer(raw, "<u4"), end]), out)
                yield _batch(out)
                out = []
        packer.flush(out)
        yield _batch(out)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return importable(rows).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to")
    return pa.record_batch({n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)})
