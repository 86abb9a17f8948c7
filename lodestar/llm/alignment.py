"""How two tokenizers cut the same text: a sweep over the ends of their tokens.

Every text is encoded by both, and the ends of A's and of B's tokens become events of one
union. Events travel in blocks, an array of ids for the tokens of one side that end in one
range of BLOCK bytes (an end is the sum of the lengths of the tokens before, so an id says
it); they are dealt by document and sorted within their partition by offset. A machine
streams through them with the state of one unfinished group, and emits a group at every
offset where both sides end, and the link between the tokens that end there.

How often a pair of ids is linked in the corpus is summed from the distinct pairs of each
part of the swept table; a part gets the counts of its own pairs back (see `replies`), so no
table of all pairs has to fit anywhere, and a pair that is in every text is one entry a part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch, importable
from lodestar.llm.memory import remembered, serve
from lodestar.llm.replies import Replies, runs, save_replies
from lodestar.llm.tokens import _byte_letters

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: bytes of a text whose tokens' ends make one event row of either side
BLOCK = 1 << 16
#: characters of a text that are encoded at a time; distinct pairs a task holds before it sends them
PIECE, PAIRS = 1 << 20, 500_000
#: rows that a task looks at, and bytes of ids that it sends, at a time: workers stay small
SLICE, SENT = 256, 1 << 20
#: pairs that the parts ask for in one bucket
PER_BUCKET = 50_000
#: texts of these characters (Latin, Greek, Cyrillic, kana, common Han, Hangul), whose classes are the same in all versions of Unicode, are encoded by ranks
_PLAIN = re.compile("[\t\n\r -~\u00a0-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u045f\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


class Bytes:
    """A: byte-level BPE of the tokenizers library.

    Where the file has the plain pattern and its merges in the order of their ids, plain
    texts are encoded by tiktoken with the file's ranks, which gives the same ids sooner.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letter = {c: b for b, c in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        plain = {t: bytes(letter[c] for c in t) for t in vocabulary if all(c in letter for c in t)}
        self.bytes = [b""] * (1 + max(vocabulary.values(), default=0))
        for t, i in vocabulary.items():
            self.bytes[i] = plain.get(t, t.encode())
        made = json.loads(self.tokenizer.to_str())
        model = made["model"]
        ids = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model.get("merges", [])]
        alike = made["pre_tokenizer"] == _PRE and not made["normalizer"] and None not in ids and all(a < b for a, b in zip(ids, ids[1:], strict=False)) and len(model["vocab"]) == 256 + len(ids)
        self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks={plain[t]: i for t, i in model["vocab"].items()}, special_tokens={}) if alike else None

    def encode(self, text: str) -> list[int]:
        """The ids of space + text."""
        if self.fast is not None and _PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(" " + text)
        return self.tokenizer.encode(" " + text, None, False, False).ids


class Pieces:
    """B: sentencepiece, which adds a space before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: no piece goes on after a space, so a text can be cut before one
        self.apart = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.model.is_control(i))

    def encode(self, text: str) -> list[int]:
        """The ids of space + text."""
        return self.model.encode(text)


@remembered(1)
def tokenizers(a: str | None, b: str | None) -> tuple[Bytes, Pieces]:
    if a is None or b is None:
        import public_tokenizers

        a, b = a or public_tokenizers.path(VOCABULARIES[0]), b or public_tokenizers.path(VOCABULARIES[1])
    return Bytes(a), Pieces(b)


def narrow(width: int) -> np.dtype:
    """The type of a token's number in a vocabulary of that size."""
    return np.dtype("<u2" if width <= 1 << 16 else "<u4")


def pair_code(widths: list[int]) -> str:
    """The type of a pair's code a * width of B + b."""
    return "<u8" if widths[0] * widths[1] > 1 << 32 else "<u4"


class Spelling:
    """The bytes of tokens, many at a time."""

    def __init__(self, spelt: list[bytes]) -> None:
        self.length = np.array([len(x) for x in spelt], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.first[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes()


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """A text in parts, cut at single spaces between other characters; such a space goes with the part behind it.

    Neither tokenizer joins across such a space: byte-level patterns begin anew there, and so do pieces.
    """
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end + 1


_EVENT = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("side", pa.int8()), ("piece", pa.int32()), ("ids", pa.binary())])


def _events(a: str | None, b: str | None, block: int):
    """Event rows of a text: those of side 0 (A) and 1 (B) by range of bytes, and one at -1 with the document's id."""

    def of(raw: bytes, sides: tuple[Bytes, Pieces], spellings: list[Spelling], kinds: list[np.dtype]) -> tuple[bool, list[tuple[int, int, int, bytes]]]:
        out: list[tuple[int, int, int, bytes]] = []
        place = 0
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return False, []
        for number, piece in enumerate(pieces_of(text) if sides[1].apart and sides[0].fast else [text]):
            want = b" " + piece.encode()
            for side, tokenizer in enumerate(sides):
                ids = np.array(tokenizer.encode(piece), kinds[side])
                if spellings[side].of(ids) != want:
                    return False, []
                if place // block == (place + len(want) - 1) // block:
                    out.append((place // block, side, number, ids.tobytes()))
                    continue
                range_of = np.maximum(place + np.cumsum(spellings[side].length[ids]) - 1, 0) // block
                first, n = runs(range_of)
                out += [(int(range_of[f]), side, number, ids[f : f + k].tobytes()) for f, k in zip(first, n, strict=True)]
            place += len(want)
        return True, out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serve("alignment")
        sides = tokenizers(a, b)
        spellings, kinds = [Spelling(s.bytes) for s in sides], [narrow(len(s.bytes)) for s in sides]
        key = TaskContext.get().partitionId() << 33
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                batch = whole.slice(lo, SLICE)
                rows, size = [], 0
                for i, raw in enumerate(batch.column(0)):
                    ok, events = of(text, sides, spellings, kinds) if (text := raw.as_py()) else (False, [])
                    rows.append((key + i, -1, 0, 0, b"", i))
                    rows += [(key + i, *event, None) for event in events] if ok else []
                    size += sum(len(e[3]) for e in events)
                    if size > SENT or i == batch.num_rows - 1:
                        *columns, which = zip(*rows, strict=True)
                        carried = [c.take(pa.array(which, pa.int32())) for c in batch.columns[1:]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, _EVENT, strict=True)), *carried], names=[*_EVENT.names, *batch.schema.names[1:]])
                        rows, size = [], 0
                key += batch.num_rows

    return run


class Machine:
    """The state of one document's sweep: the tokens since the last offset where both sides ended."""

    def __init__(self, lengths: list[np.ndarray]) -> None:
        """lengths: bytes of each token of A and of B, which is all that a sweep needs to know of a tokenizer."""
        self.lengths = [x.astype(np.int64) for x in lengths]
        self.width = [len(x) for x in lengths]
        # a token's number with the mark behind it (more of its side, the other side, the next group), filled up with zero bytes
        marked = [f"{i}{mark}".encode() for n, marks in zip(self.width, (",|", ",;"), strict=True) for mark in marks for i in range(n)]
        wide = max(map(len, marked), default=1)
        self.table = np.array(marked, f"S{wide}").view(np.uint8).reshape(-1, wide)

    def begin(self) -> None:
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.ends = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.last = [0, 0]
        self.n = [0, 0]
        self.groups = 0
        self.sha, self.held = hashlib.sha256(), b""

    def event(self, side: int, ids: np.ndarray) -> None:
        ids = ids.astype(np.int64)
        ends = self.last[side] + np.cumsum(self.lengths[side][ids])
        if len(ids):
            self.last[side] = int(ends[-1])
        self.n[side] += len(ids)
        self.ids[side] = np.concatenate([self.ids[side], ids])
        self.ends[side] = np.concatenate([self.ends[side], ends])

    def advance(self) -> np.ndarray:
        """Ends all groups whose end is known; returns their links as pairs of ids."""
        (a, b), (ea, eb) = self.ids, self.ends
        if not len(a) or not len(b):
            return np.zeros((0, 2), np.int64)
        low = min(int(ea[0]), int(eb[0]))
        there = np.zeros((2, max(int(ea[-1]), int(eb[-1])) - low + 1), bool)
        there[0, ea - low] = there[1, eb - low] = True
        common = np.flatnonzero(there[0] & there[1]) + low  # a token without bytes ends where the one before did, so it belongs to that group
        if not len(common):
            return np.zeros((0, 2), np.int64)
        last = int(common[-1])
        cut = [int(np.searchsorted(e, last, side="right")) for e in (ea, eb)]
        before = np.cumsum(there[0] & there[1])  # groups that end at an offset or earlier
        ended = [(there[0] & there[1])[e[:c] - low] for e, c in zip((ea, eb), cut, strict=True)]
        group = [before[e[:c] - low] - x for e, c, x in zip((ea, eb), cut, ended, strict=True)]
        size = [np.bincount(g, minlength=len(common)) for g in group]
        upto = [np.cumsum(n) for n in size]
        parts = []
        for side, x in enumerate((a, b)):
            part = x[: cut[side]].copy()
            part[upto[side] - 1] += self.width[side]  # the last of its group has the other mark behind it
            parts.append(part)
        both = np.empty(cut[0] + cut[1], np.int64)
        both[np.arange(cut[0]) + (upto[1] - size[1])[group[0]]] = parts[0]
        both[np.arange(cut[1]) + upto[0][group[1]]] = parts[1] + 2 * self.width[0]
        letters = self.table[both].ravel()
        text = self.held + letters[letters != 0].tobytes()
        self.held = text[-1:]  # the mark behind the last group waits for another one
        self.sha.update(text[:-1])
        at = [np.flatnonzero(x) for x in ended]
        if len(at[0]) == len(at[1]) == len(common):
            links = np.stack([a[at[0]], b[at[1]]], axis=1)
        else:
            links = self._links([a[at[0]], b[at[1]]], [g[i] for g, i in zip(group, at, strict=True)])
        self.groups += len(common)
        self.ids = [a[cut[0] :], b[cut[1] :]]
        self.ends = [ea[cut[0] :], eb[cut[1] :]]
        return links

    @staticmethod
    def _links(ids: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
        """All pairs of an A and a B token that end a group; one each but for tokens without bytes."""
        first, n = runs(groups[1])
        slot = np.searchsorted(groups[1][first], groups[0])
        times = n[slot]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.stack([np.repeat(ids[0], times), ids[1][np.repeat(first[slot], times) + inner]], axis=1)


def _sweep(lengths):
    """Sorted events to one row a document: counts, checksum, and its links as codes a * width + b."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serve("alignment-sweep")  # frees the tokenizers
        machine = Machine(lengths.value)
        kinds, code_kind = [narrow(n) for n in machine.width], pair_code(machine.width)
        part, width = TaskContext.get().partitionId(), np.int64(machine.width[1])
        now, head, names = None, None, []
        links: list[np.ndarray] = []
        done: list[tuple] = []
        heads: list[pa.RecordBatch] = []
        size, range_at = 0, -1

        def finish() -> None:
            nonlocal size
            has = bool(machine.n[0])
            links.append(machine.advance())
            code = np.concatenate([x[:, 0] * width + x[:, 1] for x in links])
            done.append((part, *machine.n, machine.groups, len(code), machine.sha.hexdigest() if has else "", code.astype(code_kind).tobytes()))
            heads.append(head)
            size += 4 * len(code) + 200
            links.clear()

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), *[pa.int64()] * 4, pa.string(), pa.binary()), strict=True)]
            carried = pa.Table.from_batches(heads).combine_chunks()
            return pa.RecordBatch.from_arrays([*columns, *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in carried.columns)], names=[*_SWEPT, *carried.schema.names])

        for batch in batches:
            keys, ranges, side, _, ids = (batch.column(i) for i in range(5))
            keys, ranges, side = keys.to_numpy(), ranges.to_numpy(), side.to_numpy()
            names = batch.schema.names[5:]
            for i in range(batch.num_rows):
                if keys[i] != now:
                    if now is not None:
                        finish()
                    now = keys[i]
                    head = pa.RecordBatch.from_arrays([c.slice(i, 1) for c in batch.columns[5:]], names=names)
                    machine.begin()
                    range_at = -1
                    if size > SENT:
                        yield rows()
                        done.clear()
                        heads.clear()
                        size = 0
                if ranges[i] >= 0:
                    if range_at >= 0 and ranges[i] != range_at:
                        links.append(machine.advance())
                    range_at = ranges[i]
                    machine.event(int(side[i]), np.frombuffer(ids[i].as_py(), kinds[side[i]]))
        if now is not None:
            finish()
            yield rows()

    return run


_SWEPT = ("part", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")


def _distinct_pairs(code: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("alignment-sweep")
        part, keys, counts, held, waiting = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, []

        def send(p: int) -> pa.RecordBatch:
            return pa.record_batch({"part": pa.array([p] * len(keys), pa.int32()), "pair": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

        def fold() -> None:
            nonlocal keys, counts, waiting, held
            new, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (keys[:0], counts[:0])
            both, where = np.unique(np.concatenate([keys, new.astype(np.uint64)]), return_inverse=True)
            keys, counts = both, np.bincount(where, np.concatenate([counts, n]).astype(float), len(both)).astype(np.int64) if len(both) else counts[:0]
            waiting, held = [], 0

        for batch in batches:
            for p, raw in zip(batch.column(0).to_numpy().tolist(), batch.column(1).to_pylist(), strict=True):
                if part is not None and p != part:
                    fold()
                    yield send(part)
                    keys, counts = keys[:0], counts[:0]
                part = p
                waiting.append(np.frombuffer(raw, code))
                held += len(waiting[-1])
                if held > 1 << 18:
                    fold()
                    if len(keys) > PAIRS:
                        yield send(part)
                        keys, counts = keys[:0], counts[:0]
        if part is not None:
            fold()
            yield send(part)

    return run


def _asks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each part as one array a bucket."""
    serve("alignment-sweep")
    for batch in batches:
        bucket, part, pair = (batch.column(i).to_numpy() for i in range(3))
        order = np.lexsort((bucket, part))
        bucket, part, pair = bucket[order], part[order], pair[order].astype("<u8")
        first, n = runs(part.astype(np.int64) << 32 | bucket)
        yield pa.record_batch({"bucket": pa.array(bucket[first], pa.int32()), "part": pa.array(part[first], pa.int32()), "asked": pa.array([pair[a : a + k].tobytes() for a, k in zip(first, n, strict=True)], pa.binary())})


def _answers(asks: pa.Table, counts: pa.Table) -> pa.Table:
    """Of a bucket: each part's pairs with their counts and whether they are their B id's best."""
    known = np.stack([counts[c].to_numpy().astype("<u8") for c in ("pair", "n", "best")], axis=1)
    known = known[np.argsort(known[:, 0], kind="stable")]
    answers = [known[np.searchsorted(known[:, 0], np.frombuffer(x, "<u8"))].tobytes() for x in asks["asked"].to_pylist()]
    return pa.table({"part": asks["part"].cast(pa.int32()), "answer": pa.array(answers, pa.binary())})


def _counted(path: str, code: str):
    def table(found: dict[str, bytes]) -> np.ndarray:
        values = np.frombuffer(found.get("answer", b""), "<u8").reshape(-1, 3)
        return values[np.argsort(values[:, 0], kind="stable")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("alignment-sweep")
        known = Replies(path, table)
        for batch in batches:
            best, total = [], []
            for p, raw in zip(batch.column(0).to_numpy().tolist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                mine = known.of(p)
                at = np.searchsorted(mine[:, 0], np.frombuffer(raw, code).astype(np.uint64))
                best.append(int(mine[at, 2].sum()))
                total.append(int(mine[at, 1].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:-1], pa.array(best, pa.int64()), pa.array(total, pa.int64())], names=[*batch.schema.names[1:-1], "n_best", "count_sum"])

    return run


def token_alignment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, keep_links: bool = False, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and by `keep_links` links.

    a: file of a byte-level BPE of the tokenizers library, which encodes space + text; b:
    file of a sentencepiece model, which adds that space itself; special tokens' strings are
    plain text to both. Tokens are bytes, their ends offsets in space + text; offsets where
    both sides end cut the tokens into groups, and the tokens that end there are linked.
    n_best counts links whose pair is, for its B id, the one linked most in the whole table,
    ties included; count_sum adds up the links of the links' pairs. groups_sha256 is that of
    `a1,a2|b1;a3|b2,b3`. links: little-endian codes A id * size of B + B id, 32 bits wide if
    they fit, else 64.

    Texts that are null, empty, not valid UTF-8, or that a side doesn't give back byte by
    byte have no tokens: zeros and ''. Rows that repeat are documents of their own; ids may be null,
    repeated, and of any type; other columns are ignored whatever their names. An empty
    table gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession)
    docs = importable(df.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id")))
    kind = docs.schema["id"].dataType.simpleString()
    events = docs.mapInArrow(_events(a, b, block), f"key long, at long, side tinyint, piece int, ids binary, id {kind}")
    events = events.repartition("key").sortWithinPartitions("key", "at", "side", "piece")
    lengths = [np.array([len(x) for x in s.bytes], np.uint32) for s in tokenizers(a, b)]
    tokenizers.cache_clear()  # the driver needs no more of them
    swept = events.mapInArrow(_sweep(df.sparkSession.sparkContext.broadcast(lengths)), f"part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, id {kind}")
    swept = scratch.save(swept, "swept")
    sizes = [len(x) for x in lengths]
    code = pair_code(sizes)
    pairs = scratch.save(swept.select("part", "links").mapInArrow(_distinct_pairs(code), "part int, pair long, n long"), "pairs")
    buckets = max(1, pairs.count() // PER_BUCKET)
    bucket = F.pmod(F.xxhash64("pair"), F.lit(buckets)).cast("int").alias("bucket")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    best = F.max("n").over(Window.partitionBy(F.col("pair") % sizes[1])) == F.col("n")
    counts = counts.select(bucket, "pair", "n", best.cast("long").alias("best"))
    asks = importable(pairs.select(bucket, "part", "pair")).mapInArrow(_asks, "bucket int, part int, asked binary")
    answers = asks.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_answers, "part int, answer binary")
    answers = save_replies(answers, scratch, "counts")
    final = swept.select("part", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["links"] if keep_links else []), F.col("links").alias("own"))
    out = final.select(*final.columns[1:-1], F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    made = importable(final).mapInArrow(_counted(answers, code), out.schema)
    return made.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["links"] if keep_links else []))
