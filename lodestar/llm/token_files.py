"""Token ids in Arrow IPC files of fixed-size lists, and their readers.

The documents are range-partitioned by id (sampled splitters of the id alone), sorted,
and every task writes its partition as one or more Arrow files. A file is a stream of
tokens cut into sequences of SEQUENCE ids: column `ids` is a fixed-size list of unsigned
integers as narrow as the vocabulary allows, `mask` a fixed-size list of booleans that is
false in the padding of the file's last sequence. All sequences have one length, nothing is
compressed, so sequence k of a memory-mapped file is a slice at a known offset: no
copying, no parsing. A second Arrow file beside it says which tokens belong to which
document. Tasks write under a temporary name and rename, so a task that is run again
(after a lost executor, or speculatively) replaces its file by an equal one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import importable
from lodestar.llm.memory import serve

from lodestar.llm.tokens import END_ID, encoder

SEQUENCE = 2048
#: sequences in a record batch
BATCH = 256
#: tokens after which a task starts another file
FILE_TOKENS = 1 << 25


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenWriter:
    """Writes one Arrow file of equal-length sequences and one of document places."""

    def __init__(self, folder: str, name: str, sequence: int = SEQUENCE, dtype: str = "<u2") -> None:
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.root, self.name, self.sequence, self.dtype = root, name, sequence, np.dtype(dtype)
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.temporary = f"{root}/.{name}.{np.random.default_rng().integers(1 << 62):x}"
        self.sink = self.fs.open_output_stream(self.temporary)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.tokens = 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.places: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.places.append((doc_id, self.tokens, len(ids)))
        self.tokens += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.sequence * BATCH:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        """Writes full batches, and at last also a partial one: all batches but the last are alike."""
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        unit = self.sequence * (1 if last else BATCH)
        whole = len(flat) // unit * unit
        body, rest = flat[:whole], flat[whole:]
        mask = np.ones(len(body), bool)
        if last and len(rest):
            body = np.concatenate([body, rest, np.zeros(self.sequence - len(rest), self.dtype)])
            mask = np.concatenate([mask, np.ones(len(rest), bool), np.zeros(self.sequence - len(rest), bool)])
            rest = rest[:0]
        per = self.sequence * BATCH
        for at in range(0, len(body), per):
            ids, ok = pa.array(body[at : at + per]), pa.array(mask[at : at + per])
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(ids, self.sequence), pa.FixedSizeListArray.from_arrays(ok, self.sequence)], schema=self.schema))
        self.held, self.n_held = [rest], len(rest)

    def close(self) -> tuple[str, int]:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()
        docs, start, n = zip(*self.places, strict=True) if self.places else ((), (), ())
        table = pa.table({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64())})
        place = f"{self.temporary}.docs"
        with self.fs.open_output_stream(place) as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table, max_chunksize=1 << 16)
        self.fs.move(place, f"{self.root}/{self.name}.docs.arrow")
        self.fs.move(self.temporary, f"{self.root}/{self.name}.arrow")
        return f"{self.name}.arrow", self.tokens


class TokenFile:
    """Random access to one file: sequence(k), mask(k), tokens(start, n), places()."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = file_system(folder)
        self.root, self.name = root, name
        self.reader = pa.ipc.open_file(self._open(f"{root}/{name}"))
        self.length = self.reader.schema.field("ids").type.list_size
        first = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1
        self.per = max(1, first)
        self._at, self._batch = -1, None

    def _open(self, path: str) -> pa.NativeFile:
        from pyarrow import fs

        return pa.memory_map(path) if isinstance(self.fs, fs.LocalFileSystem) else self.fs.open_input_file(path)

    def _values(self, k: int, column: int) -> pa.Array:
        """The flat values of batch k; a view of the mapped file."""
        if self._at != k:
            self._at, self._batch = k, self.reader.get_batch(k)
        return self._batch.column(column).flatten()

    def sequence(self, k: int) -> np.ndarray:
        flat = self._values(k // self.per, 0).to_numpy(zero_copy_only=True)
        return flat[(k % self.per) * self.length :][: self.length]

    def mask(self, k: int) -> np.ndarray:
        return self._values(k // self.per, 1).slice((k % self.per) * self.length, self.length).to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> np.ndarray:
        span, parts = self.per * self.length, []
        while n > 0:
            k, at = divmod(start, span)
            part = self._values(k, 0).to_numpy(zero_copy_only=True)[at : at + n]
            if not len(part):
                raise ValueError(f"{self.name} ends before token {start}")
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u2")

    def places(self) -> Iterator[tuple[int | None, int, int]]:
        reader = pa.ipc.open_file(self._open(f"{self.root}/{self.name[: -len('.arrow')]}.docs.arrow"))
        for k in range(reader.num_record_batches):
            yield from zip(*(c.to_pylist() for c in reader.get_batch(k).columns), strict=True)


def write_token_files(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes all documents in ascending id order; one row a file: part, at, name, n_tokens.

    Ids are numbers. Every document ends with `end_id`; null and empty texts are that id
    alone. Rows with a null id come first; rows that repeat an id follow one another in the
    order of their texts' hashes, so that an id that many rows share is split over tasks and
    a task that runs again writes the same file. Other columns are ignored. An empty table gives no files. Evaluating the result writes the files, so save
    it once (see `token_files`).
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serve("tokens")
        encode = encoder(tokenizer)
        dtype = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        part, done, out = TaskContext.get().partitionId(), [], None
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 256):
                for doc_id, raw in zip(ids[lo : lo + 256], encode.encode(texts.slice(lo, 256).to_pylist()), strict=True):
                    if out is None:
                        out = TokenWriter(folder, f"part-{part:06d}-{len(done):04d}", sequence, dtype)
                    out.add(doc_id, np.concatenate([np.frombuffer(raw, "<u4"), end]))
                    if out.tokens >= file_tokens:
                        done.append(out.close())
                        out = None
        if out is not None:
            done.append(out.close())
        yield pa.record_batch({"part": pa.array([part] * len(done), pa.int32()), "at": pa.array(range(len(done)), pa.int32()), "name": pa.array([x[0] for x in done], pa.string()), "n_tokens": pa.array([x[1] for x in done], pa.int64())})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ("id", F.xxhash64("text"))
    rows = importable(rows).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return rows.mapInArrow(write, "part int, at int, name string, n_tokens long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """Reads documents back from the files: doc_id, start (ids before it in all files), n_tokens, ids (binary, little-endian unsigned 32-bit).

    `files` is the saved result of `write_token_files`: a row a file, so the running total
    over it is over the number of files, not of documents.
    """
    total = Window.orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "at", "name", F.coalesce(F.sum("n_tokens").over(total), F.lit(0)).alias("base"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(folder, name)
                rows, size = [], 0
                for doc_id, start, n in file.places():
                    raw = file.tokens(start, n).astype("<u4").tobytes()
                    rows.append((doc_id, base + start, n, raw))
                    size += len(raw)
                    if size > 1 << 23:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    n = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return importable(placed).select("name", "base").repartition(max(n, 4 * n), "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, raw = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.array(raw, pa.binary())})


def _clear_temporary(folder: str) -> None:
    """Deletes what failed tasks left; finished files have other names."""
    from pyarrow import fs

    store, root = file_system(folder)
    for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if found.base_name.startswith("."):
            store.delete_file(found.path)


def token_files(spark: SparkSession, df: DataFrame, folder: str, **how) -> tuple[DataFrame, str]:
    """Writes the files once and returns their saved listing and the folder of the files."""
    files = f"{folder}/tokens"
    listing = write_token_files(df, files, **how)
    listing.write.mode("overwrite").parquet(f"{folder}/listing")
    _clear_temporary(files)
    return spark.read.schema("part int, at int, name string, n_tokens long").parquet(f"{folder}/listing"), files
