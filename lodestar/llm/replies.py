"""Answers that go back to parts of a saved table, without moving the table again.

An operator asks about the rows of a saved table part by part (column `part`), the answers
are computed by key after a shuffle, and a later scan of the same table needs those of its
own parts. They are written as one folder a part below the shared folder, so a task opens
the folder of the part it is reading; neither the rows nor all answers are moved to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Scratch


def save_replies(df: DataFrame, scratch: Scratch, name: str) -> str:
    """Writes df (part int, binary columns) by part; returns the folder."""
    path = scratch.folder(name)
    df.repartition(F.col("part")).write.partitionBy("part").parquet(path)
    return path


def load_replies(path: str, part: int) -> dict[str, bytes]:
    """The columns of a part's answers, each joined over its rows; empty where the part has none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    files = store.get_file_info(fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    out: dict[str, list[bytes]] = {}
    for found in sorted(files, key=lambda f: f.path):
        if found.base_name.startswith(("_", ".")):
            continue
        with store.open_input_file(found.path) as file:
            for batch in pq.ParquetFile(file).iter_batches():
                for column, values in zip(batch.schema.names, batch.columns, strict=True):
                    out.setdefault(column, []).extend(values.to_pylist())
    return {column: b"".join(values) for column, values in out.items()}


class Replies:
    """The answers to the part that is being read; those of the part before are let go."""

    def __init__(self, path: str, make) -> None:
        self.path, self.make, self.part, self.value = path, make, None, None

    def of(self, part: int):
        if part != self.part:
            self.part, self.value = part, self.make(load_replies(self.path, part))
        return self.value


def packed(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of equal values of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(keys)))
