"""Helpers that several training-data operators share."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (local tests) a temporary folder is used,
    and kept for the session in spark.lodestar.scratch.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        # with its scheme, so that Spark's readers and Arrow's mean the same folder
        fs, place = _hadoop(spark, named)
        whole = fs.makeQualified(place).toString().rstrip("/")
        return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole
    own = spark.conf.get("spark.lodestar.scratch", "")
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.lodestar.scratch", own)
    return own


#: bytes of an Arrow batch, where the session sets none: a worker holds a batch or two, however long its texts
BATCH_BYTES = 8 << 20
#: applications that have this package already
_SHIPPED: set[str] = set()


def importable(df: DataFrame) -> DataFrame:
    """The same table; the session's Python workers can then import this package and get batches of bounded size.

    The package's files go to the shared folder as one archive, which Spark hands to every
    worker, also to those of executors that come later.
    """
    spark, package = df.sparkSession, Path(__file__).resolve().parents[1]
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.conf().contains(limit):
        spark.conf.set(limit, str(BATCH_BYTES))
    if spark.sparkContext.applicationId not in _SHIPPED and package.is_dir():
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as archive:
            for file in sorted(package.rglob("*.py")):
                archive.writestr(zipfile.ZipInfo(str(file.relative_to(package.parent))), file.read_bytes())
        path = f"{shared_root(spark)}/lodestar/lodestar-{hashlib.sha256(made.getvalue()).hexdigest()[:16]}.zip"
        fs, place = _hadoop(spark, path)
        out = fs.create(place, True)
        out.write(bytearray(made.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(spark.sparkContext.applicationId)
    return df


class Scratch:
    """A fresh folder below the shared one for intermediate tables.

    Writing a table and reading it back cuts the lineage: losing an executor
    costs the running stage only. What isn't dropped before goes with the driver.
    """

    #: scratches made inside `dropping`, innermost last
    _made: list[list[Scratch]] = []

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.path = f"{root or shared_root(spark)}/lodestar/{uuid.uuid4().hex}"
        self._n = 0
        fs, place = _hadoop(spark, self.path)
        fs.mkdirs(place)
        fs.deleteOnExit(place)
        if Scratch._made:
            Scratch._made[-1].append(self)

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, folder: str | None = None) -> None:
        """Deletes one folder of this scratch, or all of it."""
        fs, place = _hadoop(self.spark, folder or self.path)
        fs.delete(place, True)

    @staticmethod
    @contextmanager
    def dropping() -> Iterator[None]:
        """Drops all scratches made inside; for use around work whose results are stored elsewhere."""
        Scratch._made.append([])
        try:
            yield
        finally:
            for scratch in Scratch._made.pop():
                scratch.drop()
