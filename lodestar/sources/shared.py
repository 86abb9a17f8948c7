"""The folder that driver and executors share, tables written there, and a log of commits."""

from __future__ import annotations

import hashlib
import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that names none gets a temporary folder, kept in spark.lodestar.shared."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        fs, jpath = place(spark, named)
        return fs.makeQualified(jpath).toString().rstrip("/")
    own = spark.conf.get("spark.lodestar.shared", "")
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file:" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.lodestar.shared", own)
    return own


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes with the driver."""
    path = f"{shared_folder(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    fs, jpath = place(spark, path)
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table and reads it back, which cuts its lineage."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: applications that have this package already
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, as one archive in the shared folder, also those of executors that come later."""
    package = Path(__file__).resolve().parents[1]
    if spark.sparkContext.applicationId in _SHIPPED or not package.is_dir():
        return
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(file.relative_to(package.parent))), file.read_bytes())
    path = f"{shared_folder(spark)}/lodestar/lodestar-{hashlib.sha256(made.getvalue()).hexdigest()[:16]}-shared.zip"
    fs, jpath = place(spark, path)
    out = fs.create(jpath, True)
    out.write(bytearray(made.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(spark.sparkContext.applicationId)


class CommitLog:
    """Which batches of a folder count, in order.

    A batch's data is written to a folder of its own attempt, and then one small file in
    `_log`, which its number names, says what belongs to it. Creating that file fails if it
    is there, so of two drivers that commit at once one has to look again. A batch that is
    in the log is never added twice; what an attempt without an entry left is never read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> list[dict]:
        """Entries in order; their number is bounded by compaction (see `compact` of the index)."""
        fs, jpath = place(self.spark, f"{self.path}/_log")
        if not fs.exists(jpath):
            return []
        found = []
        for status in sorted(fs.listStatus(jpath), key=lambda s: s.getPath().getName()):
            name = status.getPath().getName()
            if name.endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    found.append(json.loads(bytes(stream.readAllBytes()).decode()))
                finally:
                    stream.close()
        return found

    def has(self, batch: str) -> bool:
        return any(batch in e["batches"] for e in self.entries())

    def attempt(self) -> str:
        """The name of a new folder for a batch's data, relative to the path."""
        return f"data/{uuid.uuid4().hex}"

    def commit(self, batch: str, after: int, **entry) -> bool:
        """Adds an entry for a batch as number `after`, the number of entries its work was based on; False if the batch is there."""
        if self.has(batch):
            return False
        fs, jpath = place(self.spark, f"{self.path}/_log/{after:08d}.json")
        fs.mkdirs(jpath.getParent())
        temporary = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps({"batches": [batch], **entry}).encode()))
        out.close()
        # a rename onto a file that is there is refused or fails
        if fs.exists(jpath) or not fs.rename(temporary, jpath):
            fs.delete(temporary, False)
            raise RuntimeError(f"another driver has committed entry {after} of {self.path}; do the batch again")
        return True


def append_once(df: DataFrame, path: str, batch: str, form: str = "json") -> bool:
    """Appends a table's rows under a batch id; a batch that is sent again changes nothing and gives False."""
    log = CommitLog(df.sparkSession, path)
    entries = log.entries()
    if any(batch in e["batches"] for e in entries):
        return False
    folder = log.attempt()
    df.write.format(form).save(f"{path}/{folder}")
    return log.commit(batch, len(entries), folder=folder, form=form)


def read_appended(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows of committed batches; without any, an empty table, which needs the schema. Without a schema it is inferred."""
    entries = CommitLog(spark, path).entries()
    forms = {e["form"] for e in entries}
    if not entries:
        return spark.createDataFrame([], schema)
    out = None
    for form in sorted(forms):
        reader = spark.read.format(form) if schema is None else spark.read.format(form).schema(schema)
        part = reader.load([f"{path}/{e['folder']}" for e in entries if e["form"] == form])
        out = part if out is None else out.unionByName(part)
    return out
