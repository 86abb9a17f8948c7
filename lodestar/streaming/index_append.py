"""Extension: a stream of new documents kept in the inverted index.

The reference has no streaming operator; this keeps the batch index current. Each
micro-batch writes its postings and lengths under its own batch id, so a batch that is
replayed after a failure overwrites its earlier attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.retrieve import lengths, postings
from lodestar.operators.segments import SegmentIndex
from lodestar.sources.adapters import document_chunks


def append_batch(documents: DataFrame, batch_id: int, index: str) -> None:
    chunks = document_chunks(documents)
    postings(chunks, "text").write.mode("overwrite").parquet(f"{index}/postings/batch={batch_id}")
    lengths(chunks, "text", "doc_id", "corpus_pos").write.mode("overwrite").parquet(f"{index}/lengths/batch={batch_id}")


def follow(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """Reads new Parquet files below `source` until they are used up, then stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: append_batch(df, n, index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_segments(spark: SparkSession, source: str, schema: str, index: str, checkpoint: str, files_per_batch: int = 16) -> StreamingQuery:
    """The same into a SegmentIndex, where a document that comes again replaces its earlier version.

    A micro-batch that is replayed is in the index's log already and changes nothing; of a
    document that stands twice in one, the version with the larger checksum counts.
    """

    def apply(df: DataFrame, n: int) -> None:
        last = df.groupBy("doc_id").agg(F.max_by(F.struct(*df.columns), F.xxhash64("text")).alias("d")).select("d.*")
        SegmentIndex(df.sparkSession, index).apply(f"stream-{n}", document_chunks(last).withColumn("key", F.col("chunk_id")))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{index}/postings").drop("batch"), spark.read.parquet(f"{index}/lengths").drop("batch")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means per event type and tumbling window; late rows count within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
