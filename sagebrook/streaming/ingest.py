"""ST1, ST2: incremental ingest of content versions, and event-time daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C


def file_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def versioned_ingest(stream: DataFrame, target: str, checkpoint: str, url: str, content: str, at: str) -> StreamingQuery:
    """ST1: each batch adds its (url, content_hash, first_seen, last_seen, times) as one part of ``target``.

    A batch's part has the batch's number as its partition and overwrites itself when a
    batch is run again, so the sink is exactly-once; ``versions`` merges the parts.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.select(F.col(url).alias("url"), C.content_hash(F.col(content)).alias("content_hash"), F.col(at).alias("at"))
        part = seen.groupBy("url", "content_hash").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("times"))
        part.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, target: str) -> DataFrame:
    """ST1: the content versions of all batches so far."""
    return spark.read.parquet(target).groupBy("url", "content_hash").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times").alias("times")
    )


def daily_counts(stream: DataFrame, at: str, distinct: str, late: str = "1 day") -> DataFrame:
    """ST2: rows and approximately distinct entities for each day of event time; later rows than ``late`` don't count."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, "1 day")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(distinct).alias("entities")).select(
        F.to_date("window.start").alias("day"), "n", "entities"
    )
