"""Incremental ingest over a landing folder with Structured Streaming (an extension: the batch pipeline polls a queue)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.text import content_hash
from gleaner.operators.common import insert_absent

ARTIFACT = "artifact_id long, source string, url string, content string, collected timestamp"


def artifact_stream(spark: SparkSession, landing: str, late: str = "2 days") -> DataFrame:
    """New artifacts, one per content within the watermark; state is bounded by it."""
    df = spark.readStream.schema(ARTIFACT).parquet(landing)
    hashed = df.withColumn("content_hash", content_hash(F.col("content"))).withWatermark("collected", late)
    return hashed.dropDuplicatesWithinWatermark(["content_hash"])


def _known(spark: SparkSession, table: str, wanted: DataFrame) -> DataFrame:
    """The hashes of a batch's own buckets that earlier batches have stored; none before the first."""
    buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
    try:
        return spark.read.schema("content_hash string, bucket string, batch long").parquet(f"{table}_hashes").filter(F.col("bucket").isin(buckets)).select("content_hash", "batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "content_hash string, batch long")


def ingest(spark: SparkSession, landing: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append artifacts whose content the table lacks.

    Hashes are a table of their own beside the artifacts, in folders by their first two digits, so a batch reads the folders of its own hashes only, and of these one column. Both tables are written in
    a folder of the batch's number, overwritten where a batch is repeated after a failure, and a repeated batch leaves its own earlier hashes out of account: restarts are safe.
    """

    def append(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("bucket", F.substring("content_hash", 1, 2))
        known = _known(batch.sparkSession, table, marked).filter(F.col("batch") < number)
        new = insert_absent(marked, known, ["content_hash"])
        new.drop("bucket").write.mode("overwrite").parquet(f"{table}/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{table}/batch={number}").select("content_hash", F.substring("content_hash", 1, 2).alias("bucket"), F.lit(number).cast("long").alias("batch"))
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{table}_hashes")

    return artifact_stream(spark, landing).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source_activity(spark: SparkSession, landing: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Artifacts per source and window of event time, late ones up to the watermark."""
    df = spark.readStream.schema(ARTIFACT).parquet(landing).withWatermark("collected", late)
    return df.groupBy(F.window("collected", window).alias("w"), "source").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source", "n")
