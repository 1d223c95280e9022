"""Structured Streaming into an index: late documents deduplicated, appended by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def documents_stream(spark: SparkSession, folder: str, schema: str = "id long, text string, metadata string, at timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival of each id; state older than the watermark is dropped."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["id"])


def counts_by_window(stream: DataFrame, by: str, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("at", delay).groupBy(F.window("at", width), by).agg(F.count("*").alias("n"))


def upsert(stream: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Writes each batch's new keys to a Parquet folder. A batch that runs again adds nothing, as its keys are there."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(target)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            rows = rows.join(spark.read.schema(batch.schema).parquet(target).select(key), key, "left_anti")
        rows.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
