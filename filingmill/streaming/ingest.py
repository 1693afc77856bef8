"""Announcement feeds as streams: repeated polls become exactly one row for each announcement.

An extension: a crawler that asks again and again for overlapping days delivers the same rows many times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.merge import insert_ignore
from ..staging import exists


def polled(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """The feed's files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def deduplicated(feed: DataFrame, key: str, time: str, delay: str = "2 days") -> DataFrame:
    """Each key once; the state of keys older than the delay is dropped."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts(feed: DataFrame, time: str, group: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Rows by window and group; rows later than the delay are left out."""
    return feed.withWatermark(time, delay).groupBy(F.window(time, window), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")


def append_new(feed: DataFrame, table: str, key: str, seq: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Appends to a Parquet table, batch by batch, the rows whose key it doesn't hold yet; for keys without a time to expire them by (else see keyed.first_arrivals).

    The table lies in folders by batch and by key_bucket, the key's hash, so a batch reads the keys of its own buckets only. Each batch
    writes a folder of its own, and writes it anew if it is run again after a failure.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("key_bucket", bucket)
        stored = spark.createDataFrame([], batch.schema)
        if exists(spark, table):
            touched = [r["key_bucket"] for r in rows.select("key_bucket").distinct().collect()]
            layout = StructType([*batch.schema, StructField("batch", LongType()), StructField("key_bucket", IntegerType())])
            stored = spark.read.schema(layout).parquet(table).where(F.col("key_bucket").isin(touched) & (F.col("batch") != number))
        fresh = insert_ignore(stored, rows, [key], seq)
        fresh.repartition("key_bucket").write.mode("overwrite").partitionBy("key_bucket").parquet(f"{table}/batch={number}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
