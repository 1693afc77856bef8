"""The extraction cache: results by content hash, schema and extractor version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["file_hash", "schema_version"]


def save(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """The cache after new results; of several for a key the last by seq counts."""
    last = incoming.groupBy(*KEY).agg(F.max_by(F.struct(*incoming.columns), "seq").alias("x")).select("x.*")
    return cache.join(last.select(*KEY), KEY, "left_anti").unionByName(last.select(*cache.columns))


def lookup(wanted: DataFrame, cache: DataFrame, extractor_version: str) -> DataFrame:
    """wanted (file_hash, schema_version) with its cached payload; other extractor versions are misses."""
    valid = cache.where(F.col("extractor_version") == extractor_version).select(*KEY, "payload", "field_count")
    return wanted.join(valid, KEY, "left").withColumn("hit", F.col("payload").isNotNull())


def invalidate(cache: DataFrame, hashes: DataFrame, schema: str | None = None) -> DataFrame:
    """The cache less the entries of these hashes, of one schema if asked."""
    gone = hashes.select("file_hash").distinct()
    if schema:
        gone = gone.withColumn("schema_version", F.lit(schema))
    return cache.join(gone, gone.columns, "left_anti")


def collect_garbage(cache: DataFrame, registry: DataFrame, extractor_version: str, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """What stays of the cache, and one row (stale, orphans): first old versions and old entries go, then those whose hash no available filing has."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} day")
    stale = (F.col("extractor_version") != extractor_version) | (F.col("created_at") < cutoff)
    marked = cache.withColumn("_stale", F.coalesce(stale, F.lit(True)))
    live = registry.where("is_available and file_hash is not null").select(F.col("file_hash").alias("_live")).distinct()
    marked = marked.join(live, marked["file_hash"] == F.col("_live"), "left").withColumn("_orphan", ~F.col("_stale") & F.col("_live").isNull())
    counts = marked.agg(F.count_if("_stale").alias("stale"), F.count_if("_orphan").alias("orphans"))
    return marked.where("not _stale and not _orphan").select(*cache.columns), counts


def stats(*caches: DataFrame) -> DataFrame:
    """One row over the union of caches: entries, kilobytes of payload in hundredths, mean milliseconds of those that took any, tenths of mean fields, first and last time."""
    every = caches[0]
    for c in caches[1:]:
        every = every.unionByName(c, allowMissingColumns=True)
    took = F.when(F.col("extraction_ms") != 0, F.col("extraction_ms"))
    mean = lambda c, scale: F.coalesce(F.floor(F.sum(c) * scale * 1.0 / F.count(c) + 0.5), F.lit(0)).cast("long")
    size = F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))
    return every.agg(
        F.count("*").alias("entries"), F.floor(size * 100.0 / 1024 + 0.5).cast("long").alias("kilobytes_x100"), mean(took, 1).alias("mean_ms"),
        mean(F.col("field_count"), 10).alias("mean_fields_x10"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
    )


def by_version(*caches: DataFrame) -> DataFrame:
    every = caches[0]
    for c in caches[1:]:
        every = every.unionByName(c, allowMissingColumns=True)
    return every.groupBy("schema_version", "extractor_version").agg(F.count("*").alias("entries"))


def warm_up_totals(results: DataFrame) -> DataFrame:
    """One row over (success, fields): processed, ok, failed, fields and whole mean fields of the good ones."""
    ok = F.count_if("success")
    total = F.coalesce(F.sum(F.when(F.col("success"), F.col("fields"))), F.lit(0))
    return results.agg(F.count("*").alias("processed"), ok.alias("ok"), (F.count("*") - ok).alias("failed"), total.cast("long").alias("fields"), F.coalesce(F.floor(F.try_divide(total, ok)), F.lit(0)).cast("long").alias("mean_fields"))
