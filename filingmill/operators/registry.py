"""The filing registry: search, upsert by content, soft deletes, age-outs and statistics.

Tables are immutable: each mutation returns the next state of the table as a DataFrame, to be written over the last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged

SORTS = ["download_time", "announcement_date", "report_year"]
#: Fields that a new copy of a known file overwrites where it has a value.
REFRESHED = ["stock_code", "stock_name", "market", "report_type", "report_year", "report_quarter", "announcement_date", "original_title", "source_url", "source_name", "metadata_json"]


def search(registry: DataFrame, stock_code: str | None = None, market: str | None = None, report_type: str | None = None, year: int | None = None, limit: int = 20, sort_by: str = "download_time", descending: bool = True) -> DataFrame:
    """Available filings that meet every condition given, sorted and cut. `all` is no condition; unknown sort columns mean download_time; nulls count as smallest; ties by id."""
    wanted = [F.col(c) == v for c, v in (("stock_code", stock_code), ("market", market), ("report_type", None if report_type == "all" else report_type), ("report_year", year)) if v]
    found = registry.where(reduce(lambda a, b: a & b, wanted, F.col("is_available")))
    key = sort_by if sort_by in SORTS else "download_time"
    return found.orderBy(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first(), "id").limit(limit)


def of_stock(registry: DataFrame, stock_code: str) -> DataFrame:
    return search(registry, stock_code, limit=100)


def as_text(registry: DataFrame, *times: str) -> DataFrame:
    """Times as ISO text."""
    return registry.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in times})


def add(registry: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """The registry after new files. A known hash is made available again, with path, name, size and time of the new copy, and its other fields where the new copy has them; others are new rows.

    incoming: as the registry, less id, is_available, download_time and last_accessed, with seq: of several rows with a
    hash the last counts. Rows without a hash are always new. New ids follow the largest one, by seq.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    refreshed = [c for c in REFRESHED if c in registry.columns]
    copied = [c for c in ("file_path", "file_name", "file_size") if c in registry.columns]
    last = incoming.where("file_hash is not null").groupBy("file_hash").agg(F.max_by(F.struct(*incoming.columns), "seq").alias("x")).select("x.*")
    known = registry.where("file_hash is not null").select("file_hash")
    fresh = last.join(known, "file_hash", "left_anti").unionByName(incoming.where("file_hash is null"))
    renamed = last.select(F.col("file_hash").alias("_hash"), *(F.col(c).alias(f"_{c}") for c in (*refreshed, *copied)))
    joined = registry.join(renamed, registry["file_hash"] == F.col("_hash"), "left")
    hit = F.col("_hash").isNotNull()
    changed = {c: F.coalesce(f"_{c}", c) for c in refreshed} | {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in copied}
    changed |= {"is_available": hit | F.col("is_available"), "download_time": F.when(hit, now).otherwise(F.col("download_time"))}
    kept = joined.withColumns(changed).select(*registry.columns)
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    # ids by the rank of seq: ranks within ranges of seq, and the ranges' counts before
    added = with_ranks(fresh, "seq").crossJoin(F.broadcast(top))  # one row
    added = added.withColumns({"id": F.col("_top") + F.col("rank"), "is_available": F.lit(True), "download_time": now, "last_accessed": F.lit(None).cast("timestamp_ntz")})
    return kept.unionByName(added.select(*(F.col(c).cast(registry.schema[c].dataType).alias(c) for c in registry.columns)))


def with_ranks(df: DataFrame, *order: str, width: int | None = None) -> DataFrame:
    """df with rank: 1, 2, ... in the order of columns that together don't repeat. width: rows of a range, if not as many ranges as shuffles have partitions.

    Rows are dealt to ranges by sampled quantiles and sorted within them; a row's place in its range and the counts of the
    ranges before, one number for each partition, make its rank.
    """
    at = F.monotonically_increasing_id()  # the partition's number above its rows' places
    ranges = [max(1, -(-df.count() // width))] if width else []
    ranged = staged(df.repartitionByRange(*ranges, *order).sortWithinPartitions(*order).withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, done = [], 0
    for row in sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before.append((row["part"], done))
        done += row["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_part long, _before long"))
    return ranged.withColumn("_part", part).join(starts, "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def mark_unavailable(registry: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with these ids (id) made unavailable, and one row `changed`: how many were available before."""
    gone = ids.select(F.col("id").alias("_id")).distinct()
    hit = registry.join(gone, registry["id"] == F.col("_id"), "left").withColumn("_hit", F.col("_id").isNotNull())
    after = hit.withColumn("is_available", F.col("is_available") & ~F.col("_hit")).select(*registry.columns)
    return after, hit.where("_hit").agg(F.count_if("is_available").alias("changed"))


def age_out(registry: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Rows downloaded before the cutoff are made unavailable."""
    old = F.col("download_time") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} day")
    return registry.withColumn("is_available", F.col("is_available") & ~F.coalesce(old, F.lit(False)))


def purge(log: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows older than the cutoff are dropped."""
    return log.where(~F.coalesce(F.col(time) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} day"), F.lit(False)))


def set_status(log: DataFrame, keys: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """log with `column` set to value on the rows whose key is in keys."""
    hit = keys.select(F.col(key).alias("_key")).distinct()
    return log.join(hit, log[key] == F.col("_key"), "left").withColumn(column, F.when(F.col("_key").isNotNull(), value).otherwise(F.col(column))).drop("_key")


def existing(log: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """probes with `found`: 1 if the log has the key, else 0."""
    keys = log.select(F.col(key).alias("_key")).distinct()
    return probes.join(keys, probes[key] == F.col("_key"), "left").withColumn("found", F.col("_key").isNotNull().cast("int")).drop("_key")


def stats(registry: DataFrame) -> DataFrame:
    """One row: available filings in all, and by each supported market and type, noughts included."""
    by = lambda column, names: [F.count_if(F.col(column) == n).alias(f"{column}_{n}") for n in names]
    return registry.where("is_available").agg(F.count("*").alias("total"), *by("market", ["CN", "HK", "US"]), *by("report_type", ["annual", "semi_annual", "quarterly"]))


def collection_stats(log: DataFrame, downloaded: Column, group_columns: list[str], size: str, domains: dict[str, list[str]] | None = None) -> DataFrame:
    """(dimension, key, n): totals, downloads, bytes and megabytes in hundredths, and the counts of each group column; one scan, by grouping sets.

    domains: keys by group column that are listed whether they occur or not.
    """
    named = log.select(*(F.col(c).cast("string").alias(c) for c in group_columns), F.coalesce(downloaded, F.lit(False)).alias("_downloaded"), F.col(size).alias("_size"))
    level = F.grouping_id(*group_columns) if group_columns else F.lit(0)
    sums = [level.alias("_level"), F.count("*").alias("all"), F.count_if("_downloaded").alias("downloaded"), F.coalesce(F.sum("_size"), F.lit(0)).cast("long").alias("bytes")]
    sets = named.groupingSets([[], *([c] for c in group_columns)], *group_columns).agg(*sums) if group_columns else named.agg(*sums)
    everything = (1 << len(group_columns)) - 1
    of = {everything ^ (1 << len(group_columns) - 1 - k): c for k, c in enumerate(group_columns)}
    pair = lambda dimension, key, n: F.struct(F.lit(dimension).alias("dimension"), key.alias("key"), n.alias("n"))
    total = {"all": F.col("all"), "downloaded": F.col("downloaded"), "bytes": F.col("bytes"), "megabytes_x100": F.floor(F.col("bytes") * 100.0 / 1048576 + 0.5).cast("long")}
    lines = F.array(*(pair("total", F.lit(k), n) for k, n in total.items()))
    for number, c in of.items():
        lines = F.when(F.col("_level") == number, F.array(pair(c, F.col(c), F.col("all")))).otherwise(lines)
    out = sets.select(F.explode(lines).alias("x")).select("x.*")
    listed = [(c, k) for c, ks in (domains or {}).items() for k in ks]
    if not listed:
        return out
    zeros = log.sparkSession.createDataFrame(listed, "dimension string, key string").withColumn("n", F.lit(0).cast("long"))
    return out.unionByName(zeros).groupBy("dimension", "key").agg(F.sum("n").alias("n"))


def most_recent(log: DataFrame, time: str, key: str, n: int = 5) -> DataFrame:
    return log.orderBy(F.col(time).desc_nulls_last(), key).limit(n)


def uncached(registry: DataFrame, cache: DataFrame, limit: int, schema: str = "v2", parity: bool = False) -> DataFrame:
    """Available filings with a hash that the cache lacks, newest first. parity: only the newest 2 * limit are looked at, so rows can be missed."""
    some = registry.where("is_available and file_hash is not null")
    newest = [F.col("download_time").desc_nulls_last(), F.col("id")]
    if parity:
        some = some.orderBy(*newest).limit(2 * limit)
    done = cache.where(F.col("schema_version") == schema).select("file_hash")
    return some.join(done, "file_hash", "left_anti").orderBy(*newest).limit(limit)


def missing_files(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Available rows whose file_path isn't among files (path)."""
    return registry.where("is_available").join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti")
