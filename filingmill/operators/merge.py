"""Merging and deduplicating rows whose order matters; every order is an explicit sequence column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_wins(rows: DataFrame, identity: Column, seq: str) -> DataFrame:
    """One row for each identity: where it was first seen (first_seen), as it was last seen."""
    keyed = rows.withColumn("_id", identity)
    return keyed.groupBy("_id").agg(F.max_by(F.struct(*rows.columns), seq).alias("x"), F.min(seq).alias("first_seen")).select("x.*", "first_seen")


def newest(rows: DataFrame, time: str, seq: str, n: int) -> DataFrame:
    """The n newest; among equals the first seen."""
    return rows.orderBy(F.col(time).desc_nulls_last(), seq).limit(n)


def keep_latest(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Insert or replace: the last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), seq).alias("x")).select("x.*")


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The rows that an insert adds: the first of each key that isn't stored."""
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*incoming.columns), seq).alias("x")).select("x.*")
    return first.join(stored.select(*key), key, "left_anti")


def collision_suffix(rows: DataFrame, stem: str, seq: str, out: str = "name") -> DataFrame:
    """rows with `out`: the stem, and `_[n]` from its second arrival on."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(seq)) - 1
    return rows.withColumn("_n", n).withColumn(out, F.when(F.col("_n") > 0, F.concat(stem, F.lit("_["), F.col("_n").cast("string"), F.lit("]"))).otherwise(F.col(stem))).drop("_n")


def top_per_group(rows: DataFrame, group: str, seq: str, n: int, success: Column | None = None) -> DataFrame:
    """The first n of each group in order, of the successful ones."""
    rows = rows if success is None else rows.where(success)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(seq))).where(F.col("_r") <= n).drop("_r")


def buckets_of(rows: DataFrame, group: str, seq: str, size: int = 1000) -> DataFrame:
    """rows with `bucket`: folders of at most `size` rows of a group, in order."""
    return rows.withColumn("bucket", (F.floor((F.row_number().over(Window.partitionBy(group).orderBy(seq)) - 1) / size) + 1).cast("int"))


def first_source(statements: DataFrame) -> DataFrame:
    """(symbol, statement_type, source_seq, source, ...) -> the first source's row of each statement, with `sources`: all of the symbol's, in order."""
    first = statements.groupBy("symbol", "statement_type").agg(F.min_by(F.struct(*[c for c in statements.columns if c not in ("symbol", "statement_type")]), "source_seq").alias("x"))
    names = statements.select("symbol", "source_seq", "source").distinct().groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_seq", "source"))), lambda s: s["source"]).alias("sources"))
    return first.select("symbol", "statement_type", "x.*").join(names, "symbol")


def run_counters(rows: DataFrame, status: str, names: list[str]) -> DataFrame:
    """One row: total, and the count of each status."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == n).alias(n) for n in names))


def latest_reports(parts: list[DataFrame], identity: Column, n: int) -> DataFrame:
    """The newest of several searches: united, deduplicated with the last seen values, sorted by publish_timestamp, cut."""
    tagged = [p.withColumn("seq", F.col("seq") + F.lit(k << 40)) for k, p in enumerate(parts)]
    return newest(last_wins(union_all(*tagged), identity, "seq"), "publish_timestamp", "first_seen", n)
