"""What surrounds an extraction: identity from the registry, metadata and payloads as JSON, exports and tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas, vocab
from ..functions.numbers import parse_number
from ..functions.text import period_hint


def with_identity(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """documents (doc_id, file_hash, stock_code, stock_name, market, ...) with the registry's code always, its name and market where they are missing.

    registry: (file_hash, stock_code, stock_name, market); of several rows with a hash the smallest counts.
    """
    known = registry.where("file_hash is not null").groupBy("file_hash").agg(F.min(F.struct("stock_code", "stock_name", "market")).alias("r"))
    joined = documents.join(known, "file_hash", "left")
    return joined.withColumns({"stock_code": F.coalesce("r.stock_code", "stock_code"), "stock_name": F.coalesce("stock_name", "r.stock_name"), "market": F.coalesce("market", "r.market")}).select(*documents.columns)


def hk_metadata(reports: DataFrame) -> DataFrame:
    """reports (title, release_time, web_path, period_hint, report_type, year) with metadata_json; a missing hint is read from the title."""
    hint = F.coalesce("period_hint", period_hint(F.col("title"), F.col("report_type"), F.col("year")))
    return reports.withColumn("metadata_json", F.to_json(F.struct("title", "release_time", "web_path", hint.alias("period_hint"))))


def downloaded_with_metadata(files: DataFrame, reports: DataFrame) -> DataFrame:
    """files (url, path) with the report of the same url, the smallest of several: a failed download shifts nothing."""
    rest = [c for c in reports.columns if c != "url"]
    one = reports.groupBy("url").agg(F.min(F.struct(*rest)).alias("_r")).select("url", *(F.col("_r")[c].alias(c) for c in rest))
    return files.join(one, "url", "left")


def payloads(facts: DataFrame, evidence: DataFrame, periods: DataFrame, quality: DataFrame) -> DataFrame:
    """(doc_id, payload): one JSON text for each document, its parts in order."""
    part = lambda df, order, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in ("doc_id", order)]))).alias(name))
    out = quality.withColumn("quality", F.struct("status", "issues")).select("doc_id", "quality")
    for df, order, name in ((periods, "seq", "periods"), (facts, "fact_seq", "facts"), (evidence, "evidence_id", "evidence")):
        out = out.join(part(df, order, name), "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct("periods", "facts", "evidence", "quality")).alias("payload"))


def read_payloads(cache: DataFrame, ddl: str) -> DataFrame:
    """cache with `parsed`: the payload as a struct, empty where it is missing or broken."""
    return cache.withColumn("parsed", F.from_json(F.coalesce("payload", F.lit("{}")), ddl))


# What dealings with related parties are called, by total; parts may be joined by a slash instead.
RELATED = {
    "total_sales": ["向关联方销售", "向关联方提供劳务", "销售商品、提供劳务", "关联销售"],
    "total_purchases": ["向关联方采购", "向关联方接受劳务", "采购商品、接受劳务", "关联采购"],
    "total_receivables": ["应收关联方", "关联方应收款"],
    "total_payables": ["应付关联方", "关联方应付款"],
}
#: Characters between a name and its amount at most, none of them a digit, a line break or the end of a sentence.
RELATED_WITHIN = 16


def related_totals(documents: DataFrame) -> DataFrame:
    """documents (text) with the four totals: the first amount that stands within a short distance behind one of a total's names."""
    amount = r"([0-9][0-9,，]*(?:\.[0-9]+)?)"

    def total(names: list[str]) -> Column:
        behind = F.regexp_extract_all(F.translate("text", "/", "、"), F.lit(rf"(?:{'|'.join(names)})[^0-9\n。；]{{0,{RELATED_WITHIN}}}{amount}"), F.lit(1))
        return F.get(F.filter(F.transform(behind, parse_number), lambda v: v.isNotNull()), 0)

    return documents.withColumns({name: total(names) for name, names in RELATED.items()})


def control_sheet(log: DataFrame) -> DataFrame:
    """The eight columns of a download list, as text, ready for write.csv."""
    names = ["announcementId", "secCode", "secName", "announcementTitle", "announcementTime", "adjunctUrl", "downloaded", "file_stem"]
    return log.select(*(F.coalesce(F.col(n).cast("string") if n in log.columns else F.lit(None), F.lit("")).alias(n) for n in names))


def create_cache_table(spark: SparkSession, name: str) -> None:
    """The cache table, if it isn't there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schemas.CACHE}) USING parquet")


def confined(root: str, relative: str) -> str:
    """The path under root; an absolute one, or one that leads out, is an error."""
    if PurePosixPath(relative).is_absolute():
        raise ValueError(f"absolute path: {relative}")
    parts: list[str] = []
    for part in PurePosixPath(relative).parts:
        if part == ".." and not parts:
            raise ValueError(f"path leads out of the folder: {relative}")
        parts = parts[:-1] if part == ".." else [*parts, part]
    return str(PurePosixPath(root, *parts))


def unit_of(metric: Column, amount_unit: Column, currency: Column) -> Column:
    """struct<currency,unit> of a metric: percent, ratio and shares have no currency."""
    kind = F.coalesce(*(F.when(metric == m, u) for m, u in vocab.UNIT_OF.items()), F.lit("amount"))
    return F.struct(F.when(kind.isin("amount", "per_share"), currency).alias("currency"), F.when(kind == "amount", amount_unit).otherwise(kind).alias("unit"))
