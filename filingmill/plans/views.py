"""The shared test tables seen as filings: each view is given twice, as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registered filings: status is the market, priority the type, price the size."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "annual").when(F.col("o_orderpriority").startswith("2"), "semi_annual").when(F.col("o_orderpriority").startswith("3"), "quarterly").otherwise("other")
    return o.select(
        F.col("o_orderkey").alias("id"), F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("stock_code"), F.when(F.col("o_orderstatus") == "O", "CN").when(F.col("o_orderstatus") == "F", "HK").otherwise("JP").alias("market"),
        kind.alias("report_type"), F.year("o_orderdate").alias("report_year"), F.col("o_orderdate").alias("download_time"), F.floor("o_totalprice").cast("bigint").alias("file_size"),
        F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.sha2((F.col("o_orderkey") % 5000).cast("string"), 256)).alias("file_hash"), F.concat(F.lit("f/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_path"),
        (F.col("o_orderkey") % 7 != 0).alias("is_available"),
    )


REGISTRY = """registry AS (SELECT o_orderkey AS id, lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS stock_code,
  CASE o_orderstatus WHEN 'O' THEN 'CN' WHEN 'F' THEN 'HK' ELSE 'JP' END AS market,
  CASE WHEN starts_with(o_orderpriority, '1') THEN 'annual' WHEN starts_with(o_orderpriority, '2') THEN 'semi_annual' WHEN starts_with(o_orderpriority, '3') THEN 'quarterly' ELSE 'other' END AS report_type,
  CAST(year(o_orderdate) AS INTEGER) AS report_year, o_orderdate AS download_time, CAST(floor(o_totalprice) AS BIGINT) AS file_size,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE sha256(CAST(o_orderkey % 5000 AS VARCHAR)) END AS file_hash, 'f/' || o_orderkey || '.pdf' AS file_path, o_orderkey % 7 <> 0 AS is_available FROM orders)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cached extractions by content hash: language is the version, the text the payload."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.sha2("text", 256).alias("file_hash"), F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v2").alias("schema_version"), F.when(F.col("lang") == "en", "1").otherwise("0").alias("extractor_version"),
        F.col("text").alias("payload"), (F.col("n_chars") % 50).alias("extraction_ms"), (F.col("doc_id") % 40).cast("int").alias("field_count"), F.col("doc_id").alias("seq"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 3600).cast("timestamp_ntz").alias("created_at"),
    )


CACHE = """cache AS (SELECT sha256(text) AS file_hash, CASE WHEN doc_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS schema_version, CASE WHEN lang = 'en' THEN '1' ELSE '0' END AS extractor_version,
  text AS payload, n_chars % 50 AS extraction_ms, CAST(doc_id % 40 AS INTEGER) AS field_count, doc_id AS seq, make_timestamp((1700000000 + doc_id * 3600) * 1000000) AS created_at FROM documents)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's year as a filing's record, in whole units: orders are revenue, line items give cost and cash."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.sum(F.floor("l_extendedprice").cast("bigint")).alias("price"), F.sum(F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("bigint")).alias("cut"), F.sum(F.floor("l_quantity").cast("bigint")).alias("quantity"))
    by = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fiscal_year"))
    return by.agg(F.sum("price").cast("double").alias("revenue"), F.sum(F.col("price") - F.col("cut") * 3).cast("double").alias("operating_cost"), F.sum("cut").cast("double").alias("net_profit"), F.sum("quantity").cast("double").alias("operating_cash_flow"), F.count("*").cast("double").alias("capital_expenditure"))


STATEMENTS = """lines AS (SELECT l_orderkey, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS price, sum(CAST(floor(l_extendedprice * l_discount) AS BIGINT)) AS cut, sum(CAST(floor(l_quantity) AS BIGINT)) AS quantity FROM lineitem GROUP BY 1),
statements AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(sum(price) AS DOUBLE) AS revenue, CAST(sum(price - cut * 3) AS DOUBLE) AS operating_cost, CAST(sum(cut) AS DOUBLE) AS net_profit,
  CAST(sum(quantity) AS DOUBLE) AS operating_cash_flow, CAST(count(*) AS DOUBLE) AS capital_expenditure FROM orders JOIN lines ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's quarters: (company, fiscal_year, quarter, q_no, amount), q_no counting on."""
    o = table(spark, sf_dir, "orders")
    by = o.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("quarter"))
    return by.agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("amount")).withColumn("q_no", F.col("fiscal_year") * 4 + F.col("quarter") - 1)


QUARTERS = """quarters AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS amount,
  CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS q_no FROM orders GROUP BY 1, 2, 3, 5)"""

#: Titles that filings have, dealt over orders.
TITLES = [
    "2024 Annual Report",
    "2024 Interim Report - six months ended June 30",
    "Q3 2024 Quarterly Results, nine months, unaudited",
    "Q4 and Full Year 2023 Results Announcement, year ended December 31, 2023",
    "2023年年度报告摘要",
    "2023年半年度报告",
    "2022年第一季度报告",
    "Notice of board meeting",
    "2022年第三季度报告",
    "Unaudited annual results for the year ended March 2021 (HK$'000)",
    "Quarterly update, audited, USD million",
]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, code, path, release, millis) of orders as announcements."""
    o = table(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, TITLES))
    when = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")
    return o.select(
        F.col("o_orderkey").alias("id"), F.element_at(names, (F.col("o_orderkey") % len(TITLES) + 1).cast("int")).alias("title"), F.lpad((F.col("o_custkey") * 613 % 900000).cast("string"), 6, "0").alias("code"),
        F.concat(F.lit("/sehk/"), F.year("o_orderdate").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_c.pdf").otherwise(".pdf")).alias("path"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Release Time:"), when)).when(F.col("o_orderkey") % 3 == 1, F.substring(when, 1, 10)).otherwise("unknown").alias("release"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("millis"),
    )


_TITLE_LIST = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TITLES) + "]"
TITLES_SQL = f"""titles AS (SELECT o_orderkey AS id, ({_TITLE_LIST})[CAST(o_orderkey % {len(TITLES)} AS INTEGER) + 1] AS title, lpad(CAST(o_custkey * 613 % 900000 AS VARCHAR), 6, '0') AS code,
  '/sehk/' || year(o_orderdate) || '/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_c.pdf' ELSE '.pdf' END AS path,
  CASE o_orderkey % 3 WHEN 0 THEN 'Release Time:' || strftime(o_orderdate, '%d/%m/%Y %H:%M') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'unknown' END AS release, epoch_ms(o_orderdate) AS millis FROM orders)"""
