"""Answers of a service over the ledger's tables, in the shapes of schemas: one row for each request or document.

A list in an answer is as long as its request's limit at most, so no answer grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.arrays import filled_fields
from .derivation import OWN
from .registry import as_text


def shaped(shape: str, columns: list[str]) -> Column:
    """A struct of the shape (DDL) from the columns of its names; null where a column isn't there."""
    return F.struct(*(_cast(x, columns) for x in T.StructType.fromDDL(shape)))


def _cast(field: T.StructField, columns: list[str]) -> Column:
    value = F.col(field.name) if field.name in columns else F.lit(None)
    return value.cast(field.dataType).alias(field.name)


def search_answers(requests: DataFrame, reports: DataFrame, most: int = 100) -> DataFrame:
    """(request_id, answer) of every request (request_id, stock_code, market, report_type, limit): schemas.SEARCH_ANSWER, the newest reports first.

    reports: stock_code, market, report_type, source, title, url, publish_date, file_size. A request without a type (null) takes all of them.
    A limit is at most `most`; null or less than one stands for it. Requests without reports get an empty list.
    """
    asked = requests.select("request_id", "stock_code", "market", "report_type", F.when(F.col("limit") >= 1, F.least("limit", F.lit(most))).otherwise(most).alias("limit"))
    r = reports.withColumnsRenamed({c: f"_{c}" for c in ("stock_code", "market", "report_type", "source")})
    found = asked.join(r, (F.col("stock_code") == F.col("_stock_code")) & (F.col("market") == F.col("_market")) & (F.col("report_type").isNull() | (F.col("report_type") == F.col("_report_type"))))
    newest = Window.partitionBy("request_id").orderBy(F.col("publish_date").desc_nulls_last(), "url")
    found = found.withColumn("place", F.row_number().over(newest)).where("place <= limit").drop("report_type").withColumnRenamed("_report_type", "report_type")
    one = F.struct("place", shaped(schemas.REPORT_INFO, found.columns).alias("r"), F.col("_source").alias("source"))
    listed = found.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("listed"))
    out = asked.join(listed, "request_id", "left").withColumn("listed", F.coalesce("listed", F.array().cast(listed.schema["listed"].dataType)))
    out = out.withColumns({"reports": F.transform("listed", lambda x: x["r"]), "count": F.size("listed"), "source": F.get("listed", F.lit(0))["source"]})
    return out.select("request_id", shaped(schemas.SEARCH_ANSWER, out.columns).alias("answer"))


def file_entries(registry: DataFrame) -> DataFrame:
    """(id, entry) of registered files: schemas.FILE_INFO, times as text."""
    r = as_text(registry, "download_time")
    return r.select("id", shaped(schemas.FILE_INFO, r.columns).alias("entry"))


def extraction_answers(records: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(doc_id, answer, n_fields): schemas.EXTRACTION of wide records; a statement without a figure is null. n_fields: figures that the answer holds.

    facts (from build_facts), if given, replace the records' figures: each metric's own fact, no comparison's nor single quarter's.
    """
    if facts is not None:
        shapes = T.StructType.fromDDL(schemas.EXTRACTION)
        names = [x.name for s in shapes for x in s.dataType]
        wide = facts.where(OWN).groupBy("doc_id").agg(*(F.min_by("value", F.when(F.col("metric") == m, F.col("fact_seq"))).alias(m) for m in names))
        records = records.select("doc_id").join(wide, "doc_id", "left")
    parts = []
    for field in T.StructType.fromDDL(schemas.EXTRACTION):
        shape = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in field.dataType)
        here = [F.col(x.name) for x in field.dataType if x.name in records.columns]
        some = F.coalesce(*here).isNotNull() if here else F.lit(False)
        parts.append(F.when(some, shaped(shape, records.columns)).alias(field.name))
    out = records.select("doc_id", F.struct(*parts).alias("answer"))
    figures = [F.col(f"answer.{field.name}.{x.name}") for field in T.StructType.fromDDL(schemas.EXTRACTION) for x in field.dataType]
    return out.withColumn("n_fields", filled_fields(figures))
