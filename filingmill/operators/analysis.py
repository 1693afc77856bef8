"""Extensions beyond the extraction: canonical facts, single quarters, trailing sums, growth and reports on validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUSINESS_KEY = ["metric", "period_id", "entity_scope", "comparison_axis", "adjustment_basis", "currency"]


def canonical(candidates: DataFrame, key: list[str], rank: str, seq: str) -> DataFrame:
    """One row for each business key: the source of the lowest rank (none: 999), then the first."""
    w = Window.partitionBy(*key).orderBy(F.coalesce(rank, F.lit(999)), seq)
    return candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def single_quarters(values: DataFrame, entity: list[str], year: str, quarter: str, value: str) -> DataFrame:
    """Year-to-date values with `single`: less the quarter before of the same year; the first as it is; null where the one before is missing."""
    w = Window.partitionBy(*entity, year).orderBy(quarter)
    follows = F.lag(quarter).over(w) == F.col(quarter) - 1
    return values.withColumn("single", F.when(F.col(quarter) == 1, F.col(value)).when(follows, F.col(value) - F.lag(value).over(w)))


def trailing(values: DataFrame, entity: list[str], order: str, value: str, n: int = 4) -> DataFrame:
    """values with `ttm`: the sum of the last n quarters, null unless all n are there one after the other (`order` counts quarters)."""
    w = Window.partitionBy(*entity).orderBy(order).rangeBetween(-(n - 1), 0)
    return values.withColumn("ttm", F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def growth(values: DataFrame, entity: list[str], order: str, value: str) -> DataFrame:
    """values with qoq and yoy: the change against one and four quarters before, which must be those quarters."""
    w = Window.partitionBy(*entity).orderBy(order)
    before = lambda n: F.max(value).over(w.rangeBetween(-n, -n))
    change = lambda n: F.try_divide(F.col(value) - before(n), F.abs(before(n)))
    return values.withColumns({"qoq": change(1), "yoy": change(4)})


def validation_report(issues: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, gate): fail with an error, review with a warning, else pass."""
    r = issues.groupBy("doc_id").agg(F.count_if(F.col("issue.severity") == "error").alias("errors"), F.count_if(F.col("issue.severity") == "warning").alias("warnings"))
    return r.withColumn("gate", gate(F.col("errors"), F.col("warnings")))


def gate(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "fail").when(warnings > 0, "review").otherwise("pass")


def evidence_bundle(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, statement, metric, period_id, evidence): each fact with the rows that back it."""
    links = facts.select("doc_id", "statement", "metric", "period_id", F.posexplode("evidence_ids").alias("k", "evidence_id"))
    return links.join(evidence, ["doc_id", "evidence_id"]).groupBy("doc_id", "statement", "metric", "period_id").agg(F.array_sort(F.collect_list(F.struct("k", "evidence_id", "page", "table_index", "row_label", "raw_value"))).alias("evidence"))
