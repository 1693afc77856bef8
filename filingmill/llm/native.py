"""Column expressions for the operators that use built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def running_totals(lengths: Column, block: int = 256) -> Column:
    """The inclusive running totals of an array of longs, in blocks, so the work stays near-linear in its size."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    before = lambda done: F.when(F.size(done) == 0, F.lit(0).cast("long")).otherwise(F.element_at(F.element_at(done, -1), -1))
    inside = lambda start, b: F.aggregate(b, F.array(start), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x)), lambda out: F.slice(out, F.lit(2), F.size(out) - 1))
    summed = F.flatten(F.aggregate(blocks, F.array().cast("array<array<bigint>>"), lambda done, b: F.concat(done, F.array(inside(before(done), b)))))
    return F.when(n > 0, summed).otherwise(F.array().cast("array<bigint>"))


def with_spans(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with one column `name` for each pattern: array<struct<start,end,value>> of its leftmost non-overlapping matches, in code points.

    Built-in functions give no match positions; the text between matches does: a match starts where the texts before it,
    and the earlier matches, end.
    """
    for name, pattern in patterns.items():
        df = df.withColumn(f"_m_{name}", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        some = F.size(f"_m_{name}") > 0
        gaps = F.when(some, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(f"_m_{name}"))).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"_g_{name}", gaps)
        df = df.withColumn(f"_t_{name}", running_totals(F.zip_with(f"_g_{name}", f"_m_{name}", lambda g, m: (F.length(g) + F.length(m)).cast("long"))))
        spans = F.zip_with(f"_t_{name}", f"_m_{name}", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
        df = df.withColumn(name, spans).drop(f"_m_{name}", f"_g_{name}", f"_t_{name}")
    return df


def literal_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A few constant rows as literals of the plan."""
    return spark.range(1).select(F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in row.items())) for row in rows))).alias("r")).select("r.*")
