"""Searches that give at most so many rows an answer: asked again in smaller slices until nothing is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: Fixed value: the most passes of a search.
PASSES = 14

Answer = Callable[[DataFrame], DataFrame]


def asked_until_complete(requests: DataFrame, answer: Answer, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(slices, rows). requests: (key, first_day, last_day). answer: of requests with slice_id gives rows with slice_id, and announced, the total that the search says of the slice.

    A pass asks all open slices at once. One whose rows are as many as announced is done; else it is split into two halves that are asked in the
    next pass, and its own rows don't count. What can't be split, or is still open after the last pass, stays as it is. slices: (key, first_day,
    last_day, pass, announced, stored, complete). rows: those of the final slices, with key and the columns of the answer.
    """
    open_ = requests.select("key", "first_day", "last_day")
    slices, rows = [], []
    for number in range(1, passes + 1):
        open_ = staged(open_.withColumn("slice_id", F.sha2(F.concat_ws("|", F.col("key").cast("string"), "first_day", "last_day"), 256)))
        got = staged(answer(open_))
        counts = got.groupBy("slice_id").agg(F.max("announced").alias("announced"), F.count("*").alias("stored"))
        now = open_.join(counts, "slice_id", "left").na.fill(0, ["announced", "stored"])
        now = staged(now.withColumns({"pass": F.lit(number), "complete": F.col("stored") >= F.col("announced")}))
        again = F.lit(number < passes) & ~F.col("complete") & (F.col("first_day") < F.col("last_day"))
        final = now.where(~again)
        slices.append(final.drop("slice_id"))
        rows.append(got.join(final.select("slice_id", "key"), "slice_id").drop("slice_id", "announced"))
        middle = F.date_add("first_day", F.floor(F.datediff("last_day", "first_day") / 2).cast("int"))
        halves = F.array(F.struct(F.col("first_day").alias("a"), middle.alias("b")), F.struct(F.date_add(middle, 1).alias("a"), F.col("last_day").alias("b")))
        open_ = now.where(again).select("key", F.explode(halves).alias("h")).select("key", F.col("h.a").alias("first_day"), F.col("h.b").alias("last_day"))
        if open_.isEmpty():
            break
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return union(slices), union(rows)
