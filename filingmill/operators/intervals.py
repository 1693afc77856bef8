"""Joins of points with intervals of whole numbers, such as days, however long the intervals are and however they overlap.

An interval is cut into dyadic ranges, blocks of 2**level that begin at a multiple of 2**level: at most two for each level, and they
don't overlap. A point lies in one block of each level. So points and intervals meet in a plain equi-join on key,
level and block, each pair once, with no condition on a range left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of blocks; an interval longer than 2**LEVELS takes several of the largest.
LEVELS = 16
#: Blocks of intervals that are broadcast at most; more are shuffled together with the points.
BROADCAST_ROWS = 100_000
_BLOCKS = "array<struct<level:int,block:bigint>>"


def dyadic(first: Column, last: Column, levels: int = LEVELS) -> Column:
    """array<struct<level,block>> of the ranges that make up first..last, both included; none if last is smaller."""
    # From the finest level on: a block is taken at either end where the coarser block there would reach beyond.
    start = F.struct(first.cast("long").alias("lo"), (last.cast("long") + 1).alias("hi"), F.array().cast(_BLOCKS).alias("out"))

    def step(s: Column, k: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        odd_lo, odd_hi = (lo < hi) & (F.pmod(lo, F.lit(2)) == 1), (lo < hi) & (F.pmod(hi, F.lit(2)) == 1)
        at = lambda block: F.array(F.struct(k.cast("int").alias("level"), block.alias("block")))
        none = F.array().cast(_BLOCKS)
        one = odd_lo & odd_hi & (lo + 1 == hi)  # the same block from both ends
        out = F.concat(s["out"], F.when(odd_lo, at(lo)).otherwise(none), F.when(odd_hi & ~one, at(hi - 1)).otherwise(none))
        return F.struct(F.floor((lo + F.when(odd_lo, 1).otherwise(0)) / 2).cast("long").alias("lo"), F.floor((hi - F.when(odd_hi, 1).otherwise(0)) / 2).cast("long").alias("hi"), out.alias("out"))

    ended = F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step)
    blocks = F.sequence(ended["lo"], ended["hi"] - 1)
    coarsest = F.transform(blocks, lambda b: F.struct(F.lit(levels).alias("level"), b.alias("block")))
    rest = F.when(ended["lo"] < ended["hi"], coarsest).otherwise(F.array().cast(_BLOCKS))
    return F.concat(ended["out"], rest)


def interval_join(intervals: DataFrame, points: DataFrame, key: list[str], first: str, last: str, at: str, levels: int = LEVELS, how: str = "inner") -> DataFrame:
    """intervals with the points of the same key that lie in first..last. how: inner or left (intervals without points too). Column names but the keys must differ. Nulls match nothing.

    A point has a row for each level that intervals have blocks of. The points are never broadcast, however small Spark takes them to be.
    """
    cut = intervals.withColumn("_cut", F.explode(dyadic(F.col(first), F.col(last), levels))).withColumns({"_level": F.col("_cut.level"), "_block": F.col("_cut.block")}).drop("_cut")
    used = sorted(r["_level"] for r in cut.select("_level").distinct().collect())  # at most levels + 1 rows
    in_level = F.explode(F.array(*map(F.lit, used)).cast("array<int>"))
    placed = points.where(F.col(at).isNotNull()).withColumn("_level", in_level)
    placed = placed.withColumn("_block", F.floor(F.col(at).cast("long") / F.pow(F.lit(2), F.col("_level"))).cast("long"))
    few = cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(cut) if few else cut.hint("shuffle_merge"), [*key, "_level", "_block"]).drop("_level", "_block")
    joined = joined.select(*intervals.columns, *(c for c in points.columns if c not in key))
    if how == "inner":
        return joined
    met = joined.select(*intervals.columns).distinct()
    bare = intervals.join(met, [intervals[c].eqNullSafe(met[c]) for c in intervals.columns], "left_anti")
    return joined.unionByName(bare, allowMissingColumns=True)
