"""Exact top-k inner products by norm buckets.

Candidates are put into norm buckets by their length's rank, large buckets into blocks. Every query first meets the blocks
of the longest bucket; its k-th best product there is its threshold. That over the query's length and a bucket's greatest
length is the bucket's local cosine threshold: above 1 nothing in the bucket can pass, and the query isn't sent there.
Queries that reach equally far share their blocks, so a bucket's vectors go only where some query needs them.

In a block the candidates are sorted by length into narrower buckets, with a threshold each. Above 1 the bucket and all
shorter ones are pruned. Near 1 (few candidates can pass) the query's largest coordinate bounds where a candidate's can
lie, and only those in that interval are multiplied; else only the candidates that are long enough. What is left is
verified with whole-number products. The blocks' best are then merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Local cosine threshold from which a coordinate prunes better than the length does.
BY_COORDINATE = 0.6
SLACK = 1e-9


def bucket_edges(lengths: np.ndarray, ratio: float = 0.9, least: int = 64) -> list[int]:
    """Starts of the buckets of lengths in falling order: none holds lengths under `ratio` of its first, unless it were small."""
    edges, i = [0], 0
    while i < len(lengths):
        j = int(np.searchsorted(-lengths, -lengths[i] * ratio, side="right"))
        i = max(j, i + least)
        if i < len(lengths):
            edges.append(i)
    return [*edges, len(lengths)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return scores[keep], ids[keep]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, at_least: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best candidates but its own rows, among whole-number vectors; ties to smaller ids. at_least: scores (nan: none) below which a query needs nothing."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((ids, -lengths))
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    unit = vectors.astype(np.float64) / np.maximum(lengths, 1e-300)[:, None]
    edges = bucket_edges(lengths)
    exact = vectors.astype(object) if _too_large(queries, vectors) else vectors.astype(np.float64)
    asked = queries.astype(exact.dtype)
    out = []
    by_coordinate: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for n, (own, q) in enumerate(zip(query_ids, queries, strict=True)):
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        top = int(np.argmax(np.abs(q))) if len(q) else 0
        head = float(q[top]) / length if length else 0.0
        scores, found = np.zeros(0, exact.dtype), np.zeros(0, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = np.arange(a, b)
            known = ([float(scores[-1])] if len(scores) == k else []) + ([] if at_least is None or np.isnan(at_least[n]) else [float(at_least[n])])
            if known and length:
                least = max(known) - SLACK * max(1.0, abs(max(known)))
                local = least / (length * lengths[a]) if lengths[a] else (np.inf if least > 0 else -np.inf)
                if local > 1 + SLACK:
                    break
                if local > BY_COORDINATE:
                    if (a, top) not in by_coordinate:
                        sort = np.argsort(unit[a:b, top], kind="stable")
                        by_coordinate[a, top] = sort + a, unit[a:b, top][sort]
                    rows, values = by_coordinate[a, top]
                    spread = float(np.sqrt(max(0.0, 1 - head**2) * max(0.0, 1 - local**2)))
                    # unit vectors within the angle of `local` of the query have this coordinate between these
                    low = -1.0 if head <= -local else head * local - spread
                    high = 1.0 if head >= local else head * local + spread
                    some = rows[np.searchsorted(values, low - 1e-7) : np.searchsorted(values, high + 1e-7, side="right")]
                elif local > 0:
                    some = some[lengths[a:b] * length >= least]
            some = some[ids[some] != own]
            if len(some):
                got = exact[some] @ asked[n]
                scores, found = _best(np.concatenate([scores, got]), np.concatenate([found, ids[some]]), k)
        out += [(int(own), int(i), int(s)) for s, i in zip(scores, found, strict=True)]
    return out


def _too_large(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether products might not be whole in doubles."""
    if not len(queries) or not len(vectors):
        return False
    return float(np.abs(queries).astype(np.float64).max()) * float(np.abs(vectors).astype(np.float64).max()) * queries.shape[1] >= 2.0**52


def _whole(rows: pd.Series) -> np.ndarray:
    """Vectors of whole numbers held as doubles, as integers: of Python where longs don't hold them."""
    values = np.array(rows.tolist(), dtype=np.float64)
    if np.abs(values).max(initial=0.0) < 2.0**53:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], dtype=object)


def _search(group: pd.DataFrame, k: int) -> pd.DataFrame:
    out: list = []
    for _, same in group.groupby(group["v"].map(len)):  # vectors of other sizes have no product
        asked, rest = same[same["query"]], same[~same["query"]]
        if len(asked) and len(rest):
            out += search_block(asked["vec_id"].to_numpy(), _whole(asked["v"]), rest["vec_id"].to_numpy(), _whole(rest["v"]), k, asked["at_least"].to_numpy(np.float64))
    if any(abs(score) >= 1 << 63 for _, _, score in out):
        raise OverflowError("a product is larger than a long")
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _blocks_of(asked: DataFrame, rest: DataFrame, k: int, subs: list[int], query_block: int) -> DataFrame:
    """The k best of asked (vec_id, v, at_least, low, high) among the blocks of `rest` (vec_id, v, bucket) in the buckets low to high - 1."""
    counts = {(r["low"], r["high"]): r["n"] for r in asked.groupBy("low", "high").agg(F.count("*").alias("n")).collect()}  # as many rows as there are buckets at most
    groups = [(f"{low}-{high}-{q}", low, high, q, -(-n // query_block)) for (low, high), n in sorted(counts.items()) if low < high for q in range(-(-n // query_block))]
    none = "query_id long, vec_id long, score long"
    if not groups:
        return asked.sparkSession.createDataFrame([], none)
    dealt = asked.where("low < high").withColumn("q", F.concat_ws("-", "low", "high", F.pmod(F.xxhash64("vec_id"), F.ceil(F.element_at(F.create_map(*(F.lit(x) for (low, high), n in counts.items() for x in (f"{low}-{high}", n))), F.concat_ws("-", "low", "high")) / F.lit(query_block)))))
    sub = F.element_at(F.array(*map(F.lit, subs)), F.col("bucket") + 1)
    all_of = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    mine = dealt.withColumn("bucket", F.explode(F.sequence(F.col("low"), F.col("high") - 1))).withColumn("b", all_of(sub))
    mine = mine.select("q", "bucket", "b", "vec_id", "v", "at_least", F.lit(True).alias("query"))
    wanted = F.array(*(F.array(*(F.lit(q) for q, low, high, *_ in groups if low <= b < high)).cast("array<string>") for b in range(len(subs))))
    theirs = rest.withColumn("q", F.explode(F.element_at(wanted, F.col("bucket") + 1))).withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), sub).cast("int"))
    theirs = theirs.select("q", "bucket", "b", "vec_id", "v", F.lit(None).cast("double").alias("at_least"), F.lit(False).alias("query"))
    return mine.unionByName(theirs).groupBy("q", "bucket", "b").applyInPandas(lambda group: _search(group, k), none)


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, query_block: int = 2048, block: int = 2048, most_buckets: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest products; fewer if there are fewer candidates. vectors: (vec_id, embedding).

    Components x become floor(scale * x). Queries: rows whose vec_id is divisible by `every`; candidates: all rows with
    another vec_id. Ties go to the smaller vec_id. Rows with a null vec_id, a null vector, or null or non-finite components
    take no part; all finite ones do, as whole numbers of any size, and a product that no long holds is an error. Of rows
    that repeat a query's id the smallest vector asks; as candidates repeated rows stand each. Only vectors of one size
    have a product. An empty table: no rows.
    """
    whole = lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)
    real = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).where("vec_id is not null and e is not null")
    real = real.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    real = real.select("vec_id", F.transform("e", lambda x: whole(x * scale)).alias("v"))
    real = real.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    real = staged(real)
    n = real.count()
    if not n:
        return real.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("vec_id").alias("score"))
    m = max(1, min(most_buckets, n // block))
    ranks = [k / m for k in range(m - 1, 0, -1)]
    edges = real.agg(F.percentile_approx("length", ranks, 10_000)).first()[0] if ranks else []
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda x: x > F.col("length")))
    rest = real.withColumn("bucket", bucket)
    sizes = {r["bucket"]: (r["n"], r["top"]) for r in rest.groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("top")).collect()}  # as many rows as there are buckets
    tops = [sizes.get(b, (0, 0.0))[1] for b in range(m)]
    subs = [max(1, -(-sizes.get(b, (0, 0.0))[0] // block)) for b in range(m)]
    first = next(b for b in range(m) if sum(sizes.get(x, (0, 0.0))[0] for x in range(b + 1)) > k or b == m - 1) + 1

    asking = real.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "length")).alias("x")).select("vec_id", "x.v", "x.length")
    asking = staged(asking)
    ahead = staged(_blocks_of(asking.select("vec_id", "v", F.lit(None).cast("double").alias("at_least"), F.lit(0).alias("low"), F.lit(first).alias("high")), rest, k, subs, query_block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = ahead.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("at_least"))
    further = asking.join(best, "vec_id", "left")
    passing = lambda b: F.col("at_least").isNull() | (F.col("length") * tops[b] * (1 + SLACK) + SLACK >= F.col("at_least") * F.when(F.col("at_least") > 0, 1 - SLACK).otherwise(1 + SLACK))
    reach = F.lit(first)
    for b in range(first, m):  # lengths fall, so what passes is a beginning
        reach = F.when(passing(b), F.lit(b + 1)).otherwise(reach)
    further = staged(further.select("vec_id", "v", "at_least", F.lit(first).alias("low"), reach.alias("high")))
    found = ahead.unionByName(_blocks_of(further, rest, k, subs, query_block))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
