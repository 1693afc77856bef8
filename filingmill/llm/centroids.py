"""Exact k-means on whole-number vectors with Hamerly's bounds.

Each vector keeps its centroid, one upper bound of the distance to it and one lower bound of the distance to any other. When
centroids move, bounds are loosened by how far; a vector whose upper bound stays under the lower one, or under half the way
from its centroid to the next, keeps its centroid unseen. One that doesn't gets its upper bound tightened, and if that isn't
enough, a scan of all centroids in whole numbers, where ties go to the smaller number. Bounds are doubles that are rounded
outwards, and only strict inequality spares a scan, so the result is that of plain rounds.

A round is one pass: it writes the vectors with their bounds, and beside them what each batch adds to the sums of the
centroids that vectors came to or left. Those sums, a row for each centroid and component, are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, released, written

#: Components up to this are multiplied as doubles, exactly; vectors with larger ones as whole numbers of any size.
EXACT = 1 << 22
#: Bits of a component in one number of a sum; larger components take several.
LIMB = 40
#: Rows that are worked on at once.
ROWS = 4096
#: Rounding of bounds, far above what doubles lose.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


def _numbers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as whole numbers of any size."""
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def _root(squared: int) -> float:
    """The square root, for numbers of any size."""
    return math.sqrt(squared) if squared < 1 << 1000 else float("inf")


class Centroids:
    """Centroids as whole numbers, with distances to vectors."""

    def __init__(self, rows: list[list[int]]):
        self.rows = rows
        self.small = all(abs(x) <= EXACT for row in rows for x in row)
        self.exact = np.array(rows, object).reshape(len(rows), -1)
        self.plain = np.array(rows, np.float64).reshape(len(rows), -1) if self.small else None
        gaps = [[_root(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) for j, b in enumerate(rows) if j != i] for i, a in enumerate(rows)]
        self.half = np.array([min(g, default=math.inf) * _DOWN / 2 for g in gaps])

    def drifts(self, after: Centroids) -> np.ndarray:
        return np.array([_root(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) * _UP for a, b in zip(self.rows, after.rows, strict=True)])

    def _by_size(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        small = (np.abs(values).max(axis=1) <= EXACT) & self.small
        for which, plain in ((small, True), (~small, False)):
            if which.any():
                yield np.flatnonzero(which), plain

    def squared(self, values: np.ndarray, cluster: np.ndarray | None = None) -> np.ndarray:
        """Exact squared distances, as Python's numbers where any is large: to each row's own centroid, or to all of them."""
        shape = (len(values), len(self.rows)) if cluster is None else (len(values),)
        out, large = np.zeros(shape, np.int64), None
        for at, plain in self._by_size(values):
            if plain and cluster is None:
                v = values[at]
                out[at] = ((v * v).sum(axis=1)[:, None] - 2 * (v @ self.plain.T) + (self.plain * self.plain).sum(axis=1)).astype(np.int64)
            elif plain:
                gap = values[at] - self.plain[cluster[at]]
                out[at] = (gap * gap).sum(axis=1).astype(np.int64)
            else:
                large = out.astype(object) if large is None else large
                v = _numbers(values[at])
                gap = v[:, None, :] - self.exact if cluster is None else v - self.exact[cluster[at]]
                large[at] = (gap * gap).sum(axis=-1)
                small = np.setdiff1d(np.arange(len(values)), at)
                large[small] = out[small].astype(object)
        return out if large is None else large


def _roots(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) if squared.dtype != object else np.array([_root(int(x)) for x in squared.ravel()]).reshape(squared.shape)


def assign(values: np.ndarray, centroids: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves cluster, upper and lower, in place, to where the vectors belong; returns how many were scanned. Cluster -1: none yet."""
    bound = lambda at: np.maximum(lower[at], centroids.half[cluster[at]])
    open_ = np.flatnonzero(cluster < 0)
    known = np.flatnonzero(cluster >= 0)
    if len(known):
        doubt = known[~(upper[known] < bound(known))]
        upper[doubt] = _roots(centroids.squared(values[doubt], cluster[doubt])) * _UP if len(doubt) else 0
        open_ = np.concatenate([open_, doubt[~(upper[doubt] < bound(doubt))]])
    if len(open_):
        squared = centroids.squared(values[open_])
        best = np.argmin(squared, axis=1)
        rows = np.arange(len(open_))
        cluster[open_] = best
        upper[open_] = _roots(squared[rows, best]) * _UP
        far = _roots(squared) * _DOWN
        far[rows, best] = np.inf
        lower[open_] = far.min(axis=1)
    return len(open_)


def _limbs(total: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Whole numbers of any size as (limb, numbers of at most LIMB bits)."""
    limb = 0
    while any(total):
        sign = [-1 if x < 0 else 1 for x in total]
        yield limb, [s * (abs(x) & ((1 << LIMB) - 1)) for s, x in zip(sign, total, strict=True)]
        total, limb = [s * (abs(x) >> LIMB) for s, x in zip(sign, total, strict=True)], limb + 1


def _sums(values: np.ndarray, cluster: np.ndarray, sign: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(cluster, limb, vectors, components) to add for the vectors that came (sign 1) or left (-1)."""
    for c in np.unique(cluster[cluster >= 0]).tolist():
        own = values[cluster == c]
        small = np.abs(own).max(axis=1) <= EXACT
        total = [int(x) for x in own[small].sum(axis=0)]
        if not small.all():
            total = [a + b for a, b in zip(total, _numbers(own[~small]).sum(axis=0).tolist(), strict=True)]
        for limb, part in list(_limbs(total)) or [(0, [0] * len(total))]:
            yield c, limb, sign * len(own) if limb == 0 else 0, [sign * x for x in part]


#: Rows of both parts: of "vector" the first six columns, of "sum" the cluster and the last three.
_STATE = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("cluster", T.IntegerType()),
        T.StructField("upper", T.DoubleType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("limb", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType())),
    ]
)


def _values(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)


def _round(batches: Iterator[pa.RecordBatch], centroids: Centroids, drifts: np.ndarray | None, dims: int) -> Iterator[pa.RecordBatch]:
    """One round over vectors: loosened bounds, new centroids, and what moves between sums."""
    names = _STATE.fieldNames()
    null = pa.nulls
    for whole in batches:
        for lo in range(0, len(whole), ROWS):
            batch = whole.slice(lo, ROWS)
            values, n = _values(batch, dims), len(batch)
            was = batch["cluster"].to_numpy().astype(np.int64)
            upper, lower, cluster = batch["upper"].to_numpy().copy(), batch["lower"].to_numpy().copy(), was.copy()
            if drifts is not None:
                most = np.sort(drifts)[::-1]
                other = np.where(drifts[cluster] == most[0], most[1] if len(most) > 1 else 0.0, most[0]) if len(drifts) else 0.0
                upper = (upper + drifts[cluster]) * _UP
                with np.errstate(invalid="ignore"):  # a bound and a drift beyond doubles
                    lower = np.nan_to_num(np.maximum(lower - other, 0) * _DOWN, posinf=np.inf)
            assign(values, centroids, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["vector"] * n), batch["vec_id"], batch["v"], pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)]
                + [null(n, pa.int32()), null(n, pa.int64()), null(n, pa.list_(pa.int64()))],
                names,
            )
            moved = np.flatnonzero(was != cluster)
            sums = [*_sums(values[moved], cluster[moved], 1), *_sums(values[moved], was[moved], -1)]
            if sums:
                c, limb, k, parts = zip(*sums, strict=True)
                m = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["sum"] * m), null(m, pa.int64()), null(m, pa.list_(pa.float64())), pa.array(c, pa.int32()), null(m, pa.float64()), null(m, pa.float64())]
                    + [pa.array(limb, pa.int32()), pa.array(k, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                    names,
                )


def _moved(state: DataFrame, counts: list[int], totals: list[list[int]]) -> None:
    """Adds a round's sums to counts and totals: a row for each centroid and limb, whatever the number of vectors."""
    sums = state.where("part = 'sum'")
    n = sums.groupBy("cluster").agg(F.sum("n").alias("n")).collect()
    parts = sums.select("cluster", "limb", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "limb", "at").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("x"))
    for row in n:
        counts[row["cluster"]] += row["n"]
    for row in parts.collect():
        totals[row["cluster"]][row["at"]] += int(row["x"]) << (LIMB * row["limb"])


def _final(batches: Iterator[pa.RecordBatch], centroids: Centroids, dims: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, len(whole), ROWS):
            batch = whole.slice(lo, ROWS)
            squared = centroids.squared(_values(batch, dims), batch["cluster"].to_numpy().astype(np.int64))
            fits = [int(x) if x < 1 << 63 else None for x in squared.tolist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["cluster"], pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors of dims finite components, each as floor(scale * x), a whole double."""
    v = F.transform("embedding", lambda x: _floor(x.cast("double") * F.lit(float(scale))))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return only(vectors, "vec_id", "embedding").where(F.size("embedding") == dims).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(finite)


def _floor(x):
    """floor as a double: beyond 2**52 a double is whole already, and floor() gives a long."""
    return F.when(F.abs(x) < F.lit(float(1 << 52)), F.floor(x).cast("double")).otherwise(x)


def centroid_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """Clusters vectors round k centroids.

    vectors: vec_id, embedding. Takes part what has dims components, none null or non-finite, also after scaling; x becomes floor(scale * x).
    Centroids start as the k vectors with the least sha256 of "seed:vec_id", in its order. Each round assigns every vector to the
    nearest centroid (squared Euclidean distance; ties: smaller number) and moves non-empty centroids to the componentwise
    floor of their vectors' mean; then vectors are assigned once more.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia (sums of distances), centroid_sha256 (of the final
    centroid's components, joined by commas). Rows of equal vec_id are vectors of their own (as first centroids, those with
    smaller components come first); a null vec_id counts as "seed:" alone. Numbers are exact whatever their size; a distance or sum beyond a long is null. Fewer
    vectors than k: as many centroids. Other columns, whatever their names, aren't read. No vectors: no rows.
    """
    whole = whole_vectors(vectors, dims, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = [[int(x) for x in r["v"]] for r in whole.orderBy(key, "v").limit(k).collect()]
    out = "vec_id long, cluster int, distance long"
    if not rows:
        return whole.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).limit(0)
    centroids, drifts = Centroids(rows), None
    counts, totals = [0] * len(rows), [[0] * dims for _ in rows]
    state, read = None, whole.withColumns({"cluster": F.lit(-1), "upper": F.lit(0.0), "lower": F.lit(0.0)})
    for number in range(rounds + 1):
        after = written(read.mapInArrow(lambda batches, c=centroids, d=drifts: _round(batches, c, d, dims), _STATE), "part")
        if state is not None:
            released(state)
        state = after
        read = state.where("part = 'vector'").select("vec_id", "v", "cluster", "upper", "lower")
        if number < rounds:
            _moved(state, counts, totals)
            moved = Centroids([[x // n for x in total] if n else row for row, n, total in zip(centroids.rows, counts, totals, strict=True)])
            centroids, drifts = moved, centroids.drifts(moved)
    last = read.mapInArrow(lambda batches: _final(batches, centroids, dims), out)
    inertia = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.bool_or(F.col("distance").isNull()).alias("beyond")).collect()
    by = {r["cluster"]: None if r["beyond"] else int(r["d"]) for r in inertia}
    over = None if None in by.values() else sum(by.values())
    fits = lambda x: F.lit(x if x is not None and x < 1 << 63 else None).cast("long")
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.rows]
    per = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    return last.select("vec_id", "cluster", "distance", per(fits(by.get(c, 0)) for c in range(len(rows))).alias("cluster_inertia"), fits(over).alias("inertia"), per(F.lit(d) for d in digest).alias("centroid_sha256"))
