"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch of t coordinates is filled in rounds. In round i < t every shingle throws its hash into one hashed bin; in
round t + j all of them go to bin j, so no bin stays empty. A bin keeps its smallest value and earlier rounds have
smaller values, so a text stops as soon as its bins are full: about |S| + t log t steps, not |S| * t. The agreement of
two sketches concentrates round the Jaccard similarity as that of t independent MinHashes does.

Bands of `rows` coordinates are the buckets. With 64 bands of 8 a pair at similarity 0.8 shares none of them with
probability (1 - 0.8^8)^64 < 1e-5. Each bucket's texts are first compared with its first one, exactly, on full
shingle sets, so groups of copies cost a number of pairs in proportion to their size. Only where a bucket then still spans
several components are its other texts compared across components, by an exact prefix filter: sets that are alike enough
share one of their rarest shingles, the fewer the more alike they must be, and not too far along. Pairs that the hash cells
of both sets rule out are dropped where they meet. So a crowded bucket of texts that aren't alike, each with some shingles
of its own, gives hardly any pairs, and no link between candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, longs, mix, only, salted, shingle_sets, small_batches, small_or_shuffled, staged, text_chunks
from .components import components

#: Hash cells in which sets are compared before they are verified.
CELLS = 2048
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fill_bins(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: one row of t values each, the round in the upper 16 bits."""
    bins = np.full(len(sets) * t, _EMPTY, np.uint64)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        h = salted(items, i)
        bin_ = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(bins, owner * t + bin_, (h >> np.uint64(16)) | np.uint64(i << 48))
        full = (bins.reshape(-1, t) != _EMPTY).all(axis=1)
        if full.all():
            break
        if i % 4 == 3:  # texts whose bins are full gain nothing from later rounds
            keep = ~full[owner]
            items, owner = items[keep], owner[keep]
    return bins.reshape(-1, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cells = mix(sketches).reshape(len(sketches), bands, rows)
    total = np.zeros(cells.shape[:2], np.uint64)
    for r in range(rows):
        total += mix(cells[:, :, r] + np.uint64(r + 1))
    return mix(total + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    lo = np.array([np.add.reduce(salted(s, 101)) for s in sets], np.uint64)
    hi = np.array([np.add.reduce(salted(s, 102)) for s in sets], np.uint64)
    return lo, hi


def _sketch(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, raw, offsets in text_chunks(batch.column("text")):
            sets = shingle_sets(raw, offsets, n)
            some = [k for k, s in enumerate(sets) if len(s)]
            keys = band_keys(fill_bins([sets[k] for k in some], bands * rows), bands, rows)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:][some] = bands
            low, high = _set_ids(sets)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), longs(low), longs(high), pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), longs(keys.reshape(-1)))],
                names=["doc_id", "n", "lo", "hi", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in text_chunks(batch.column("text")):
            sets = shingle_sets(raw, offsets, n)
            low, high = _set_ids(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), longs(low), longs(high), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["doc_id", "lo", "hi", "shingles"],
            )


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common = [
            len(np.intersect1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True))
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"), pa.array(common, pa.int64())], names=["a", "b", "n_a", "n_b", "common"])


def _shingles(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Staged (node, n, shingles) of the nodes in a staged `wanted`, read anew from one of their texts each."""
    named = staged(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "lo", "hi", "n"))
    texts = docs.join(small_or_shuffled(named).select("doc_id"), "doc_id", "left_semi")
    sets = texts.mapInArrow(partial(_sets, n=n), "doc_id long, lo long, hi long, shingles binary")
    return staged(sets.join(named, ["doc_id", "lo", "hi"]).dropDuplicates(["node"]).select("node", "n", "shingles"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Staged (a, b, n_a, n_b, common) of staged pairs (a, b) of nodes: the exact overlap of their shingle sets."""
    wanted = staged(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    sets = _shingles(wanted, docs, nodes, n)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return staged(both.mapInArrow(_overlap, "a long, b long, n_a long, n_b long, common long"))


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("shingles")]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        where = pa.array(owner)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in ("node", "n", "root")), longs(np.concatenate([*sets, np.zeros(0, np.uint64)]))], names=["node", "n", "root", "shingle"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of CELLS hash cells a set has shingles in, as bits of longs."""
    for batch in batches:
        bits = []
        for s in batch.column("shingles"):
            cells = np.zeros(CELLS, np.uint8)
            cells[(salted(np.frombuffer(s.as_buffer(), np.uint64), 103) % np.uint64(CELLS)).astype(np.int64)] = 1
            bits.append(np.packbits(cells).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.list_(pa.int64()))], names=["node", "cells"])


def crossing_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of all pairs of sets (node, n, root, shingles) that may be linked and have other roots: an exact prefix filter.

    Linked sets have `least` = ceil(percent (n_x + n_y) / (100 + percent)) shingles in common. In the order of how many sets have
    a shingle, the smaller one's first n - ceil(2 percent n / (100 + percent)) + 1 and the other's first
    n - ceil(percent n / 100) + 1 have one in common, and behind the first such one there are enough on both sides.
    Shingles of one set only come first and are met by none, so they are counted and not sent. What two sets have in
    common is at most either's size less its shingles in cells that the other lacks.
    """
    each = sets.mapInArrow(_each_shingle, "node long, n long, root long, shingle long")
    held = staged(each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"))  # so that the join with a common shingle's rows can be split
    shared = each.join(held, "shingle").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("x"))
    shared = shared.withColumn("own", F.col("n") - F.size("x"))
    of = lambda least, whole: F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(least) * F.col("n") / F.lit(whole)) + 1 - F.col("own")).cast("int")
    asked = shared.select("node", "n", "root", "own", of(2 * percent, 100 + percent).alias("few"), F.slice("x", F.lit(1), of(percent, 100)).alias("x")).where("size(x) > 0")
    asked = asked.join(sets.mapInArrow(_cells, "node long, cells array<long>"), "node")
    asked = asked.select("node", "n", "root", "own", "few", "cells", F.posexplode(F.transform("x", lambda y: y["shingle"])).alias("place", "shingle"))
    asked = staged(asked.withColumn("left", F.col("n") - F.col("own") - F.col("place")))
    side = lambda df, x: df.select("shingle", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "root", "left", "cells")))
    lacking = lambda x, y: F.aggregate(F.zip_with(f"cells_{x}", f"cells_{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    enough = lambda most: most * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    ahead = (F.col("n_x") < F.col("n_y")) | (F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y"))
    met = ahead & (F.col("root_x") != F.col("root_y")) & (F.col("n_x") * 100 >= F.col("n_y") * percent) & enough(F.least("left_x", "left_y"))
    met = met & enough(F.col("n_x") - lacking("x", "y")) & enough(F.col("n_y") - lacking("y", "x"))
    both = side(asked.where("place < few"), "x").join(side(asked, "y"), "shingle").where(met)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 64, rows: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    n: words of a shingle (`[^ \\t-\\r]+` after lower-casing A-Z). Two documents are linked if their distinct shingles
    have 100 * intersection >= percent * union; component_id is the smallest doc_id that links reach. Equal 64-bit hashes
    count as equal shingles.

    Null or wordless text: an empty set, linked with nothing. Fewer than n words: the whole sequence is one shingle.
    Rows that repeat a doc_id count as one document: each of their texts that isn't empty may link it, and each row is
    returned. A null doc_id takes no part: component_id null, kept true. Other columns are ignored. An empty table: no rows.
    """
    docs = small_batches(docs)
    docs = only(docs, "doc_id", "text")
    sketched = staged(docs.mapInArrow(partial(_sketch, n=n, bands=bands, rows=rows), "doc_id long, n long, lo long, hi long, bands array<long>"))
    # one node for all documents with the same set
    some = sketched.where("n > 0 and doc_id is not null")
    nodes = some.groupBy("lo", "hi", "n").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("lo", "hi", "n", "x.doc_id", "x.bands")
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", "lead")
    buckets = staged(buckets)  # so that the join with a crowded bucket's rows can be split
    members = staged(keyed.join(buckets, "key").select("key", "lead", "node", "n"))
    star = members.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    star = _verified(staged(star), docs, nodes, n)
    linked = F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent
    # documents with several texts link these
    texts = some.select("doc_id", "lo", "hi").distinct()
    several = staged(texts.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    held = texts.join(several, "doc_id").join(nodes.select("lo", "hi", "node"), ["lo", "hi"]).select("doc_id", "node")
    own = held.groupBy("doc_id").agg(F.min("node").alias("a")).join(held, "doc_id").select("a", F.col("node").alias("b")).where("a < b")
    roots = components(star.where(linked).select("a", "b").unionByName(own))

    # buckets that still span components: what the star left open
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    rest = staged(placed.where("lead <> node").join(open_, "key").select("node", "root").distinct())
    sets = _shingles(rest.select("node"), docs, nodes, n).join(rest, "node")
    cross = staged(crossing_pairs(sets, percent).join(star.select("a", "b"), ["a", "b"], "left_anti"))
    more = _verified(cross, docs, nodes, n).where(linked).select("a", "b")
    # the links of the first round stand as its stars
    roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more))

    placed = nodes.select("lo", "hi", "node", F.col("doc_id").alias("_doc")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = staged(placed.groupBy("root").agg(F.min("_doc").alias("least")))
    same = placed.join(least, "root").select("lo", "hi", "least")
    out = sketched.select("doc_id", "n", "lo", "hi").join(same, ["lo", "hi"], "left")
    root = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("least")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
