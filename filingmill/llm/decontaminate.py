"""Benchmark decontamination by winnowing.

Every 13-word window holds nine 5-grams; each window marks its smallest 5-gram hash (all places, if several). A text's
marks are its fingerprints. A window that a document shares with an item has the same smallest 5-gram on both sides, so
the join of fingerprints misses no shared span of 13 words or more. Each hit is then extended to the up to nine windows
round it, whose own hashes are joined with the items' windows. An item of m < 13 words is one window of m words and its
own fingerprint.

Documents send one row each and only what may match: where the items have at most BROADCAST_ROWS fingerprints, their
sorted hashes are shipped to the tasks, as a filter before the joins. Beyond that the joins do it all by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, gram_hashes, gram_hashes_at, longs, only, small_batches, staged, text_chunks, word_hashes

#: Words of a window, of a fingerprint's gram, and grams in a window.
WINDOW, GRAM = 13, 5
GRAMS = WINDOW - GRAM + 1


def _ends(first: np.ndarray) -> np.ndarray:
    """For each word of texts laid end to end: where its text ends."""
    return np.repeat(first[1:], np.diff(first))


def winnow(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the marked grams, all gram hashes, and which window starts have a whole window in their text."""
    ends, n = _ends(first), len(words)
    whole = np.arange(n) + WINDOW <= ends
    grams = np.zeros(n, np.uint64)
    grams[: max(0, n - GRAM + 1)] = gram_hashes(words, GRAM)
    m = n - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64), grams, whole
    least = grams[:m].copy()
    for j in range(1, GRAMS):
        np.minimum(least, grams[j : j + m], out=least)
    least[~whole[:m]] = 0
    marked = np.zeros(n, bool)
    for j in range(GRAMS):
        marked[j : j + m] |= (least == grams[j : j + m]) & whole[:m]
    return np.flatnonzero(marked), grams, whole


def _within(values: np.ndarray, ordered: np.ndarray | None) -> np.ndarray:
    if ordered is None:
        return np.ones(len(values), bool)
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, kind, hash, is_window): kind is the words of the item's windows."""
    for batch in batches:
        for lo, hi, raw, offsets in text_chunks(batch.column("text")):
            words, first, _ = word_hashes(raw, offsets, "alnum")
            marks, grams, whole = winnow(words, first)
            starts = np.flatnonzero(whole)
            windows = gram_hashes(words, WINDOW)
            owner = np.repeat(np.arange(hi - lo), np.diff(first))
            out = [(owner[marks], 0 * marks + WINDOW, grams[marks], False), (owner[starts], 0 * starts + WINDOW, windows[starts] if len(starts) else np.zeros(0, np.uint64), True)]
            for k, n in enumerate(np.diff(first).tolist()):
                if 0 < n < WINDOW:
                    h = gram_hashes(words[first[k] : first[k + 1]], n)
                    out += [(np.array([k]), np.array([n]), h, False), (np.array([k]), np.array([n]), h, True)]
            for rows, kinds, hashes, is_window in out:
                items = batch.column("item_id").slice(lo, hi - lo).cast(pa.int64()).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([items, pa.array(kinds, pa.int32()), longs(hashes), pa.array(np.full(len(rows), is_window))], names=["item_id", "kind", "hash", "is_window"])


_PRINTS = "array<struct<kind:int,hash:long,windows:array<struct<pos:int,hash:long>>>>"


def _doc_prints(batches: Iterator[pa.RecordBatch], shorts: list[int], known) -> Iterator[pa.RecordBatch]:
    """A row for each document: its words and its fingerprints, with the windows round them. known: a broadcast of sorted hashes by (kind, is_window), or None."""
    wanted = known.value if known is not None else None
    none = np.zeros(0, np.uint64)
    get = lambda kind, is_window: None if wanted is None else wanted.get((kind, is_window), none)
    for batch in batches:
        for lo, hi, raw, offsets in text_chunks(batch.column("text")):
            words, first, _ = word_hashes(raw, offsets, "alnum")
            marks, grams, whole = winnow(words, first)
            marks = marks[_within(grams[marks], get(WINDOW, False))]
            starts = (marks[:, None] - np.arange(GRAMS)[None, :]).reshape(-1)  # windows that hold the mark
            print_ = np.repeat(np.arange(len(marks)), GRAMS)
            ok = (starts >= 0) & whole[np.maximum(starts, 0)] if len(starts) else np.zeros(0, bool)
            starts, print_ = starts[ok], print_[ok]
            hashes = gram_hashes_at(words, starts, WINDOW)
            ok = _within(hashes, get(WINDOW, True))
            starts, print_, hashes = starts[ok], print_[ok], hashes[ok]
            at, kind, key = [marks], [np.full(len(marks), WINDOW)], [grams[marks]]
            win_print, win_at, win_hash, n = [print_], [starts], [hashes], len(marks)
            for m in shorts:
                g = gram_hashes(words, m)
                s = np.flatnonzero((np.arange(len(g)) + m <= _ends(first)[: len(g)]) & _within(g, get(m, False)))
                at, kind, key = [*at, s], [*kind, np.full(len(s), m)], [*key, g[s]]
                win_print, win_at, win_hash, n = [*win_print, np.arange(n, n + len(s))], [*win_at, s], [*win_hash, g[s]], n + len(s)
            at, kind, key, win_print, win_at, win_hash = map(np.concatenate, (at, kind, key, win_print, win_at, win_hash))
            order = np.argsort(at, kind="stable")  # prints by text, windows by print
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            by = np.argsort(rank[win_print], kind="stable") if len(win_print) else np.zeros(0, np.int64)
            per_print = np.searchsorted(rank[win_print][by], np.arange(len(order) + 1)) if len(win_print) else np.zeros(len(order) + 1, np.int64)
            text_of = np.searchsorted(first, win_at[by], side="right") - 1
            windows = pa.StructArray.from_arrays([pa.array(win_at[by] - first[text_of], pa.int32()), longs(win_hash[by])], names=["pos", "hash"])
            windows = pa.ListArray.from_arrays(pa.array(per_print, pa.int32()), windows)
            prints = pa.StructArray.from_arrays([pa.array(kind[order], pa.int32()), longs(key[order]), windows], names=["kind", "hash", "windows"])
            prints = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[order], first), pa.int32()), prints)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(first), pa.int64()), prints], names=["doc_id", "n_words", "prints"])


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = 5, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs (doc_id, text).

    Words: `[0-9a-z]` and all that isn't ASCII, in runs, after lower-casing A-Z. A window is 13 consecutive words of an
    item of benchmark (item_id, text), or all of a shorter one. A document's words inside any occurrence of a window are
    hit; it is contaminated if it has any and they are `percent` of its words or more.

    Null or wordless text: no words, no hits, not contaminated; such items have no windows. Repeated rows of docs are
    judged one by one. Items that repeat an item_id count once; one whose item_id is null hits words without being
    counted. Other columns are ignored. An empty table of documents: no rows; of items: no hits.
    """
    docs = small_batches(docs)
    spark = docs.sparkSession
    items = staged(only(benchmark, "item_id", "text").mapInArrow(_item_prints, "item_id long, kind int, hash long, is_window boolean").distinct())
    shorts = sorted(r["kind"] for r in items.where(F.col("kind") < WINDOW).select("kind").distinct().collect())  # 12 at most
    known = None
    if items.count() <= broadcast_rows:
        rows = items.select("kind", "is_window", "hash").distinct().toPandas()
        known = spark.sparkContext.broadcast({key: np.sort(g["hash"].to_numpy(np.int64).view(np.uint64)) for key, g in rows.groupby(["kind", "is_window"])})
    marked = only(docs, "doc_id", "text").mapInArrow(partial(_doc_prints, shorts=shorts, known=known), f"doc_id long, n_words long, prints {_PRINTS}")
    marked = staged(marked.withColumn("row", F.monotonically_increasing_id()))
    prints = marked.select("row", F.explode("prints").alias("p")).select("row", "p.kind", "p.hash", "p.windows")
    found = prints.join(items.where("not is_window").select("kind", "hash").distinct(), ["kind", "hash"], "left_semi")
    found = found.select("row", "kind", F.explode("windows").alias("w")).select("row", "kind", "w.pos", "w.hash").distinct()
    hits = found.join(items.where("is_window").select("kind", "hash", "item_id"), ["kind", "hash"])
    spans = F.array_sort(F.collect_set(F.struct("pos", "kind")))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda a, x: F.struct(F.greatest(a["end"], x["pos"] + x["kind"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["pos"] + x["kind"] - F.greatest(a["end"], x["pos"]))).alias("sum")),
        lambda a: a["sum"],
    )
    judged = hits.groupBy("row").agg(covered.alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = marked.select("row", "doc_id", "n_words").join(judged, "row", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))
