"""Substring dedup by prefix doubling: every byte covered by a string of `length` bytes that starts earlier too is removed.

A string of `length` bytes is a window. A row of the sort is a range of windows that share a core: windows whose least hash
of CORE bytes (the same in equal windows) is at one place. offset = that place less the window's start, so equal windows
have equal offsets. A row carries the rank of the core and the rank of all the bytes that its windows cover.

Spark sorts these rank pairs, with document and place behind them. In that order
* a core that stands in no other row leaves: none of its windows repeats;
* of rows with equal pairs all windows but the first row's are repeated: they are marked, and the first goes on alone;
* what else shares a core is cut into ranges of fewer offsets (WIDTHS), whose cores are longer, and sorted again.
The last ranges are single windows with cores of `length` bytes. Copies so leave in the first sort, and only the rims of
repeated passages reach the last. Rows with equal pairs may lie in several partitions, as place is part of the sort, so no group has
to fit in one task; a run that touches a partition's edge goes on to the next sort, and in the last one each partition's
first row is joined with the others' last.

Ranks are 64-bit names by hashing, two to a row, so that unequal bytes pass for equal ones with a chance of 2**-128 each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import longs, mix, only, released, small_batches, small_or_shuffled, staged, text_chunks, written

#: Bytes of the first cores. Fewer: fewer rows in the first sort, more in the others.
CORE = 32
#: Offsets in a range of the second and later sorts; the last sort has single windows.
WIDTHS = (18, 5, 1)
#: Bytes of a text that are hashed at once; longer texts go piece by piece.
PIECE_BYTES = 1 << 18
#: Bytes of places or spans up to which they are broadcast to the texts; beyond that texts and places shuffle.
BROADCAST_BYTES = 32 << 20

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(20250711).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hashes:
    """Hashes of any stretch of some bytes, in time that doesn't grow with its length."""

    def __init__(self, raw: np.ndarray):
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), out=self.total[1:])
        self.back = _powers(_BACK, len(raw) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each `window` values in a row."""
    width = 1
    while width < window:
        step = min(width, window - width)
        values = np.minimum(values[: len(values) - step], values[step:])
        width += step
    return values


def window_ranges(raw: np.ndarray, offsets: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end, their windows as ranges: (core's hash, hash of all their bytes, core's place, least offset, greatest offset).

    Of equal least hashes in a window the leftmost counts, so place and offset depend on the window's bytes alone.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    hashes, span = Hashes(raw), length - core + 1
    names = mix((hashes.total[core:] - hashes.total[:-core]) * hashes.back[: len(raw) + 1 - core])
    least = _least(names, span)
    inside = np.ones(len(least), bool)
    for end in offsets[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    entered = np.zeros(len(least), bool)
    entered[1:] = inside[:-1] & (least[1:] < least[:-1])
    fresh = ~np.roll(inside, 1) | entered
    fresh[0] = True
    fresh[1:] |= (least[1:] != least[:-1]) | (names[: len(least) - 1] == least[:-1])
    first = np.flatnonzero(fresh & inside)
    over = np.ones(len(least), bool)
    over[:-1] = fresh[1:] | ~inside[1:]
    last = np.flatnonzero(over & inside)
    rank = least[first]
    # The core is where the range's last window starts, or what came in with its first one; else it is looked for.
    place = np.where(names[last] == rank, last, np.where(entered[first], first + span - 1, -1))
    for lo in range(0, len(open_ := np.flatnonzero(place < 0)), 4096):
        some = open_[lo : lo + 4096]
        place[some] = first[some] + np.argmax(names[first[some][:, None] + np.arange(span)] == rank[some][:, None], axis=1)
    return rank, _with_shape(hashes.of(first, last + length), place - last, place - first), place, place - last, place - first


def _with_shape(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(rank + (low.astype(np.uint64) << np.uint64(32)) + high.astype(np.uint64))


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes ahead of this piece, bytes, offsets): short texts together, long ones piece by piece, overlapping by length - 1."""
    for lo, hi, raw, offsets in text_chunks(column, PIECE_BYTES):
        if len(raw) <= PIECE_BYTES:
            yield lo, hi, 0, raw, offsets
        else:
            for at in range(0, max(1, len(raw) - length + 1), PIECE_BYTES):
                piece = raw[at : at + PIECE_BYTES + length - 1]
                yield lo, hi, at, piece, np.array([0, len(piece)])


def _first_rows(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, ahead, raw, offsets in _pieces(batch["text"], length):
            rank, whole, place, low, high = window_ranges(raw, offsets, length, core)
            if len(rank):
                row = np.searchsorted(offsets, place - high, side="right") - 1
                of = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([longs(rank), longs(whole), batch["doc_id"].take(of), batch["version"].take(of), pa.array(place - offsets[row] + ahead), pa.array(low, pa.int32()), pa.array(high, pa.int32())], _KEYS)


_KEYS = ["core", "whole", "doc_id", "version", "place", "low", "high"]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts or byte strings of a column without nulls, and the offsets in them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some stretches laid end to end, and their offsets."""
    offsets = np.append(0, np.cumsum(ends - starts))
    return raw[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])], offsets


def _cut(raw: np.ndarray, offsets: np.ndarray, row: pa.RecordBatch, length: int, width: int, core: int) -> Iterator[pa.RecordBatch]:
    """Ranges of windows cut at multiples of `width` offsets. raw, offsets: all bytes that the windows of each row cover; row: doc_id, version, place, low, high."""
    low, high = (row[c].to_numpy().astype(np.int64) for c in ("low", "high"))
    hashes, at = Hashes(raw), offsets[:-1] + high
    for p in range(0, length - core + 1, width):
        q = min(p + width - 1, length - core)
        some = np.flatnonzero((low <= q) & (high >= p))
        if not len(some):
            continue
        x, y, a = np.maximum(low[some], p), np.minimum(high[some], q), at[some]
        rank = mix(hashes.of(a - p, a - q + length) + np.uint64(p))
        whole, of = _with_shape(hashes.of(a - y, a - x + length), x, y), pa.array(some)
        own = []
        if width > 1:
            part, bounds = _stretches(raw, a - y, a - x + length)
            own = [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(part)])]
        yield pa.RecordBatch.from_arrays([longs(rank), longs(whole), *(row[c].take(of) for c in ("doc_id", "version", "place")), pa.array(x, pa.int32()), pa.array(y, pa.int32()), *own], [*_KEYS, *["bytes"] * len(own)])


#: Rows whose windows are cut at once.
ROWS = 8192


def _second_rows(batches: Iterator[pa.RecordBatch], length: int, core: int) -> Iterator[pa.RecordBatch]:
    """From texts with the places that are still open: the ranges of the second sort, each with its bytes."""
    for batch in batches:
        raw, offsets = _buffer(batch["text"])
        open_ = batch["open"]
        text = np.repeat(np.arange(len(batch)), np.diff(open_.offsets.to_numpy()))
        packed = open_.flatten().to_numpy()
        for lo in range(0, len(text), ROWS):
            some = slice(lo, lo + ROWS)
            place, high, low = packed[some] // (length + 1) ** 2, packed[some] // (length + 1) % (length + 1), packed[some] % (length + 1)
            of, at = pa.array(text[some]), offsets[text[some]] + place
            row = pa.RecordBatch.from_arrays([batch["doc_id"].take(of), batch["version"].take(of), pa.array(place), pa.array(low), pa.array(high)], ["doc_id", "version", "place", "low", "high"])
            own, bounds = _stretches(raw, at - high, at - low + length)
            yield from _cut(own, bounds, row, length, WIDTHS[0], core)


def _next_rows(batches: Iterator[pa.RecordBatch], length: int, width: int, core: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            part = batch.slice(lo, ROWS)
            raw, offsets = _buffer(part["bytes"])
            yield from _cut(raw[offsets[0] : offsets[-1]], offsets - offsets[0], part, length, width, core)


def _codes(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return column.dictionary_encode().indices.fill_null(-1).to_numpy()


def _differs(column: pa.Array) -> np.ndarray:
    codes = _codes(column)
    return codes[1:] != codes[:-1]


def _against_before(before: pa.RecordBatch | None, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of the batch, with the one ahead: has it another core, another pair, and is it a repeat of the very row? (A partition's first row: all new.)"""
    both = batch if before is None else pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
    core = _differs(both["core"])
    pair = core | _differs(both["whole"])
    same = ~pair & ~_differs(both["doc_id"]) & ~_differs(both["version"]) & ~_differs(both["place"])
    lead = np.ones(len(batch) - len(core), bool)
    return np.concatenate([lead, core]), np.concatenate([lead, pair]), np.concatenate([~lead, same])


def _spoken(batch: pa.RecordBatch, kind: str, rows: np.ndarray) -> pa.RecordBatch:
    part = batch.take(pa.array(np.flatnonzero(rows)))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.string()), *part.columns], ["kind", *part.schema.names])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those that repeat an earlier one ("repeated"), and the first of each pair whose core has other pairs too ("open").

    One row is held: the first of a core that has one pair so far.
    """
    before, several, held = None, True, None  # the first core may have begun in another partition
    for batch in batches:
        if not len(batch):
            continue
        core, pair, same = _against_before(before, batch)
        if before is None:
            core[0] = False
        run = np.cumsum(core)  # 0: the core of the row before
        pairs = np.bincount(run, weights=pair, minlength=run[-1] + 1)
        if held is not None and pairs[0]:
            yield _spoken(held, "open", np.ones(1, bool))
            several, held = True, None
        if held is not None and run[-1]:
            held = None
        many = pairs > 1
        many[0] = several
        yield _spoken(batch, "repeated", ~pair & ~same)
        yield _spoken(batch, "open", pair & many[run])
        if run[-1]:
            several = bool(many[-1])
            if not several:
                at = int(np.flatnonzero(core)[-1])
                held = batch.slice(at, 1)
        before = batch.slice(len(batch) - 1, 1)
    if held is not None:
        yield _spoken(held, "open", np.ones(1, bool))


def _last_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated rows of the last sort, and the partition's first and last row."""
    before = None
    for batch in batches:
        if not len(batch):
            continue
        _, pair, same = _against_before(before, batch)
        if before is None:
            yield _spoken(batch, "first", np.arange(len(batch)) == 0)
        yield _spoken(batch, "repeated", ~pair & ~same)
        before = batch.slice(len(batch) - 1, 1)
    if before is not None:
        yield _spoken(before, "last", np.ones(1, bool))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Touching spans of a document as one; rows are sorted by document and start, and one span is held."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        other = np.concatenate([[True], _differs(both["doc_id"]) | _differs(both["version"])])
        start, end = both["start"].to_numpy(), both["end"].to_numpy()
        shift = np.cumsum(other).astype(np.int64) * (int(end.max()) + 1)  # one document's ends don't reach the next
        reach = np.maximum.accumulate(end + shift)
        fresh = other.copy()
        fresh[1:] |= start[1:] + shift[1:] > reach[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(both)) - 1
        out = both.take(pa.array(first)).set_column(3, "end", pa.array((reach - shift)[last]))
        yield out.slice(0, len(out) - 1)
        held = out.slice(len(out) - 1, 1)
    if held is not None:
        yield held


def _kept(batches: Iterator[pa.RecordBatch], with_bytes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            whole = memoryview(text.as_buffer() or b"") if text.is_valid else memoryview(b"")
            digest, left, at, gone = hashlib.sha256(), [], 0, 0
            for s, e in [(x["start"], x["end"]) for x in spans.as_py() or ()] + [(len(whole), len(whole))]:
                digest.update(whole[at:s])
                if with_bytes:
                    left.append(bytes(whole[at:s]))
                at, gone = e, gone + e - s
            out.append((len(whole), gone, digest.hexdigest(), b"".join(left)))
        n, gone, digest, left = zip(*out, strict=True) if out else ((), (), (), ())
        spans = batch["spans"]
        counts = pa.array([len(x) if x.is_valid else 0 for x in spans], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), counts, pa.array(digest, pa.string()), spans, *([pa.array(left, pa.binary())] if with_bytes else [])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept"] * with_bytes],
        )


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["core", "whole", "doc_id", "version", "place"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def repeated_spans(docs: DataFrame, length: int = 100, core: int = CORE) -> DataFrame:
    """(doc_id, version, start, end) of the maximal byte runs to remove. docs: doc_id, version, text."""
    if not 1 <= core <= length:
        raise ValueError("core must lie between 1 and length")
    id_type = docs.schema["doc_id"].dataType
    ids = T.StructType([T.StructField("doc_id", id_type), T.StructField("version", T.LongType())])
    shape = T.StructType([T.StructField("core", T.LongType()), T.StructField("whole", T.LongType()), *ids, T.StructField("place", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])
    with_bytes = T.StructType([*shape, T.StructField("bytes", T.BinaryType())])
    spoken = lambda fields: T.StructType([T.StructField("kind", T.StringType()), *fields])
    span = [F.col("doc_id"), F.col("version"), (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + F.lit(length)).alias("end")]

    rows = docs.mapInArrow(lambda batches: _first_rows(batches, length, core), shape)
    found = written(_sorted(rows).mapInArrow(_scan, spoken(shape)).select("kind", "doc_id", "version", "place", "low", "high"))
    tables = [found]
    marked = [found.where("kind = 'repeated'").select(*span)]
    packed = (F.col("place") * (length + 1) + F.col("high")) * (length + 1) + F.col("low")  # a number for each place: the list may be broadcast
    open_ = found.where("kind = 'open'").groupBy("doc_id", "version").agg(F.collect_list(packed).alias("open"))
    open_ = small_or_shuffled(staged(open_), BROADCAST_BYTES, 64 + 8 * F.size("open"))
    open_ = open_.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "open")
    texts = docs.join(open_, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["version"] == F.col("_version"))).select("doc_id", "version", "text", "open")
    rows = texts.mapInArrow(lambda batches: _second_rows(batches, length, core), with_bytes)
    for width in WIDTHS[1:]:
        found = written(_sorted(rows).mapInArrow(_scan, spoken(with_bytes)))
        tables.append(found)
        marked.append(found.where("kind = 'repeated'").select(*span))
        rows = found.where("kind = 'open'").drop("kind").mapInArrow(lambda batches, width=width: _next_rows(batches, length, width, core), shape if width == 1 else with_bytes)
    found = written(_sorted(rows).mapInArrow(_last_scan, spoken(shape)))
    tables.append(found)
    marked.append(found.where("kind = 'repeated'").select(*span))
    ends = found.where("kind = 'last'").select(F.col("core").alias("_core"), F.col("whole").alias("_whole"), F.struct("doc_id", "version", "place").alias("_at"))
    same = (F.col("core") == F.col("_core")) & (F.col("whole") == F.col("_whole")) & (F.col("_at") < F.struct("doc_id", "version", "place"))
    marked.append(found.where("kind = 'first'").join(ends, same, "left_semi").select(*span))
    spans = marked[0]
    for more in marked[1:]:
        spans = spans.unionByName(more)
    out = T.StructType([*ids, T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    merged = written(spans.repartition("doc_id", "version").sortWithinPartitions("doc_id", "version", "start").mapInArrow(_merged, out))
    released(*tables)
    return merged


def suffix_dedup(docs: DataFrame, length: int = 100, with_bytes: bool = True) -> DataFrame:
    """Removes each byte of a text (UTF-8) that lies in a string of `length` bytes that also starts earlier.

    docs: doc_id, text. Returns a row for each: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of
    what remains, laid end to end), spans (their bounds; null: none) and, if with_bytes, kept (binary: a cut may part a character).

    Earlier is a smaller doc_id, or in the same document an earlier start; strings may overlap, and are judged on the input. A
    null text is empty; a text under `length` bytes loses nothing. A null doc_id comes before all others. Rows that repeat
    doc_id and text are one document, and each gets its result; rows that share only the doc_id come in order of their texts'
    hashes. Long texts are hashed piece by piece. Other columns, whatever their names, aren't read. No rows: no rows.
    """
    docs = only(small_batches(docs), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    named = docs.select("doc_id", F.xxhash64("text").alias("h"))
    several = staged(named.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select(F.col("doc_id").alias("_several")))
    docs = docs.withColumn("version", F.lit(0).cast("long"))
    if several.count():
        known = small_or_shuffled(several).withColumn("_known", F.lit(True))
        version = F.when(F.col("_known"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
        docs = docs.join(known, docs["doc_id"].eqNullSafe(F.col("_several")), "left").select("doc_id", "text", version.alias("version"))
    spans = repeated_spans(docs, length)
    by_doc = staged(spans.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    by_doc = small_or_shuffled(by_doc, BROADCAST_BYTES, 64 + 40 * F.size("spans")).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "spans")
    joined = docs.join(by_doc, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["version"] == F.col("_version")), "left").select("doc_id", "text", "spans")
    out = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", joined.schema["spans"].dataType), *([T.StructField("kept", T.BinaryType())] if with_bytes else [])])
    return joined.mapInArrow(lambda batches: _kept(batches, with_bytes), out)
