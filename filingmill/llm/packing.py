"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Pieces are dealt at random to partitions of some thousand; each is packed by best-fit decreasing and compared with the
best lower bound that dual feasible functions give for its sizes. A partition that needs more sequences than its bound
has a gap: it is packed again with a look-ahead of two pieces, and the smaller packing stands. If there still is a gap, its
pieces are exchanged with those of other such partitions and packed anew in the same way, in larger partitions, and the
new packing is taken if it is smaller. Partitions without a gap are certified and stay.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches, staged

#: Code points below this are known to be cut alike by both tokenizer libraries (tests/llm); other texts go to the slower one.
PLAIN = 0x250
#: Runs of white space from this length on go to the slower library: the faster one's pattern gives up on a run of a million.
_LONG_BLANK = re.compile(r"\s{10000}")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"row long, {_PIECES}, part long, bin int, offset long, gap int"
#: Bins of a partition, as bits of a sequence's number; the partition and its turn take the others.
BIN_BITS, TURN_BITS = 20, 40


@lru_cache(1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _fast(tokenizer: str, ranks: str | None, pattern: str):
    """A faster library's form of the tokenizer's vocabulary and the names of its special tokens, if there is a rank file."""
    if ranks is None:
        return None, frozenset()
    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens=specials), frozenset(specials)


def token_ids(text: str, tokenizer: str, ranks: str | None, pattern: str) -> np.ndarray:
    """The tokenizer's ids, without added special tokens; such a token's own string in the text is that token."""
    fast, specials = _fast(tokenizer, ranks, pattern)
    if fast is not None and (text.isascii() or max(text) < chr(PLAIN)) and not _LONG_BLANK.search(text):
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special=specials, disallowed_special=()), "<u4")
        except ValueError:  # its pattern gives up where it would go too deep; the tokenizer itself doesn't
            pass
    return np.array(_tokenizer(tokenizer).encode(text, add_special_tokens=False).ids, "<u4")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces: only the first may be shorter than the capacity."""
    first = (len(ids) - 1) % capacity + 1
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, ranks: str | None, pattern: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.append(token_ids(text.as_py() or "", tokenizer, ranks, pattern), np.uint32(end_id)).astype("<u4")
            rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(cut(ids, capacity))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs at least: the best of two families of dual feasible functions, in whole numbers.

    U_e: sizes over capacity - e count as whole bins, those under e as nothing, others as they are (e = 0: the plain sum).
    u_k: with (k + 1) x / capacity whole, x counts as it is; else as floor((k + 1) x / capacity) / k bins.
    """
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    large = np.cumsum(counts[::-1])[::-1]  # items of this size or more
    mass = np.cumsum(counts * x)
    for e in range(capacity // 2 + 1):
        whole = int(large[capacity - e + 1]) if e else 0
        middle = int(mass[capacity - e] - (mass[e - 1] if e else 0))
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 33):
        steps, exact = np.divmod((k + 1) * x, capacity)
        best = max(best, -(-int((np.where(exact == 0, k * x, steps * capacity) * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and what each bin holds: largest first, each into the fullest bin that has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, filled = 0, []  # bit r of rooms: a bin with room r
    bins, offsets = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        by_room[room - size].append(b)
        if room > size:
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(filled, np.int64)


def best_fit_ahead(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, one bin after another: the largest item left, then again and again what fills the rest of the bin best, one item or the larger of two."""
    of_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        of_size[int(sizes[i])].append(i)
    left = np.bincount(sizes, minlength=capacity + 1)
    upto = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))  # the largest size left that isn't larger
    bins, offsets, filled = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64), []
    for _ in range(len(sizes)):
        size, room = int(upto[capacity]), capacity
        if not size:
            break
        while size:
            i = of_size[size].pop()
            bins[i], offsets[i] = len(filled), capacity - room
            room -= size
            left[size] -= 1
            if not left[size]:
                upto = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
            size = int(upto[room])
            if 0 < size < room:
                one = np.flatnonzero(left[: room + 1])
                other = upto[room - one]
                # a size can't be its own partner unless there are two of it
                other = np.where((other == one) & (left[one] < 2), upto[np.maximum(one - 1, 0)], other)
                best = int(np.argmax(one + other))
                if one[best] + other[best] > size:
                    size = int(max(one[best], other[best]))
        filled.append(capacity - room)
    return bins, offsets, np.array(filled, np.int64)


def _pack(key: tuple, group: pa.Table, capacity: int) -> pa.Table:
    group = group.take(np.argsort(group["row"].to_numpy(), kind="stable"))
    sizes = group["length"].to_numpy()
    bins, offsets, filled = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(filled) > bound:
        again = best_fit_ahead(sizes, capacity)
        bins, offsets, filled = min((bins, offsets, filled), again, key=lambda packing: len(packing[2]))
    made = [("part", np.full(len(sizes), key[0].as_py(), np.int64)), ("bin", bins), ("offset", offsets), ("gap", np.full(len(sizes), len(filled) - bound, np.int32))]
    for name, values in made:
        group = group.append_column(name, pa.array(values))
    return group


def _packed(pieces: DataFrame, capacity: int, partition_pieces: int, n: int, turn: int) -> DataFrame:
    """Staged packing of the pieces, dealt by a hash of their row, so that neither repeated nor null documents crowd a partition."""
    parts = max(1, -(-n // partition_pieces))
    own = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)) + F.lit(turn << TURN_BITS)
    dealt = pieces.select("row", "doc_id", "piece", "start", "length", "ids_crc32", own.alias("deal"))
    pack = lambda key, group: _pack(key, group.drop_columns(["deal"]), capacity)
    return staged(dealt.groupBy("deal").applyInArrow(pack, _PACKED))


def _bins(packed: DataFrame) -> int:
    return packed.select("part", "bin").distinct().count()


def best_fit_packing(docs: DataFrame, tokenizer: str, ranks: str | None, pattern: str, end_id: int, capacity: int = 1024, partition_pieces: int = 4096, turns: int = 3) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text).

    A document is its ids and then end_id. Only one longer than the capacity is cut, into pieces of the capacity, of which
    the first may be shorter. sequence_id: any number; offset: the piece's place in its sequence, without holes.
    tokenizer, ranks: paths to a tokenizer file and (or null) to the same vocabulary as ranks, with its pattern.

    Null text is empty: end_id alone. Repeated rows and null doc_ids are packed like any others. Other columns are
    ignored. An empty table: no rows. turns: exchanges at most, each between partitions four times as large as before.
    """
    docs = small_batches(docs)
    cut_up = partial(_pieces, tokenizer=tokenizer, ranks=ranks, pattern=pattern, end_id=end_id, capacity=capacity)
    if not 0 <= turns <= 7:
        raise ValueError(f"turns must lie between 0 and 7: {turns}")
    pieces = only(docs, "doc_id", "text").mapInArrow(cut_up, _PIECES)
    pieces = staged(pieces.withColumn("row", F.monotonically_increasing_id()))
    packed = _packed(pieces, capacity, partition_pieces, pieces.count(), 0)
    for turn in range(1, turns + 1):
        loose = F.col("gap") > 0
        open_ = packed.where(loose)
        n = open_.count()
        if open_.select("part").distinct().count() < 2:
            break
        again = _packed(open_, capacity, partition_pieces * 4**turn, n, turn)
        if _bins(again) >= _bins(open_):
            break
        packed = packed.where(~loose).unionByName(again)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("part") * (1 << BIN_BITS) + F.col("bin")).alias("sequence_id"), "offset")
