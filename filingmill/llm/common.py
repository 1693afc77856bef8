"""Helpers shared by the corpus operators: staging, bounded broadcasts and word hashing in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import released as released
from ..staging import staged as staged
from ..staging import written as written

#: Rows up to which a table of a few numeric columns may be broadcast (at most some 24 MB).
BROADCAST_ROWS = 1_000_000
#: Bytes of text that numpy works on at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Rows of texts that go to a Python worker at once: JVM and worker each hold some copies of such a batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """A staged df with a broadcast hint if it has at most `limit` rows, or if the weights of its rows sum up to that at most; as it is otherwise."""
    size = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session that sends at most BATCH_ROWS rows at once to Python workers. A lower setting stays as it is."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns: others, whatever they are called, can't clash with ours."""
    return df.select(*names)


# --- numpy -----------------------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]  # A-Z hash as a-z
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

#: Word bytes by class. "blank": all but ASCII white space; "alnum": digits, letters and whatever isn't ASCII.
IN_WORD = {
    "blank": np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)]),
    "alnum": np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]),
}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets in them) of runs of rows with up to `limit` bytes; null is empty."""
    column = (column.fill_null("") if column.null_count else column).cast(pa.large_string())
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(raw: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, with A-Z lower-cased; each text's first word, and the end; each word's length in bytes."""
    inside = IN_WORD[kind][raw]
    n_texts = len(offsets) - 1
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64), np.zeros(0, np.int64)
    begins = np.ones(len(raw), bool)
    begins[1:] = ~inside[:-1]
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    begins &= inside
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begins[at])
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = np.ones(int(length.max()), np.uint64)
    if len(powers) > 1:
        powers[1:] = _STEP[0]
        powers = np.cumprod(powers)
    hashes = mix(np.add.reduceat(_BYTE[raw[at]] * powers[place], first) + length.astype(np.uint64))
    return hashes, np.searchsorted(at[first], offsets, side="left"), length


def word_beginnings(raw: np.ndarray, offsets: np.ndarray, kind: str, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the hashes of the words' first so many bytes (all, if there are fewer)."""
    inside = IN_WORD[kind][raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts_text = offsets[:-1][offsets[:-1] < len(raw)]
    begins[starts_text] = inside[starts_text]
    at = np.flatnonzero(inside)
    first = np.flatnonzero(begins[at])
    ends = np.append(first, len(at))[1:]
    place = np.minimum(np.arange(len(at)) - np.repeat(first, ends - first), max(sizes))
    total = np.zeros(len(at) + 1, np.uint64)
    np.cumsum(_BYTE[raw[at]] * _STEP[place], out=total[1:])
    for n in sizes:
        yield n, mix(total[np.minimum(first + n, ends)] - total[first])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, for each start (those that cross from one text to the next included)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += words[j : j + m] * _STEP[j + 1]
    return mix(total + np.uint64(n))


def gram_hashes_at(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The same at some starts only."""
    total = np.zeros(len(starts), np.uint64)
    for j in range(n):
        total += words[starts + j] * _STEP[j + 1]
    return mix(total + np.uint64(n))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; with fewer words the whole sequence as one; none without words."""
    words, first, _ = word_hashes(raw, offsets, "blank")
    grams = gram_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64), pa.int64())
