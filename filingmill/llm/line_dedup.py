"""Line dedup by pairwise alignment.

A line ends at a line break or, as running text is one long line, after a sentence (`.`, `!` or `?` and a space). Single
lines are often common ones, so documents meet through hashes of min_words words in a row that begin with a line, through
as many lines as that takes, or that end at a line break. For passages within long lines they also meet through winnowed
words, so that SPAN_WORDS words in a row hold one run at least. Such runs are rare, and where one isn't, it costs no more rows
than it has holders: its first holder (smallest doc_id) stands for it, and every later one is paired with that.

A pair is only what both have: the shared runs with their places on both sides. Runs that continue each other become
blocks, which patience diff aligns: blocks that stand once on both sides and keep their order come first; what is left (moved
or repeated passages) is aligned in its turn, so nothing shared is missed. A block that ends within a line grows word by
word into the words round the first holder's copy. The later document's blocks are deleted.

So no run of lines with min_words words that an earlier document has is left, whatever its lines' length, nor are
SPAN_WORDS words in a row. Of the last sentences of a block that ends before its line does, fewer than min_words words may stay,
if the first holder of those ahead of them goes on otherwise.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import longs, mix, only, small_batches, small_or_shuffled, staged, text_chunks, word_hashes

#: Repeated words in a row from which a passage meets an earlier document that holds it, wherever its lines end.
SPAN_WORDS = 50
#: Words of the shingles by which near copies are told.
SHINGLE = 5
_BREAK = re.compile(r"(\n|(?<=[.!?]) )")
_WORDS = re.compile(r"[^ \t\n\v\f\r]+")
#: Bytes of ranges and neighbouring words up to which they may be broadcast.
BROADCAST_BYTES = 8 << 20


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words from starts up to ends; in time that doesn't grow with their number."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, len(words)), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(_BACK, len(words) + 1)[starts] + (ends - starts).astype(np.uint64))


def _slide(values: np.ndarray, window: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) of each `window` values in a row."""
    width, out = 1, values
    while width < window:
        step = min(width, window - width)
        out = pick(out[: len(out) - step], out[step:])
        width += step
    return out


def winnowed(hashes: np.ndarray, window: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places that hold the least of any (or any wanted) `window` hashes in a row; of equal ones near each other only so many that none is missed."""
    window = max(1, min(window, len(hashes)))
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = _slide(hashes, window, np.minimum)
    if wanted is not None:
        least = np.where(wanted[: len(least)], least, np.uint64(0))
    edge = np.zeros(window - 1, np.uint64)
    places = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), window, np.maximum) == hashes)
    same = np.zeros(len(places), bool)
    same[1:] = hashes[places[1:]] == hashes[places[:-1]]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(places))))
    step = (places - places[head]) // 10
    keep = ~same
    keep[1:] |= step[1:] != step[:-1]
    keep[:-1] |= ~same[1:]
    return places[keep]


def line_starts(raw: np.ndarray, offsets: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of texts laid end to end those that begin a line or a sentence, and those ahead of which a line break or a text's end is, as places; each with the number of words at the end."""
    blank = np.isin(raw, np.array([32, 9, 10, 11, 12, 13], np.uint8))
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    begins = ~blank
    begins[1:] &= blank[:-1]
    begins[edge] = ~blank[edge]
    after = np.zeros(len(raw), bool)
    after[1:] = np.isin(raw[:-1], np.frombuffer(b".!?", np.uint8))
    after[edge] = False
    words = np.flatnonzero(begins)
    first = lambda breaks: np.unique(np.concatenate([np.searchsorted(words, edge), np.searchsorted(words, np.flatnonzero(breaks)), [n_words]]))
    return first((raw == 10) | (raw == 32) & after), first(raw == 10)


def anchors(words: np.ndarray, first: np.ndarray, lines: np.ndarray, breaks: np.ndarray, min_words: int) -> np.ndarray:
    """Starts of the runs of min_words words by which texts meet, in order. first: each text's first word, and the end; lines, breaks: from line_starts.

    They begin with a line or sentence, or end at a line break. Where SPAN_WORDS words hold none that begins so, as none
    begins in their first words, they hold a winnowed one.
    """
    grams = np.arange(max(0, len(words) - min_words + 1))
    if not len(grams):
        return grams
    end = first[np.searchsorted(first, grams, side="right")]
    whole = grams + min_words <= end
    hashes = np.where(whole, run_hashes(words, grams, grams + min_words), np.uint64(0xFFFFFFFFFFFFFFFF))
    span = max(SPAN_WORDS, min_words)
    after = np.append(lines, 1 << 40)[np.searchsorted(lines, grams, side="right")]
    told = winnowed(hashes, span - min_words + 1, (grams + span <= end) & (after + min_words > grams + span))
    some = np.concatenate([lines, breaks - min_words, told])
    some = np.unique(some[(some >= 0) & (some < len(grams))])
    return some[whole[some]]


def _anchor_rows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Each text's runs: hash, first word, whether the text has it further ahead already. Case of A-Z and white space in a line don't count."""
    for batch in batches:
        for lo, hi, raw, offsets in text_chunks(batch.column("text")):
            words, first, _ = word_hashes(raw, offsets, "blank")
            s = anchors(words, first, *line_starts(raw, offsets, len(words)), min_words)
            text = np.searchsorted(first, s, side="right") - 1
            runs = run_hashes(words, s, s + min_words)
            again = np.ones(len(s), bool)
            order = np.lexsort((s, runs, text))
            again[order[np.append(True, (np.diff(text[order]) != 0) | (np.diff(runs[order]) != 0))[: len(s)]]] = False
            at = pa.array(np.searchsorted(s, first), pa.int32())
            lists = [pa.ListArray.from_arrays(at, x) for x in (longs(runs), pa.array(s - first[text], pa.int32()), pa.array(again))]
            names = ["doc_id", "version", "words", "run", "start", "again"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("version").slice(lo, hi - lo), pa.array(np.diff(first), pa.int32()), *lists], names=names)


def joined_blocks(doc: np.ndarray, mate: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, mate, start, end, at) of the blocks: runs of a pair that continue or overlap each other equally on both sides, joined."""
    order = np.lexsort((start, start - at, mate, doc))
    doc, mate, start, end, at = (x[order] for x in (doc, mate, start, end, at))
    key = np.zeros(len(doc), np.int64)
    key[1:] = np.cumsum((np.diff(doc) != 0) | (np.diff(mate) != 0) | (np.diff(start - at) != 0))
    reach = np.maximum.accumulate(end + (key << 32)) - (key << 32)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (np.diff(key) != 0) | (start[1:] > reach[:-1])
    head = np.flatnonzero(fresh)
    last = np.append(head[1:], len(doc))[: len(head)] - 1
    return doc[head], mate[head], start[head], reach[last], at[head]


def _rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence."""
    tails: list[int] = []
    places: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = places[k - 1] if k else -1
        tails[k:], places[k:] = [v] + tails[k + 1 :], [i] + places[k + 1 :]
    out = []
    i = places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(blocks: list[tuple[int, int, int]]) -> list[bool]:
    """Which of the (start, end, start on the other side) blocks, in order of their start, patience diff aligns at first: those that stand once and keep their order."""
    times: dict[tuple[int, int], int] = {}
    for s, e, at in blocks:
        times[at, e - s] = times.get((at, e - s), 0) + 1
    once = [k for k, (s, e, at) in enumerate(blocks) if times[at, e - s] == 1]
    aligned = {once[k] for k in _rising([blocks[i][2] for i in once])}
    return [k in aligned for k in range(len(blocks))]


def _open_ends(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether no other block of its text holds both the block's first word and the one ahead of it; and so for its last word and the one behind it."""

    def before(keys: np.ndarray, values: np.ndarray, pick, none: int) -> np.ndarray:
        """pick of the values of all smaller keys."""
        order = np.argsort(keys, kind="stable")
        least = np.searchsorted(keys[order], keys)
        return np.append(none, pick.accumulate(values[order]))[least]

    base = doc << 32
    reach = before(base + start, base + end, np.maximum, -1)
    least = before(-(base + end), base + start, np.minimum, 1 << 62)
    return (reach < base + start) & (start > 0), least > base + end


_BLOCK = "struct<start:int,end:int,first:bigint,first_row:bigint,first_words:int,at:int,moved:boolean,left:boolean,right:boolean>"


def _blocks(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = batch.column("hits")
        sizes = hits.value_lengths().to_numpy(zero_copy_only=False)
        x = hits.flatten()
        first, first_row, first_words, start, at = (x.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "first_row", "first_words", "start", "at"))
        rows, one, mate = np.unique(first_row, return_index=True, return_inverse=True)
        doc, mate, start, end, at = joined_blocks(np.repeat(np.arange(len(sizes)), sizes), mate.reshape(-1), start, start + min_words, at)
        left, right = _open_ends(doc, start, end)
        moved = np.zeros(len(doc), bool)
        order = np.lexsort((start, mate, doc))
        edges = np.flatnonzero(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(mate[order]) != 0))) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=False):
            if b - a > 1:
                some = order[a:b]
                moved[some] = ~np.array(patience(list(zip(start[some].tolist(), end[some].tolist(), at[some].tolist(), strict=True))))
        fields = {"start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "first": pa.array(first[one][mate]), "first_row": pa.array(rows[mate]), "first_words": pa.array(first_words[one][mate], pa.int32()), "at": pa.array(at, pa.int32()), "moved": pa.array(moved), "left": pa.array(left & (at > 0)), "right": pa.array(right)}
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(sizes) + 1)), pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "version", "row")), lists], names=["doc_id", "version", "row", "blocks"])


def _small_hashes(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype("<u4")


def _neighbours(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Hashes of up to `reach` words ahead of each place asked for (behind: false) or from it on."""
    for batch in batches:
        for lo, hi, raw, offsets in text_chunks(batch.column("text")):
            words, first, _ = word_hashes(raw, offsets, "blank")
            small = _small_hashes(words)
            rows = []
            for k, asked in zip(range(lo, hi), batch.column("asked").slice(lo, hi - lo).to_pylist(), strict=True):
                a, b = int(first[k - lo]), int(first[k - lo + 1])
                for x in asked:
                    p = a + x["place"]
                    rows.append((k, x["place"], x["behind"], (small[p : min(b, p + reach)] if x["behind"] else small[max(a, p - reach) : p]).tobytes()))
            k, place, behind, near = zip(*rows, strict=True) if rows else ((), (), (), ())
            where = pa.array(k, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("first_row").take(where), pa.array(place, pa.int32()), pa.array(behind, pa.bool_()), pa.array(near, pa.binary())], names=["first_row", "place", "behind", "near"])


def line_blocks(docs: DataFrame, min_words: int) -> DataFrame:
    """Staged (doc_id, version, blocks, ends) of the documents that lose lines. version: xxhash64 of the text.

    blocks: word ranges shared with an earlier document (first), where they begin at word `at`; ends: at
    which word a block may grow, to which side, and the hashes of the earlier document's words there.
    """
    keyed = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("version"))
    kept = keyed.mapInArrow(partial(_anchor_rows, min_words=min_words), "doc_id long, version long, words int, run array<long>, start array<int>, again array<boolean>")
    kept = staged(kept.withColumn("row", F.monotonically_increasing_id()))
    each = kept.select("doc_id", "row", "words", F.explode(F.arrays_zip("run", "start", "again")).alias("x")).select("doc_id", "row", "words", "x.*")
    # all of one width, so that hashing adds them up; a text has a run once here, so its place is one
    firsts = each.where("not again").groupBy("run").agg(F.min("doc_id").alias("first"), F.min_by("row", "doc_id").alias("first_row"), F.min_by("words", "doc_id").alias("first_words"), F.min_by("start", "doc_id").alias("at"), F.count("*").alias("n")).where("n > 1")
    firsts = staged(firsts.select("run", "first", "first_row", "first_words", "at"))  # so that the join with a common run's rows can be split
    hits = each.select("run", "row", "start").join(firsts, "run").where("row <> first_row")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("first", "first_row", "first_words", "start", "at")).alias("hits"))
    hits = hits.join(kept.select("row", "doc_id", "version"), "row").withColumn("hits", F.filter("hits", lambda x: x["first"] < F.col("doc_id"))).where("size(hits) > 0")
    found = hits.dropDuplicates(["doc_id", "version"]).mapInArrow(partial(_blocks, min_words=min_words), f"doc_id long, version long, row long, blocks array<{_BLOCK}>")
    found = staged(found)

    # only blocks that may grow: however many holders a passage's parts have, it has two ends
    one = found.select("row", F.explode(F.filter("blocks", lambda b: b["left"] | b["right"])).alias("x")).select("row", "x.*")
    ahead = one.where("left").select("row", "first_row", F.col("at").alias("place"), F.lit(False).alias("behind"), F.col("start").alias("word"))
    behind = one.where("right").select("row", "first_row", (F.col("at") + F.col("end") - F.col("start")).alias("place"), F.lit(True).alias("behind"), F.col("end").alias("word"))
    wanted = staged(ahead.unionByName(behind))
    by = ["first_row", "place", "behind"]
    asked = wanted.select(*by).distinct().groupBy("first_row").agg(F.collect_list(F.struct("place", "behind")).alias("asked"))
    asked = asked.join(kept.select(F.col("row").alias("first_row"), F.col("doc_id").alias("_first"), F.col("version").alias("_version")), "first_row")
    asked = small_or_shuffled(staged(asked.select("first_row", "_first", "_version", "asked")), BROADCAST_BYTES, 48 + 16 * F.size("asked"))
    texts = keyed.join(asked, (F.col("doc_id") == F.col("_first")) & (F.col("version") == F.col("_version"))).select("first_row", "text", "asked")
    near = texts.mapInArrow(partial(_neighbours, reach=SPAN_WORDS), "first_row long, place int, behind boolean, near binary")
    near = staged(near.dropDuplicates(by))  # so that the join with a common block's rows can be split
    ends = wanted.join(near, by).groupBy("row").agg(F.collect_list(F.struct("word", "behind", "near")).alias("ends"))
    return staged(found.join(ends, "row", "left").select("doc_id", "version", "blocks", "ends"))


def grown(words: np.ndarray, ends: Iterable[tuple[int, bool, bytes]]) -> list[tuple[int, int]]:
    """Ranges by which blocks grow: as many words ahead of or behind the place as are those of the other text."""
    out = []
    for word, behind, near in ends:
        other = np.frombuffer(near, "<u4")
        mine = words[word : word + len(other)] if behind else words[max(0, word - len(other)) : word]
        n = min(len(mine), len(other))
        same = mine[:n] == other[:n] if behind else mine[::-1][:n] == other[::-1][:n]
        n = n if same.all() else int(np.argmin(same))
        if n:
            out.append((word, word + n) if behind else (word - n, word))
    return out


def _union(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def in_lines(ranges: Iterable[tuple[int, int]], words: list[int]) -> list[dict[str, int]]:
    """Word ranges, joined where they touch, as lines: the first, the one after the last, words cut, words that stay ahead in the first and at the end of the last."""
    before, out = [0, *accumulate(words)], []
    for s, e in _union(ranges):
        i, j = bisect_right(before, s) - 1, bisect_left(before, e)
        out.append({"start": i, "end": j, "words": e - s, "head": s - before[i], "tail": before[j] - e})
    return out


def without(text: str, cuts: list[tuple[int, ...]]) -> str:
    """The text less the lines in (start, end) ranges, or in (start, end, head, tail) but for so many words ahead and at the end; what is left of a line break's line is joined by spaces, and it goes if nothing is left."""
    gone: set[int] = set()
    parts: dict[int, list[tuple[int, int | None]]] = {}  # words cut of lines of which some stay
    for start, end, *stay in cuts:
        head, tail = stay or (0, 0)
        gone.update(range(start + (head > 0), end - (tail > 0)))
        if head:
            parts.setdefault(start, []).append((head, -tail if tail and end == start + 1 else None))
        if tail and (not head or end > start + 1):
            parts.setdefault(end - 1, []).append((0, -tail))
    out, line, lost = [], [], False
    for k, piece in enumerate([*_BREAK.split(text), "\n"]):
        if k % 2 == 0:
            at = k // 2
            lost |= at in gone or at in parts
            if at in parts:
                words = [(m.start(), m.end()) for m in _WORDS.finditer(piece)]
                drop = {w for a, b in parts[at] for w in range(*slice(a, b).indices(len(words)))}
                kept, last = [], None  # stretches of words that stay
                for w, (s, e) in enumerate(words):
                    if w in drop:
                        continue
                    if kept and last == w - 1:
                        kept[-1] = (kept[-1][0], e)
                    else:
                        kept.append((s, e))
                    last = w
                line.extend(piece[s:e] for s, e in kept)
            elif at not in gone:
                line.append(piece)
        elif piece == "\n":
            left = " ".join(line)
            if not lost or left.strip():
                out.append(left)
            line, lost = [], False
    return "\n".join(out)


def spared(blocks: list[dict], more: list[tuple[int, int]], n: int, similar: float, passage: int) -> list[tuple[int, int]]:
    """The word ranges to cut of a text of n words: all of them, unless what is left is that of a near copy. more: ranges by which blocks grow.

    A near copy shares at least `similar` of its SHINGLE-word shingles, and of its first holder's, with one earlier text, but for what
    others had first, and has nowhere `passage` words in a row of its own. It keeps what it shares with that text, so that near-duplicate
    detection meets it whole; else the words that differ would stay by themselves.
    """
    everything = _union([*((b["start"], b["end"]) for b in blocks), *more])
    cut = sum(e - s for s, e in everything)
    between = zip([0, *(e for _, e in everything)], [*(s for s, _ in everything), n], strict=True)
    if not similar or cut >= n or any(s - e >= passage for e, s in between):
        return everything
    own: dict[int, list[dict]] = {}
    for b in blocks:
        own.setdefault(b["first_row"], []).append(b)
    mate = max(own.values(), key=lambda held: (sum(e - s for s, e in _union((b["start"], b["end"]) for b in held)), -held[0]["first"]))
    touching = lambda held: _union([*(r := [(b["start"], b["end"]) for b in held]), *(m for m in more if any(m[0] <= e and m[1] >= s for s, e in r))])
    shared = touching(mate)
    n_shared = sum(e - s for s, e in shared)
    elsewhere, grams = cut - n_shared, sum(max(0, e - s - SHINGLE + 1) for s, e in shared)
    sides = n - elsewhere + max(mate[0]["first_words"] - elsewhere, n_shared) - 2 * (SHINGLE - 1)
    if not grams or grams < similar * (sides - grams):
        return everything
    return touching([b for b in blocks if b["first_row"] != mate[0]["first_row"]]) if len(own) > 1 else []


_COUNTS = ("n_cut_lines", "n_cut_words", "n_moved_words", "n_left_words")


_CUT = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in _COUNTS)])


def _cutter(similar: float, passage: int):
    """The deletion as a column function."""

    @F.pandas_udf(_CUT)
    def cut(texts: pd.Series, blocks: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for text, held, near in zip(texts, blocks, ends, strict=True):
            if text is None or held is None:
                rows.append((text, 0, 0, 0, None))
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            words = _small_hashes(word_hashes(raw, np.array([0, len(raw)]), "blank")[0])
            more = grown(words, ((x["word"], x["behind"], x["near"]) for x in (near if near is not None else ())))
            counts = [len(_WORDS.findall(x)) for x in _BREAK.split(text)[::2]]
            going = spared(list(held), more, sum(counts), similar, passage)
            moved = sum(min(e, b) - max(s, a) for s, e in _union((b["start"], b["end"]) for b in held if b["moved"]) for a, b in going if a < e and s < b)
            cuts = in_lines(going, counts)
            gone = sum(c["words"] for c in cuts)
            rows.append((without(text, [(c["start"], c["end"], c["head"], c["tail"]) for c in cuts]) if cuts else text, sum(c["end"] - c["start"] for c in cuts), gone, moved, sum(counts) - gone if cuts else None))
        return pd.DataFrame(rows, columns=["text", *_COUNTS]).astype({"text": object, "n_left_words": "Int64"})

    return cut


def line_dedup(docs: DataFrame, min_words: int = 30, broadcast_bytes: int = BROADCAST_BYTES, near_copies: float = 0.0) -> DataFrame:
    """docs (doc_id, text and any others) with `text` less the deleted lines and words, and n_cut_lines (each block's lines, those cut in part included), n_cut_words, n_moved_words (of these in blocks out of order), n_left_words (null if nothing went) and earlier, the documents that it was aligned with if anything went.

    Documents are in the order of doc_id; the first holder of a run keeps it. Lines (see above) are compared by their
    words, without regard to the case of A-Z or white space; deleted blocks have min_words words or more. Equal 64-bit
    hashes count as equal runs. near_copies, if not 0: texts that share so much with one earlier text, but not all, keep it (see spared).

    Null text stays null, an empty one empty. Rows with a null doc_id, and rows of one doc_id among each other, aren't
    compared; of the texts of a repeated doc_id the one with the smallest hash stands for it as the first holder of a run.
    Columns of docs named like ours are replaced. An empty table: no rows.
    """
    docs = small_batches(docs)
    own = [*_COUNTS, "earlier"]
    docs = docs.drop(*own)
    found = line_blocks(docs.select("doc_id", "text"), min_words)
    weight = 64 + 48 * F.size("blocks") + F.coalesce(F.aggregate("ends", F.lit(0), lambda n, x: n + 24 + F.octet_length(x["near"])), F.lit(0))
    found = small_or_shuffled(found, broadcast_bytes, weight)
    found = found.select(F.col("doc_id").alias("_cut_id"), F.col("version").alias("_cut_version"), F.col("blocks").alias("_blocks"), F.col("ends").alias("_ends"))
    held = docs.join(found, (docs["doc_id"] == F.col("_cut_id")) & (F.xxhash64(docs["text"]) == F.col("_cut_version")), "left")
    some = F.col("_blocks").isNotNull()
    held = held.withColumn("_cut", _cutter(near_copies, min_words)(F.when(some, F.col("text")), F.transform("_blocks", lambda b: F.struct(*(b[c].alias(c) for c in ("start", "end", "first", "first_row", "first_words", "moved")))), F.col("_ends")))
    earlier = F.array_sort(F.array_distinct(F.transform("_blocks", lambda b: b["first"])))
    number = lambda c: F.coalesce(F.col(f"_cut.{c}"), F.lit(0).cast("long"))
    out = held.withColumns({"text": F.when(some, F.col("_cut.text")).otherwise(F.col("text")), **{c: number(c) for c in own[:3]}, "n_left_words": F.when(some, F.col("_cut.n_left_words")), "earlier": F.coalesce(F.when(F.col("_cut.n_cut_words") > 0, earlier), F.array().cast("array<long>"))})
    return out.select(*docs.columns, *own)
