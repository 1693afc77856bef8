"""Source divergence audit: how far apart the sources of a language are in the words that they use.

Documents are split into terms in Arrow; a task adds up the terms of a block of documents before anything is shuffled. The
rows (lang, term, source, document), document being the block's first, are dealt by language and term and sorted within
partitions, and a scan over the runs gives each term's document frequency, and its count by source. What is kept is sorted
once more with its probabilities, and a second scan emits, for each run, what its sources add to each pair's sum.

A pair's sum goes over all kept terms, most of which most sources lack. With p(a) for a source's probability of a term and
p0(a) for that of a term that it hasn't, it is V * |p0(a) - p0(b)|, plus |p(a) - p0(b)| - |p0(a) - p0(b)| for each term of a (from a
histogram of its probabilities), the same for b, plus a correction for each term that both have: only those come from runs.
All of it is whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, small_batches, small_or_shuffled, staged, text_chunks

#: Bytes of text that are split at once, and bytes whose terms are added up before they leave the task.
PIECE_BYTES, BLOCK_BYTES = 1 << 20, 16 << 20
#: Pairs of sources whose sums a task holds before it sends them on.
HELD_PAIRS = 500_000

_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_COUNTED = "lang string, term string, source string, document string, n_docs long, n long"
_KEPT = "lang string, term string, source string, n long, of_all long, first boolean"


def _grouped(table: pa.Table) -> pa.Table:
    """Rows of equal lang, term and source added up; the least document stands for them."""
    out = table.group_by(["lang", "term", "source"]).aggregate([("document", "min"), ("n_docs", "sum"), ("n", "sum")])
    return out.rename_columns([c.removesuffix("_min").removesuffix("_sum") for c in out.schema.names]).select(table.schema.names)


def _terms(batch: pa.RecordBatch, lo: int, raw: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """The terms of some texts laid end to end, by document."""
    at = np.flatnonzero(_LETTER[raw])
    begins = np.ones(len(at), bool)
    begins[1:] = np.diff(at) > 1
    begins |= np.isin(at, offsets[:-1])
    first = np.flatnonzero(begins)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(at)).astype(np.int64)), pa.py_buffer(_LOWER[raw[at]].tobytes()))
    words = words.dictionary_encode()
    row = np.searchsorted(offsets, at[first], side="right") - 1
    codes = words.indices.to_numpy().astype(np.int64)
    pairs, n = np.unique(codes * len(offsets) + row, return_counts=True)
    of = pa.array(lo + pairs % len(offsets))
    terms = words.dictionary.cast(pa.string()).take(pa.array(pairs // len(offsets)))
    return pa.table([batch["lang"].take(of), terms, batch["source"].take(of), batch["document"].take(of), pa.array(np.ones(len(n), np.int64)), pa.array(n.astype(np.int64))], ["lang", "term", "source", "document", "n_docs", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for lo, _, raw, offsets in text_chunks(batch["text"], PIECE_BYTES):
            held.append(_grouped(_terms(batch, lo, raw, offsets)))
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield from _grouped(pa.concat_tables(held)).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from _grouped(pa.concat_tables(held)).combine_chunks().to_batches()


def _starts(table: pa.Table, *names: str) -> np.ndarray:
    """Where a row differs from the one ahead in any of the columns; the first does."""
    out = np.ones(len(table), bool)
    for k, name in enumerate(names):
        codes = table[name].combine_chunks().dictionary_encode().indices
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).to_numpy()
        differs = codes[1:] != codes[:-1]
        out[1:] = differs if k == 0 else out[1:] | differs
    return out


def _runs(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by lang, term, source and document the kept terms: a row for each of their sources. The last run is held, a row for each source."""
    held = None

    def told(table: pa.Table, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        head = np.flatnonzero(run)
        if not len(head):
            return
        group, n = np.cumsum(run) - 1, table["n"].to_numpy()
        of_all = np.add.reduceat(n, head)[group]
        kept = (np.add.reduceat(table["n_docs"].to_numpy(), head) >= min_docs)[group]
        out = pa.table([table["lang"], table["term"], table["source"], pa.array(n), pa.array(of_all), pa.array(run)], ["lang", "term", "source", "n", "of_all", "first"])
        yield from out.filter(pa.array(kept)).combine_chunks().to_batches()

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch]).select(["lang", "term", "source", "n_docs", "n"])
        table = table if held is None else pa.concat_tables([held, table])
        head = np.flatnonzero(_starts(table, "lang", "term", "source"))
        sums = [pa.array(np.add.reduceat(table[c].to_numpy(), head)) for c in ("n_docs", "n")]
        table = table.take(pa.array(head)).set_column(3, "n_docs", sums[0]).set_column(4, "n", sums[1])
        run = _starts(table, "lang", "term")
        last = int(np.flatnonzero(run)[-1])
        yield from told(table.slice(0, last), run[:last])
        held = table.slice(last).combine_chunks()
    if held is not None:
        yield from told(held, np.arange(len(held)) == 0)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a term what each two of its sources add to their pair's sum beyond the terms that either has. Sums of pairs are held up to HELD_PAIRS."""
    names: dict[tuple[str, str], int] = {}
    sums: dict[tuple[int, int], int] = {}

    def add(codes: np.ndarray, p: np.ndarray, zero: np.ndarray, run: np.ndarray) -> None:
        head = np.flatnonzero(run)
        sizes = np.diff(np.append(head, len(run)))
        for m in np.unique(sizes[sizes > 1]).tolist():
            for lo in range(0, len(rows := head[sizes == m]), step := max(1, (1 << 19) // m)):
                at = rows[lo : lo + step, None] + np.arange(m)
                c, x, z = codes[at], p[at], zero[at]
                for j in range(1, m):  # each source with the one j places on
                    a, b = slice(0, m - j), slice(j, m)
                    v = np.abs(x[:, a] - x[:, b]) - np.abs(x[:, a] - z[:, b]) - np.abs(z[:, a] - x[:, b]) + np.abs(z[:, a] - z[:, b])
                    keys, inverse = np.unique((c[:, a] << 32) + c[:, b], return_inverse=True)
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, inverse.ravel(), v.ravel())
                    for key, value in zip(keys.tolist(), total.tolist(), strict=True):
                        sums[key >> 32, key & 0xFFFFFFFF] = sums.get((key >> 32, key & 0xFFFFFFFF), 0) + value

    def out() -> Iterator[pa.RecordBatch]:
        back = list(names)
        rows = [(back[a][0], back[a][1], back[b][1], v) for (a, b), v in sums.items()]
        sums.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 3 + [pa.int64()], strict=True)], ["lang", "source", "other", "value"])

    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        run = _starts(table, "lang", "term")
        last = int(np.flatnonzero(run)[-1])
        for part, own in ((table.slice(0, last), run[:last]),):
            if len(part):
                add(_source_codes(part, names), part["p"].to_numpy(), part["zero"].to_numpy(), own)
        if len(sums) > HELD_PAIRS:
            yield from out()
        held = table.slice(last).combine_chunks().to_batches()[0]
    if held is not None:
        part = pa.Table.from_batches([held])
        add(_source_codes(part, names), part["p"].to_numpy(), part["zero"].to_numpy(), np.arange(len(part)) == 0)
    yield from out()


def _source_codes(table: pa.Table, names: dict[tuple[str, str], int]) -> np.ndarray:
    """A number for each row's language and source, the same throughout the task."""
    lang, source = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    lang, source = ((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in (lang, source))
    both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    keys, inverse = np.unique(both, return_inverse=True)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    known = [names.setdefault((langs[k // len(sources)], sources[k % len(sources)]), len(names)) for k in keys.tolist()]
    return np.array(known, np.int64)[inverse.ravel()]


def _probability(n: Column | str, of: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 5) / (of + 5 * terms)), exactly; null without terms."""
    n = F.lit(n) if isinstance(n, int) else F.col(n)
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(n) + F.lit(5)) * F.lit(1_000_000_000)
    low = wide(F.col(of)) + wide(F.col(terms)) * F.lit(5)
    return F.when(F.col(terms) > 0, F.call_function("div", top, low) + F.lit(1).cast("long"))


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n, of_all, first) of the terms in at least min_docs documents of their language; first is true once for each term."""
    counted = docs.mapInArrow(_counted, _COUNTED)
    order = ["lang", "term", "source", "document"]
    return counted.repartition("lang", "term").sortWithinPartitions(*order).mapInArrow(lambda batches: _runs(batches, min_docs), _KEPT)


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """Compares the sources of each language by the terms that they use.

    docs: doc_id, lang, source, text. Terms are runs of letters and non-ASCII characters, of which only A-Z are lower-cased. A
    language keeps its terms that stand in at least min_docs of its documents. A group (lang, source), and a language as a whole, gives each
    kept term p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)): N is its count of all kept terms, V their number.

    Returns lang, source, part, item, value, rank. Part "pair": every other source of the language, with the sum of |p - q| over
    all kept terms (0 without any). Part "term": the kept terms that the group has and is likelier to use than the language, with
    p - q, the first `top`. Ranks go by value, descending, then item by its UTF-8 bytes.

    Null texts, languages and sources are empty strings. A row is a document, so repeated rows count each; doc_id, which may be null, only orders.
    A document without terms still makes its group, and a group alone in its language has no pairs. Texts are read whole, a
    piece at a time. Other columns, whatever their names, aren't read. No rows: no rows.
    """
    docs = only(small_batches(docs), "doc_id", "lang", "source", "text")
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")), F.col("doc_id").cast("string").alias("document"))
    kept = staged(kept_terms(docs, min_docs))

    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("v"))
    groups = docs.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0)
    groups = small_or_shuffled(staged(groups.withColumn("zero", _probability(0, "n_source", "v"))))

    found = kept.join(groups, ["lang", "source"]).withColumn("p", _probability("n", "n_source", "v"))
    q = _probability("of_all", "n_lang", "v")
    terms = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - q).alias("value")).where("value > 0")

    own = lambda name: groups.select("lang", F.col("source").alias(name), F.col("zero").alias(f"{name}_zero"), "v")
    gap = F.abs(F.col("a_zero") - F.col("b_zero"))
    sides = own("a").join(own("b").drop("v"), "lang").where("a <> b")
    base = sides.select("lang", "a", "b", F.coalesce(F.col("v") * gap, F.lit(0)).alias("value"))
    levels = found.groupBy("lang", F.col("source").alias("a"), "p", F.col("zero").alias("a_zero")).agg(F.count("*").alias("m"))
    alone = levels.join(own("b").drop("v"), "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (F.abs(F.col("p") - F.col("b_zero")) - gap)).alias("value"))
    runs = found.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = runs.mapInArrow(_pairs, "lang string, source string, other string, value long")
    both = staged(both.groupBy("lang", F.col("source").alias("a"), F.col("other").alias("b")).agg(F.sum("value").alias("value")))
    turned = lambda df: df.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    alone = staged(alone)
    pairs = base.unionByName(alone).unionByName(turned(alone)).unionByName(both).unionByName(turned(both))
    pairs = pairs.groupBy("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
