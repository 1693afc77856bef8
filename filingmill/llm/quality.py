"""Quality by ordinal cumulative-link regression on hashed words.

Grades 0 < 1 < 2 share one weight vector over hashed words; ordered thresholds cut its score: P(grade > k) =
sigmoid(score - theta_k). The model gives each document an expected grade and tail probabilities; selection goes by
those. It is fitted on a bounded sample of graded documents and scores every document of the corpus. Words and their
beginnings are hashed. Most say nothing of the grade, and long texts hold more of them, so only hashes whose presence
goes with lower grades beyond chance get a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gram_hashes, mix, only, small_batches, staged, text_chunks, word_beginnings, word_hashes

#: Graded documents to fit on, at most, and bytes of their texts; how many standard errors from no effect a hash must be to get a weight.
SAMPLE, SAMPLE_BYTES, SURE = 8000, 64 << 20, 3.5
#: Parts of the hashes that are counted one after another when the model is fitted.
PARTS = 16
#: Bytes of the word beginnings that are hashed besides whole words.
BEGINNINGS = (5, 6, 7, 8)
# letters in lower case and beyond ASCII, capitals, digits, blanks and usual punctuation, other signs
_KINDS = np.array([0 if 97 <= b <= 122 or b >= 128 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b < 33 or chr(b) in ".,;:?'\"()-" else 4 for b in range(256)], np.int64)
_SHAPES = 6


def grade(quality: Column, toxic: Column) -> Column:
    """0: toxic, 1: of low quality, 2: good. A missing mark counts as unmarked."""
    return F.when(F.coalesce(toxic, F.lit(0)) > 0, 0).when(F.coalesce(quality, F.lit(1)) > 0, 2).otherwise(1)


def text_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words of texts laid end to end, and of their beginnings."""
    words, first, length = word_hashes(raw, offsets, "alnum")
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, owners = [mix(words + np.uint64(1))], [text]
    for n, start in word_beginnings(raw, offsets, "alnum", BEGINNINGS):
        longer = length > n
        hashes.append(mix(start[longer] + np.uint64(n)))
        owners.append(text[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def shapes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: ten times its shares of capitals, digits and unusual signs, the share of words that repeat the one before, mean word length, and whether it has words."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(1, np.diff(offsets))
    shares = np.bincount(text * 5 + _KINDS[raw], minlength=5 * n).reshape(n, 5) / size[:, None]
    words, first, length = word_hashes(raw, offsets, "blank")
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n) / np.maximum(1, count)
    mean = np.bincount(owner, length, minlength=n) / np.maximum(1, count)
    return np.column_stack([10 * np.minimum(shares[:, [1, 2, 4]], 0.3), 3 * again, np.minimum(mean, 30) / 10, count > 0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def once_each(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of each text once."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def originals(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash that copies of a text share, near ones mostly too: the smallest of its 5-grams'."""
    words, first, _ = word_hashes(raw, offsets, "blank")
    grams = gram_hashes(words, 5)
    ends = np.maximum(first[:-1], first[1:] - 4)
    return np.array([grams[a:b].min() if b > a else mix(words[a:c].sum(keepdims=True))[0] for a, b, c in zip(first[:-1], ends, first[1:], strict=True)], np.uint64)


def telling(hashes: np.ndarray, text: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Of hashes that stand once for each text: those, sorted, whose presence goes with the lower side of some cut of the grades: the log odds ratio is SURE standard errors below nought."""
    order = np.argsort(hashes, kind="stable")
    hashes, text = hashes[order], text[order]
    start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(hashes)))
    chosen = np.zeros(len(start), bool)
    for k in range(int(grades.max(initial=0))) if len(start) else ():
        above = grades > k
        a = np.add.reduceat(above[text], start, dtype=np.int64) + 0.5
        b = count + 1 - a
        c, d = above.sum() + 1 - a, (~above).sum() + 1 - b
        chosen |= -np.log(a * d / (b * c)) > SURE * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return hashes[start][chosen]


def present(hashes: np.ndarray, text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among keys) of each key in each text once."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = keys[at] == hashes
    both = np.unique(text[hit].astype(np.int64) * len(keys) + at[hit])
    return both // len(keys), both % len(keys)


def fit(where: tuple[np.ndarray, np.ndarray], n_keys: int, forms: np.ndarray, grades: np.ndarray, grades_n: int = 3, steps: int = 400, rate: float = 0.3, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights of keys and shapes, thresholds) by full AdaGrad steps on the cumulative logistic loss; a grade weighs by the root of its share, so rare ones count, and without evidence the most common one is expected."""
    w, theta = np.zeros(n_keys + forms.shape[1]), np.arange(grades_n - 1) - (grades_n - 2) / 2
    g_w, g_t = np.full_like(w, 1e-8), np.full_like(theta, 1e-8)
    share = np.bincount(grades, minlength=grades_n) / max(1, len(grades))
    weight = 1 / np.sqrt(share[grades])
    weight /= weight.mean()
    above = (grades[:, None] > np.arange(grades_n - 1)[None, :]).astype(float)
    text, key = where
    for _ in range(steps):
        score = np.bincount(text, w[key], minlength=len(grades)) + forms @ w[n_keys:]
        err = (_sigmoid(score[:, None] - theta[None, :]) - above) * weight[:, None]
        row = err.sum(1) / len(grades)
        grad = np.concatenate([np.bincount(key, row[text], minlength=n_keys), forms.T @ row]) + decay * w
        g_w += grad**2
        w -= rate * grad / np.sqrt(g_w)
        down = -err.mean(0)
        g_t += down**2
        theta = np.maximum.accumulate(theta - rate * down / np.sqrt(g_t))
    return w, theta


def fitted(texts: pa.Array, grades: np.ndarray) -> bytes:
    """The model of graded texts: its thresholds, keys and weights."""
    # copies would count as evidence again and again: one text of each original and grade stays
    marks = np.concatenate([originals(raw, offsets) for _, _, raw, offsets in text_chunks(texts)])
    kept = np.sort(np.unique(np.column_stack([marks, grades.astype(np.uint64)]), axis=0, return_index=True)[1])
    texts, grades = texts.take(pa.array(kept)), grades[kept]
    chunks, forms = [], []
    for lo, _, raw, offsets in text_chunks(texts):
        h, t = once_each(*text_hashes(raw, offsets))
        chunks.append((h, (t + lo).astype(np.int32)))
        forms.append(shapes(raw, offsets))
    keys = []
    for part in range(PARTS):  # equal hashes are in one part, so counting by parts changes nothing
        here = [h >> np.uint64(32) & np.uint64(PARTS - 1) == part for h, _ in chunks]
        keys.append(telling(*(np.concatenate([chunk[i][sel] for chunk, sel in zip(chunks, here, strict=True)]) for i in (0, 1)), grades))
    keys = np.sort(np.concatenate(keys))
    where = [present(h, t, keys) for h, t in chunks]
    w, theta = fit(tuple(np.concatenate([pair[i] for pair in where]) for i in (0, 1)), len(keys), np.concatenate(forms), grades)
    return np.concatenate([theta.view(np.uint64), keys, w.view(np.uint64)]).tobytes()


def scored(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """P(grade > 0) and P(grade > 1) of each text."""
    n_keys = (len(model) - 2 - _SHAPES) // 2
    theta, keys, w = model[:2].view(np.float64), model[2 : 2 + n_keys], model[2 + n_keys :].view(np.float64)
    text, key = present(*text_hashes(raw, offsets), keys)
    score = np.bincount(text, w[key], minlength=len(offsets) - 1) + shapes(raw, offsets) @ w[n_keys:]
    return np.round(_sigmoid(score[:, None] - theta[None, :]), 6)


def _fit_group(table: pa.Table) -> pa.Table:
    table = table.select(["doc_id", "mark", "grade", "text"]).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    grades = table.column("grade").to_numpy().astype(np.int64)
    return pa.table({"model": pa.array([fitted(table.column("text").cast(pa.large_string()).combine_chunks(), grades)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray | None:
    """The model (see fitted); None without graded documents.

    The sample is the `sample` graded rows with the smallest hash of their doc_id, less those that would take their texts
    beyond `sample_bytes` (the first one always stays), so it is the same on every run.
    """
    graded = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    graded = graded.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).join(only(docs, "doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = F.broadcast(staged(graded.orderBy(*order).limit(sample)))
    texts = only(docs, "doc_id", "text").where("text is not null").withColumn("mark", F.xxhash64("text"))
    # a repeated doc_id may have many texts, and texts may be long: sample and sample_bytes hold for the rows, not only for the ids
    rows = texts.withColumn("size", F.octet_length("text")).drop("text").join(chosen, "doc_id").distinct().orderBy(*order, "mark").limit(sample)
    before = F.sum("size").over(Window.orderBy(*order, "mark").rowsBetween(Window.unboundedPreceding, -1))  # of `sample` rows at most
    bounded = staged(rows.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= sample_bytes)))
    rows = texts.join(F.broadcast(bounded.select("doc_id", "mark", "grade")), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    found = rows.groupBy(F.lit(0).alias("all")).applyInArrow(lambda table: _fit_group(table), "model binary").collect()
    return np.frombuffer(found[0]["model"], np.uint64) if found else None


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tails = [np.zeros((0, 2)), *(scored(raw, offsets, model.value) for _, _, raw, offsets in text_chunks(batch.column("text")))]
        tail = np.concatenate(tails)
        own = [c for c in batch.schema.names if c not in ("expected_grade", "p_above_0", "p_above_1")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(np.round(tail.sum(1), 6)), pa.array(tail[:, 0]), pa.array(tail[:, 1])], names=[*own, "expected_grade", "p_above_0", "p_above_1"])


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """docs (doc_id, text and any others) with expected_grade (0 to 2), p_above_0 = P(grade > 0), p_above_1 = P(grade > 1), and `accepted`: p_above_1 >= least.

    labels: (doc_id, quality, toxic); of repeated ones the worst marks count. Null and empty texts are scored by their
    shape alone and rejected only as that says; without any graded document every probability is 1, and all are accepted.
    Repeated rows are scored alike. Columns of docs named like ours are replaced. An empty table: no rows.
    """
    docs = small_batches(docs).drop("expected_grade", "p_above_0", "p_above_1", "accepted")
    model = train(docs, labels, sample)
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(2.0), "p_above_0": F.lit(1.0), "p_above_1": F.lit(1.0), "accepted": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("expected_grade", "p_above_0", "p_above_1"))])
    return docs.mapInArrow(lambda batches: _score(batches, shared), schema).withColumn("accepted", F.col("p_above_1") >= least)
