"""Substring dedup, source divergence and centroid clustering."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from filingmill.llm import centroids as cc
from filingmill.llm import divergence, oracles, suffix_dedup as sd


# --- substrings ------------------------------------------------------------------------------------------------------


def remains(rows, length=100):
    """By a set of all strings seen, one start at a time."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if (w := b[s : s + length]) in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc_id] = (len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone[:-1], strict=False)), hashlib.sha256(left).hexdigest())
    return out


def digests(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def some_texts(r, n):
    words = lambda k: " ".join(r.choice(["alpha", "beta", "gämma", "delta", "ε", "zeta", "eta"]) + str(r.randrange(40)) for _ in range(k))
    shared = [words(r.randrange(5, 80)) for _ in range(12)]
    return [(k, " ".join([words(r.randrange(30)), *(r.choice(shared)[r.randrange(30) :] for _ in range(r.randrange(4))), words(r.randrange(20))])) for k in range(n)]


ODD_TEXTS = [(200, "a" * 700), (201, "ab" * 300), (202, None), (203, ""), (204, "a" * 99), (205, "a" * 100), (207, "é" * 180), (None, "ab" * 120), (209, "é" * 60)]


def test_repeated_strings_go(spark):
    rows = some_texts(random.Random(3), 120) + ODD_TEXTS
    rows += [(206, rows[5][1]), (208, rows[6][1] * 3)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, place string, core int").repartition(5)
    assert digests(sd.suffix_dedup(df)) == remains(rows)


@pytest.mark.parametrize("length", [32, 40, 57])
def test_other_lengths(spark, length):
    rows = some_texts(random.Random(length), 50) + ODD_TEXTS
    assert digests(sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length)) == remains(rows, length)


def test_long_texts_go_piece_by_piece(spark, monkeypatch):
    r = random.Random(8)
    unit = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(1, unit + "x" * 3000), (2, "-" * 50 + unit[:400] + "+" * 30 + unit[350:]), (3, unit[200:500] * 4)]
    names = ["core", "whole", "doc_id", "version", "place", "low", "high"]
    assert names == sd._KEYS
    monkeypatch.setattr(sd, "PIECE_BYTES", 256)  # in this process: the ranges of windows are a partition of all windows
    batch = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in rows], "version": [0] * 3, "text": [t for _, t in rows]})
    for part in sd._first_rows(iter([batch]), 100, 32):
        assert all(a <= b for a, b in zip(part["low"].to_pylist(), part["high"].to_pylist(), strict=True))
    starts = Counter((d, s) for part in sd._first_rows(iter([batch]), 100, 32) for d, p, x, y in zip(*(part[c].to_pylist() for c in ("doc_id", "place", "low", "high")), strict=True) for s in range(p - y, p - x + 1))
    assert starts == Counter((k, s) for k, t in rows for s in range(len(t.encode()) - 99))
    assert digests(sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == remains(rows)


def test_equal_windows_have_equal_cores():
    r = np.random.default_rng(4)
    raw = r.integers(97, 99, 4000, dtype=np.uint8)  # many ties
    raw[1000:1600] = raw[200:800]
    rank, whole, place, low, high = sd.window_ranges(raw, np.array([0, 900, 950, 4000]), 100, 32)
    seen = {}
    for k, x, y, p in zip(rank.tolist(), low.tolist(), high.tolist(), place.tolist(), strict=True):
        for offset in range(x, y + 1):
            assert seen.setdefault(bytes(raw[p - offset : p - offset + 100]), (k, offset)) == (k, offset)
    assert (high - low + 1).sum() == 801 + 2951


def test_one_id_for_several_texts(spark):
    r = random.Random(1)
    text = "".join(r.choice("abcdefgh ") for _ in range(400))
    df = spark.createDataFrame([(1, text), (1, text), (1, "zz" + text), (2, "b"), (2, text), (None, text[:150])], "doc_id long, text string")
    rows = [(x["doc_id"], x["n_bytes"], x["n_removed"]) for x in sd.suffix_dedup(df).collect()]
    assert (None, 150, 0) in rows and (2, 400, 400) in rows and (2, 1, 0) in rows
    ones = sorted(x for x in rows if x[0] == 1)
    assert ones in ([(1, 400, 150), (1, 400, 150), (1, 402, 400)], [(1, 400, 400), (1, 400, 400), (1, 402, 150)])


def test_spans_and_what_is_kept(spark):
    text = "".join(chr(97 + (k * k) % 23) + str(k) for k in range(200))
    rows = {x["doc_id"]: x for x in sd.suffix_dedup(spark.createDataFrame([(1, text), (2, "<<" + text[:200] + ">>" + text[300:])], "doc_id long, text string")).collect()}
    assert rows[1]["spans"] is None and rows[1]["kept"] == text.encode()
    assert [(s["start"], s["end"]) for s in rows[2]["spans"]] == [(2, 202), (204, 204 + len(text) - 300)] and rows[2]["kept"] == b"<<>>"


def test_no_texts(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert digests(sd.suffix_dedup(spark.createDataFrame([(1, None)], "doc_id long, text string"))) == {1: (0, 0, 0, hashlib.sha256(b"").hexdigest())}


# --- sources ---------------------------------------------------------------------------------------------------------

FIELDS = "doc_id long, lang string, source string, text string"


def divergences(rows, min_docs, top):
    """The definition, term by term."""
    import re

    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))) for _, lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        held = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2]) for s in {r[1] for r in own}}

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        of = {s: p(c) for s, c in counts.items()}
        q = p(sum(counts.values(), Counter()))
        for s in of:
            pairs = sorted(((-sum(abs(of[s][t] - of[o][t]) for t in kept), o.encode()) for o in of if o != s))
            terms = sorted((-(of[s][t] - q[t]), t.encode()) for t in kept if counts[s][t] and of[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


def compared(df, **kw):
    return sorted(tuple(r) for r in divergence.source_divergence(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_as_defined(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "γάμμα", "Ääkkönen", "delta_x", "e2e", "zeta", "Ωmega", "iota", "kappa"]
    rows = [(k, r.choice(["en", "de", None, ""]), r.choice(["a", "b", "ß", None]), " ".join(r.choice(words[: r.randrange(1, 11)]) for _ in range(r.randrange(40)))) for k in range(150)]
    rows += [(900, "en", "quiet", "12 34 ?"), (901, "xx", "alone", "zeta " * 40), (902, "yy", "one", None), (903, "yy", "two", ""), (5, "en", "a", "beta " * 30), (5, "en", "a", "beta " * 30), (None, None, None, None)]
    df = spark.createDataFrame([(*x, 7) for x in rows], FIELDS + ", term int").repartition(4)
    assert compared(df, min_docs=6, top=3) == divergences(rows, 6, 3)
    assert compared(df.limit(0)) == []


def test_divergence_agrees_with_sql(spark):
    con = duckdb.connect()
    at = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}'")
    r = con.sql(oracles.DIVERGENCE)
    order = [r.columns.index(c) for c in ("lang", "source", "part", "item", "value", "rank")]
    assert compared(spark.read.parquet(at)) == sorted(tuple(x[k] for k in order) for x in r.fetchall())


def test_runs_are_the_same_in_batches_of_any_size():
    r = random.Random(2)
    rows = sorted((r.choice("xy"), r.choice("abcdef"), r.choice("pqrs"), str(k), r.randrange(1, 4), r.randrange(1, 9)) for k in range(300))
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "term", "source", "document", "n_docs", "n"])
    whole = [x for b in divergence._runs(iter(table.to_batches()), 40) for x in b.to_pylist()]
    for size in (1, 2, 7, 50):
        assert [x for b in divergence._runs(iter(table.to_batches(size)), 40) for x in b.to_pylist()] == whole
    assert sum(x["first"] for x in whole) == len({(x["lang"], x["term"]) for x in whole}) and whole


def test_sums_of_pairs_are_sent_on(monkeypatch):
    r = random.Random(2)
    rows = [("x", f"t{k:03}", s, r.randrange(1, 99), ord(s)) for k in range(60) for s in "abcde" if r.random() < 0.7]
    table = pa.table([pa.array(c) for c in zip(*rows, strict=True)], ["lang", "term", "source", "p", "zero"])
    total = lambda: Counter({k: v for k, v in sum((Counter({(x["source"], x["other"]): x["value"] + 10**6}) for b in divergence._pairs(iter(table.to_batches(9))) for x in b.to_pylist()), Counter()).items()})
    sums = lambda c: {k: v % 10**6 for k, v in c.items()}
    one = sums(total())
    monkeypatch.setattr(divergence, "HELD_PAIRS", 3)
    assert sums(total()) == one and len(one) == 10


# --- centroids -------------------------------------------------------------------------------------------------------


def clusters(rows, dims=64, k=8, rounds=10):
    """Plain rounds in Python's numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [min(range(len(cs)), key=lambda c: (far(v, cs[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = near()
        cs = [[sum(z) // len(own) for z in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == c]) else old for c, old in enumerate(cs)]
    at = near()
    d = [far(v, cs[c]) for (_, v), c in zip(kept, at, strict=True)]
    by = {c: sum(x for x, a in zip(d, at, strict=True) if a == c) for c in at}
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, fits(x), fits(by[c]), fits(sum(d)), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for (i, _), c, x in zip(kept, at, d, strict=True)), key=str)


@pytest.mark.parametrize("large", [1.0, 1e3, 1e15, 1e200])
def test_clusters_as_by_plain_rounds(spark, large):
    r = np.random.default_rng(1)
    rows = [(int(k) % 50 if k % 9 else None, [float(x) * (large if k % 4 == 0 else 1) for x in r.integers(-3, 4, 4)]) for k in range(120)]  # ties, repeated ids, far vectors
    rows += [(999, None), (998, [1.0, 2.0, None, 3.0]), (997, [1.0, 2.0, math.nan, 3.0]), (996, [1.0]), (995, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    assert sorted((tuple(x) for x in cc.centroid_clusters(df, dims=4).collect()), key=str) == clusters(rows, 4)


def test_few_vectors_and_none(spark):
    rows = [(k, [float(k)] * 4) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(x) for x in cc.centroid_clusters(df, dims=4).collect()), key=str) == clusters(rows, 4)
    none = cc.centroid_clusters(df.limit(0), dims=4)
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_bounds_spare_scans_and_change_nothing():
    r = np.random.default_rng(7)
    v = np.floor(r.normal(0, 900, (2000, 16)) + 6000 * r.integers(0, 5, (2000, 1)))
    rows = [[int(x) for x in row] for row in v[:5]]
    c, cluster, upper, lower = cc.Centroids(rows), np.full(2000, -1), np.zeros(2000), np.zeros(2000)
    scans = []
    for _ in range(8):
        scans.append(cc.assign(v, c, cluster, upper, lower))
        assert (cluster == np.argmin(c.squared(v), axis=1)).all()
        moved = cc.Centroids([[int(x) for x in np.floor(v[cluster == k].mean(axis=0))] if (cluster == k).any() else c.rows[k] for k in range(5)])
        drift = c.drifts(moved)
        upper, lower, c = upper + drift[cluster], lower - drift.max(), moved
    assert scans[0] == 2000 and scans[-1] < 600


def test_sums_of_any_size():
    for total in ([0, 5, -7], [1 << 90, -(1 << 41), 3], [-(1 << 200) - 1, 0, 0]):
        back = [0, 0, 0]
        for limb, part in cc._limbs(total):
            assert all(abs(x) < 1 << cc.LIMB for x in part)
            back = [b + (x << (cc.LIMB * limb)) for b, x in zip(back, part, strict=True)]
        assert back == total
