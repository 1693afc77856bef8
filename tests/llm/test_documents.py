"""The operators over documents: brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import string
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingmill.llm import common, line_dedup, minhash_dedup, packing, queries
from filingmill.llm.decontaminate import contamination
from filingmill.llm.licenses import license_scan
from filingmill.llm.minhash_dedup import near_duplicates
from filingmill.llm.packing import best_fit_packing
from filingmill.llm.quality import quality_scores
from filingmill.llm.secrets import secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS, BENCH = "doc_id long, quality int, toxic int", "item_id long, text string"


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)], DOCS)


def words(n, seed, size=2000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 1), (3, 1, 0), (None, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(words(20, 1))), (2, "only four words here"), (3, None), (None, "a null item of words"), (2, "only four words here")], BENCH)


def operators(labels, bench):
    return {
        "near": near_duplicates,
        "lines": line_dedup.line_dedup,
        "secrets": secret_scan,
        "licenses": license_scan,
        "contamination": lambda d: contamination(d, bench),
        "quality": lambda d: quality_scores(d, labels),
        "packing": lambda d: best_fit_packing(d, **queries.public_vocabulary()),
    }


ALL = ["near", "lines", "secrets", "licenses", "contamination", "quality", "packing"]


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, labels, bench, name):
    assert operators(labels, bench)[name](docs(spark).limit(0) if False else spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", ALL)
def test_odd_rows(spark, labels, bench, name):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(words(150_000, 5)) + " password = abcdefghij123456 " + "f" * 40
    rows = [(1, None, None, None, None), (None, "some text here", None, None, None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "a b c", "en", "s", 5), (4, "a b c", "en", "s", 5), (4, "other words", "fr", None, 1)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("version", "key", "row", "lines", "words", "n", "component_id", "kept", "accepted", "earlier", "part", "bin", "_id", "hash"):
        df = df.selectExpr("*", f"'x' as {c}")
    out = operators(labels, bench)[name](df)
    n = out.count()
    assert n == len(rows) if name != "packing" else n > len(rows)
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(None) == 2 and ids.count(4) == 3


# --- near-duplicates ---------------------------------------------------------------------------------------------------


def exact_groups(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_are_the_exact_ones(spark, n):
    r = random.Random(3)
    texts = []
    for g in range(6):
        base = words(r.randrange(60, 200), g)
        for _ in range(14):
            copy = list(base)
            for _ in range(r.randrange(0, 9)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, "one two", "ONE  two", "one two three", " ".join(words(50, 77)), "É é", "é é"]
    got = {x["doc_id"]: x for x in near_duplicates(docs(spark, *texts), n=n).collect()}
    want = exact_groups(texts, n, 80)
    assert [(got[k]["n_shingles"], got[k]["component_id"]) for k in range(len(texts))] == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got.values())


def test_crossing_links_of_a_crowded_bucket(spark):
    """A chain of copies, each linked with its neighbours only: the links that no bucket's first document has part in."""
    base = words(120, 9)
    texts = []
    for k in range(30):
        copy = list(base)
        for j in range(k * 2, k * 2 + 4):
            copy[(j * 5) % 120] = f"y{j}"
        texts.append(" ".join(copy))
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(docs(spark, *texts), n=4).collect()}
    assert [got[k] for k in range(30)] == [g for _, g in exact_groups(texts, 4, 80)]


def test_sketches_fill_and_agree_like_the_similarity():
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64))
    b = np.concatenate([a[:240], np.arange(60, dtype=np.uint64)])
    s = minhash_dedup.fill_bins([a, b, a[:3]], 512)
    assert (s != minhash_dedup._EMPTY).all()
    true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
    assert abs((s[0] == s[1]).mean() - true) < 0.1


def prefix_sets(spark, sets):
    rows = [(k, len(s), k, np.array(sorted(s), np.uint64).tobytes()) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, "node long, n long, root long, shingles binary")


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_the_prefix_filter_keeps_every_link(spark, percent):
    r = random.Random(percent)
    sets = []
    for _ in range(30):
        base = r.sample(range(1, 400), r.randrange(1, 40))
        sets += [set(base) - set(r.sample(base, min(len(base) - 1, r.randrange(4)))) | set(r.sample(range(1, 400), r.randrange(3))) for _ in range(4)]
    got = {(x["a"], x["b"]) for x in minhash_dedup.crossing_pairs(prefix_sets(spark, sets), percent).collect()}
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert links <= got and len(links) >= 5


def test_a_crowded_bucket_of_unlike_texts_gives_few_pairs(spark):
    """85 % of each set stands in all of them, and yet no two are alike."""
    common = set(range(1, 86))
    sets = [common | set(range(1000 + 15 * k, 1015 + 15 * k)) for k in range(2000)]
    assert minhash_dedup.crossing_pairs(prefix_sets(spark, sets), 80).count() <= 2000


def test_each_text_of_a_repeated_document_links_it(spark):
    a, b = words(200, 501), words(200, 502)
    near = lambda ws: " ".join([*ws[:-1], "other"])
    texts = [" ".join(a), " ".join(b), near(b), near(a), "", " ".join(words(50, 9))]
    rows = near_duplicates(docs(spark, *texts, ids=[1, 1, 2, 3, 1, 4])).collect()
    assert sorted((x["doc_id"], x["component_id"], x["kept"]) for x in rows) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]


# --- lines -------------------------------------------------------------------------------------------------------------


def plain_lines(text):
    """Each line's words, lower-cased in A-Z; blank lines left out."""
    lines, line = [], []
    for k, piece in enumerate(re.split(r"(\n|[.!?] )", text)):
        line.append(piece)
        if k % 2:
            lines.append("".join(line))
            line = []
    low = lambda w: "".join(c.lower() if c in string.ascii_uppercase else c for c in w)
    return [ws for x in [*lines, "".join(line)] if (ws := [low(w) for w in re.findall(r"[^ \t\n\v\f\r]+", x)])]


def shared_places(texts, d, min_words=30, span=50):
    """Of the words of texts[d] those that must go, as they stand in common runs with an earlier text (whole lines of min_words words, or any `span` words), and those that may (any run of min_words words)."""
    lines = plain_lines(texts[d])
    mine = [w for ws in lines for w in ws]
    must, may = set(), set()
    for a in range(d):
        other = plain_lines(texts[a])
        runs = {tuple(map(tuple, other[i:j])) for i in range(len(other)) for j in range(i + 1, len(other) + 1)}
        begin = [0]
        for ws in lines:
            begin.append(begin[-1] + len(ws))
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if begin[j] - begin[i] >= min_words and tuple(map(tuple, lines[i:j])) in runs:
                    must.update(range(begin[i], begin[j]))
        words_a = [w for ws in other for w in ws]
        for size, into in ((span, must), (min_words, may)):
            grams = {tuple(words_a[k : k + size]) for k in range(len(words_a) - size + 1)}
            for k in range(len(mine) - size + 1):
                if tuple(mine[k : k + size]) in grams:
                    into.update(range(k, k + size))
    return mine, must, may


def sentence(seed, n=9):
    return " ".join(words(n, seed)).capitalize() + "."


def check_cuts(spark, texts):
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(docs(spark, *texts)).collect()}
    for d, text in enumerate(texts):
        mine, must, may = shared_places(texts, d)
        left = [w for ws in plain_lines(got[d]["text"]) for w in ws]
        # what must go at the ends of passages within lines may stay up to 20 words; what is left is the rest, in order
        assert len(mine) - len(may) <= len(left) <= len(mine) - len(must), d
        assert got[d]["n_cut_words"] == len(mine) - len(left)
        it = iter(left)
        kept = next(it, None)
        for k, w in enumerate(mine):
            if w == kept and k not in must:
                kept = next(it, None)
            else:
                assert k in may, (d, k)
        assert kept is None
    return got


def test_lines_like_plain_search(spark):
    r = random.Random(8)
    pool = [" ".join(sentence(1000 * k + j) for j in range(8)) for k in range(5)]
    texts = []
    for d in range(60):
        parts = [sentence(10_000 + d * 10 + j) for j in range(6)]
        for p in r.sample(pool, r.randrange(0, 3)):
            parts.insert(r.randrange(len(parts) + 1), p)
        texts.append(r.choice(["\n", " "]).join(parts))
    got = check_cuts(spark, texts)
    for p in pool:  # each passage stands in one document
        assert sum(p in x["text"] for x in got.values()) == min(1, sum(p in t for t in texts))


def test_blocks_of_short_lines_in_any_order_like_plain_search(spark):
    r = random.Random(9)
    lines = [" ".join(words(r.choice([1, 2, 3, 5, 9, 14]), 700 + k, 10**6)) for k in range(40)]
    texts = []
    for d in range(40):
        parts = [" ".join(words(12, 30_000 + d * 10 + j, 10**6)) for j in range(3)]
        for _ in range(r.randrange(3)):
            a = r.randrange(34)
            block = lines[a : a + r.randrange(3, 14)]
            at = r.randrange(len(parts) + 1)
            parts[at:at] = r.choice([block, block[::-1], block + [""] + block])
        texts.append("\n".join(parts))
    check_cuts(spark, texts)


def test_passages_laid_out_otherwise_meet(spark):
    """The same words as running text, in verses, and in lines that end within sentences."""
    ws = [w + "." if k % 11 == 10 else w for k, w in enumerate(words(70, 41, 10**6))]
    long = words(70, 42, 10**6)
    w = lambda k: " ".join(words(9, 40_000 + k, 10**6))
    lay = lambda xs, n: "\n".join(" ".join(xs[k : k + n]) for k in range(0, len(xs), n))
    texts = [f"{w(9 * n + k)} {lay(xs, n)} {w(9 * n + 4 + k)}" for k, xs in enumerate((ws, long)) for n in (100, 7, 13, 2)]
    check_cuts(spark, texts)
    _, left = repeats_left(spark, texts)
    assert not left


def test_a_block_whose_lines_an_earlier_document_has_in_another_order(spark):
    block = [sentence(k) for k in range(6)]
    texts = ["\n".join(block[::-1]), "\n".join(block), "\n".join(["first own line", *block, "last own line"])]
    got = check_cuts(spark, texts)
    assert got[1]["text"] == texts[1] and got[2]["text"] == "first own line\nlast own line" and got[2]["earlier"] == [1]


def test_clean_documents_and_short_repeats_stay(spark):
    notice = "Released under the terms of a licence that everybody knows well."
    texts = [f"{sentence(k, 20)}\n{notice}\n{sentence(500 + k, 20)}" for k in range(20)]
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(docs(spark, *texts)).collect()}
    assert [got[k]["text"] for k in range(20)] == texts and not any(x["earlier"] for x in got.values())


def test_copies_lose_all_their_lines(spark):
    text = "\n".join(sentence(k) for k in range(10))
    got = {x["doc_id"]: x for x in line_dedup.line_dedup(docs(spark, text, text, "x\n\n" + text)).collect()}
    assert (got[0]["text"], got[1]["text"], got[1]["n_left_words"], got[1]["earlier"]) == (text, "", 0, [0])
    assert got[2]["text"].strip() == "x"


def repeats_left(spark, texts, size=50):
    """The cut texts, and which of them still hold `size` consecutive words that an earlier document had."""
    got = {x["doc_id"]: x["text"] for x in line_dedup.line_dedup(docs(spark, *texts)).collect()}
    grams = lambda t: {tuple(w[k : k + size]) for w in [t.split()] for k in range(len(w) - size + 1)}
    seen, left = set(), []
    for k, t in enumerate(texts):
        if grams(got[k]) & seen:
            left.append(k)
        seen |= grams(t)
    return [got[k] for k in range(len(texts))], left


@pytest.mark.parametrize("per_line", [1, 2, 3, 4])
@pytest.mark.parametrize("end", ["\n", "!! "])
def test_passages_in_short_lines_meet(spark, per_line, end):
    ws = words(60, 77)
    passage = end.join(" ".join(ws[k : k + per_line]) for k in range(0, 60, per_line)) + end
    texts = [f"{sentence(k, 20)}\n{passage}{sentence(500 + k, 20)}" for k in range(4)]
    got, left = repeats_left(spark, texts)
    assert not left and got[0] == texts[0] and all(ws[30] not in t.replace("!", "").split() for t in got[1:])


def test_swapped_and_further_passages_go(spark):
    p, q = ("\n".join(sentence(s + k) for k in range(6)) for s in (100, 200))
    own = [sentence(300 + k, 20) for k in range(9)]
    texts = ["\n".join([own[0], p, own[1], q, own[2]]), "\n".join([own[3], q, own[4], p, own[5]]), "\n".join([own[6], p, own[7], *[p] * 5, q, p, own[8]])]
    got, left = repeats_left(spark, texts)
    assert not left and got == [texts[0], "\n".join(own[3:6]), "\n".join(own[6:])]


def test_passages_inside_lines_go(spark):
    p = " ".join(words(80, 5))
    w = lambda k, n=15: " ".join(words(n, k, 10**9))
    texts = [f"{w(1)} {p} {w(2)}", f"{w(3)}: “{p.upper().replace('W', 'w')}”; {w(4)}.\n{w(5)}", f"{w(6)}. {w(7)} {p.replace(' ', '. ', 30).replace('.', '', 29)} {w(8)}; {p}", f"{p}\n{w(9)}"]
    got, left = repeats_left(spark, texts)
    first, last = p.split()[0], p.split()[-1]
    assert not left and got[0] == texts[0] and got[3] == w(9)
    assert got[1] == f"{w(3)}: “{first} {last}”; {w(4)}.\n{w(5)}" and got[2].startswith(f"{w(6)}. {w(7)} ") and got[2].endswith(f"{w(8)};")


@given(st.text(alphabet="ab .!\n", max_size=60), st.lists(st.tuples(st.integers(0, 12), st.integers(1, 6)), max_size=3))
@settings(max_examples=300, deadline=None)
def test_word_ranges_go_and_nothing_else(text, some):
    ws = text.split()
    ranges = [(s, min(s + n, len(ws))) for s, n in some if s < len(ws)]
    counts = [len(u.split()) for u in line_dedup._BREAK.split(text)[::2]]
    cuts = line_dedup.in_lines(ranges, counts)
    left = line_dedup.without(text, [(c["start"], c["end"], c["head"], c["tail"]) for c in cuts])
    assert left.split() == [w for k, w in enumerate(ws) if not any(s <= k < e for s, e in ranges)]
    assert sum(c["words"] for c in cuts) == len({k for s, e in ranges for k in range(s, e)})


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_winnowed_places_miss_no_window(values, window):
    """Every window holds a place with its least value, or one of the equal ones is near enough that runs of 30 words leave no gap."""
    hashes = np.array(values, np.uint64)
    places = line_dedup.winnowed(hashes, window).tolist()
    assert places == sorted(set(places))
    for k in range(max(1, len(values) - window + 1)):
        part = values[k : k + window]
        if part:
            near = [p for p in places if values[p] == min(part) and k - 10 <= p < k + window + 10]
            assert near


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 5)), max_size=12))
@settings(max_examples=200, deadline=None)
def test_patience_keeps_the_order(pairs):
    blocks = sorted((s, s + n, at) for at, (s, n) in enumerate(pairs))
    flags = line_dedup.patience(blocks)
    kept = [at for (_, _, at), ok in zip(blocks, flags, strict=True) if ok]
    assert kept == sorted(kept) and (kept or not blocks)


@given(st.text(alphabet="ab .!\n", max_size=60))
@settings(max_examples=200, deadline=None)
def test_without_cuts_nothing_changes(text):
    assert line_dedup.without(text, []) == text


@given(st.lists(st.text(alphabet="aé .!?\n\t", max_size=40), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_lines_are_split_alike(texts):
    (chunk,) = common.text_chunks(pa.array(texts))
    _, _, raw, offsets = chunk
    ws, first, _ = common.word_hashes(raw, offsets, "blank")
    starts = line_dedup.line_starts(raw, offsets, len(ws))[0].tolist()
    want, at = [], 0
    for t in texts:
        for u in line_dedup._BREAK.split(t)[::2]:
            if n := len(u.encode().split()):
                want.append(at)
                at += n
    assert starts == [*want, at] and at == len(ws)


# --- contamination -----------------------------------------------------------------------------------------------------


def test_contamination_by_brute_force(spark):
    r = random.Random(2)
    items = [(k, " ".join(words(r.choice([4, 12, 13, 20, 40]), 50 + k, 300))) for k in range(12)]
    texts = []
    for d in range(80):
        w = words(r.randrange(1, 150), 900 + d, 300)
        if d % 2:
            i = items[r.randrange(12)][1].split()
            a = r.randrange(max(1, len(i) - 12))
            w[r.randrange(len(w)) :][:0] = []
            at = r.randrange(len(w))
            w[at:at] = i[a : a + r.randrange(5, 30)]
        texts.append(" ".join(w).upper() if d % 3 else ", ".join(w))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower().decode())
    windows = {}
    for k, t in items:
        w = cut(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1):
            windows.setdefault(tuple(w[i : i + m]), set()).add(k)
    bench = spark.createDataFrame(items, BENCH)
    for kw in ({}, {"broadcast_rows": 0}):
        got = {x["doc_id"]: x for x in contamination(docs(spark, *texts), bench, **kw).collect()}
        for d, t in enumerate(texts):
            w, hit, found = cut(t), set(), set()
            for m in {len(x) for x in windows}:
                for i in range(len(w) - m + 1):
                    if tuple(w[i : i + m]) in windows:
                        hit |= set(range(i, i + m))
                        found |= windows[tuple(w[i : i + m])]
            digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            x = got[d]
            assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))


# --- packing -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_packing_is_whole_and_tight(spark, tokenizer):
    texts = [" ".join(words(n, n)) for n in (1, 5, 50, 300, 900, 2000)] * 8 + ["", None, "<|endoftext|> x", "日本語 текст́ ½"]
    rows = best_fit_packing(docs(spark, *texts), **queries.public_vocabulary(), partition_pieces=20).collect()
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append(x)
    for d, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[d], key=lambda x: x["piece"])
        assert [x["piece"] for x in pieces] == list(range(len(pieces))) and all(x["length"] == 1024 for x in pieces[1:])
        for x in pieces:
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
        assert sum(x["length"] for x in pieces) == len(ids) and len(pieces) == -(-len(ids) // 1024)
    for xs in by_sequence.values():
        at = 0
        for x in sorted(xs, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 1024
    least = packing.lower_bound(np.array([x["length"] for x in rows]), 1024)
    assert least <= len(by_sequence) <= least + 2


@given(st.lists(st.integers(1, 60), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_lower_bounds_hold(sizes):
    """No packing of a few items beats the bound, and best-fit decreasing is a packing."""

    def fits(n):
        def go(k, room):
            return k == len(order) or any(room[j] >= order[k] and go(k + 1, (*room[:j], room[j] - order[k], *room[j + 1 :])) for j in range(n))

        order = sorted(sizes, reverse=True)
        return go(0, (60,) * n)

    best = next(n for n in range(1, len(sizes) + 1) if fits(n))
    for pack in (packing.best_fit_decreasing, packing.best_fit_ahead):
        bins, offsets, filled = pack(np.array(sizes), 60)
        assert packing.lower_bound(np.array(sizes), 60) <= best <= len(filled)
        assert filled.max() <= 60 and filled.sum() == sum(sizes)
        for b in range(len(filled)):  # without holes, in some order
            here = sorted((int(offsets[i]), sizes[i]) for i in range(len(sizes)) if bins[i] == b)
            assert [at for at, _ in here] == [sum(n for _, n in here[:k]) for k in range(len(here))]


def test_both_tokenizer_libraries_agree(tokenizer):
    """Below PLAIN every character, alone and in company; and mixed texts beyond."""
    args = {k: v for k, v in queries.public_vocabulary().items() if k != "end_id"}
    r = random.Random(6)
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}9{chr(c)}\n" for c in range(packing.PLAIN)]
    texts += ["".join(chr(r.randrange(packing.PLAIN)) for _ in range(60)) for _ in range(300)]
    texts += ["x<|endoftext|>y", "  <|endoftext|>", "漢字 and 한글", "é", "🙂🙂 ok", "​　 "]
    for t in texts:
        assert packing.token_ids(t, **args).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("mark", [" ", "\n", "\t", "a", "7", "!", "é", " \n"])
def test_very_long_runs_have_the_tokenizers_ids(tokenizer, mark):
    v = queries.public_vocabulary()
    text = f"before {mark * (2_000_000 // len(mark))} after"
    assert packing.token_ids(text, v["tokenizer"], v["ranks"], v["pattern"]).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_repeated_and_null_documents_are_dealt_to_all_partitions(spark):
    rows = docs(spark, *(["one of many copies"] * 300), ids=[None if k % 2 else 7 for k in range(300)])
    packed = best_fit_packing(rows, **queries.public_vocabulary(), partition_pieces=30).collect()
    assert len(packed) == 300 and sum(r["doc_id"] is None for r in packed) == 150
    places = {(r["sequence_id"], r["offset"]) for r in packed}
    assert len(places) == 300 and len({r["sequence_id"] >> packing.BIN_BITS for r in packed}) > 5


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 2049])
def test_cuts(n):
    pieces = packing.cut(np.zeros(n), 1024)
    assert [a for a, _ in pieces[1:]] == [b for _, b in pieces[:-1]] and pieces[0][0] == 0 and pieces[-1][1] == n
    assert all(b - a == 1024 for a, b in pieces[1:]) and 1 <= pieces[0][1] <= 1024


# --- quality -----------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    r = random.Random(1)
    toxic = ["vile", "disgusting", "worthless", "idiot"]
    texts, marks = [], []
    for k in range(900):
        w, kind = words(r.randrange(30, 200), k, 400), k % 3
        if kind == 0:
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(toxic))
        if kind == 1:
            w = [x + r.choice(["###", "$$$", "***"]) for x in w]
        texts.append(" ".join(w))
        marks.append((k, int(kind != 1), int(kind == 0)))
    labels = spark.createDataFrame([m for m in marks if m[0] < 600], LABELS)
    got = {x["doc_id"]: x for x in quality_scores(docs(spark, *texts), labels).collect()}
    held = [(got[k]["accepted"], k % 3 == 2) for k in range(600, 900)]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(x["p_above_0"] >= x["p_above_1"] and abs(x["expected_grade"] - x["p_above_0"] - x["p_above_1"]) < 1e-5 for x in got.values())


def test_quality_without_labels_accepts_all(spark):
    got = quality_scores(docs(spark, "a", None), spark.createDataFrame([], LABELS)).collect()
    assert [x["accepted"] for x in got] == [True, True]


# --- secrets and licenses ----------------------------------------------------------------------------------------------


def test_owner_specific_tokens_are_added_and_copied_ones_not(spark):
    live, copied = "Zx81kLm02QpRs77TuVw45", "Aa11Bb22Cc33Dd44Ee55Ff"
    texts = [f"x {live} y", f"é {copied}", f"{copied} z", f"password = {copied}", "token: short PASSWORD: abcdefghijkl", "AKIA" + "Q7" * 7 + " " + "0a" * 8]
    got = {x["doc_id"]: x for x in secret_scan(docs(spark, *texts)).collect()}
    assert got[0]["spans"] == f"owner:2:{2 + len(live)}" and got[0]["n_owner"] == 1
    assert got[1]["spans"] == got[2]["spans"] == ""
    assert got[3]["spans"] == f"assign:0:{len(texts[3])}" and got[3]["n_copied"] == 1
    assert got[4]["spans"].startswith("assign:13:") and got[4]["n_assign"] == 1
    assert got[5]["spans"] == "access:0:18,hex:19:35"


def test_tokens_of_many_repositories_and_stand_ins_are_nobodys_own(spark):
    live = "Zx81kLm02QpRs77TuVw45"
    rows = [(k, f"x {live} {k}", "en", "s", 9) for k in range(50)] + [(50, "Zz9" * 9, "en", "s", 9), (51, "your-Key1xZ7qRk2LmP0wUv", "en", "s", 9)] + [(52, "Qk81zLm02WpRs77TbVw45", "en", "t", 9)]
    got = {x["doc_id"]: x for x in secret_scan(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[k]["spans"] == "" for k in range(52)) and got[52]["classes"] == "owned"
    few = secret_scan(spark.createDataFrame(rows[:10], DOCS)).collect()
    assert {x["n_owner"] for x in few} == {1}


def test_names_paths_and_encoded_files_are_no_secrets_but_random_keys_are(spark):
    r = random.Random(8)
    key = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    names = [
        "document.getElementsByClassName2", "AbstractHttp2ConnectionFactory", "Report2024Q3-Final-Draft-Version", "/usr/lib/python3/site-packages/X11Toolkit", "getXyzForAbcWithFoo1", "src/Main/Utf8StringEncoder/v2",
        "XMLHttpRequest2EventTarget", "iVBORw0KGgo" + key(400), "org/apache/Spark4/sql/Catalyst",
    ]
    keys = [k for k in (key(r.randrange(24, 60)) for _ in range(300)) if re.search("[0-9]", k) and re.search("[a-z]", k) and re.search("[A-Z]", k)]
    got = {x["doc_id"]: x for x in secret_scan(docs(spark, *(f"x {t} y" for t in [*names, *keys]))).collect()}
    assert [got[k]["n_owner"] for k in range(len(names))] == [0] * len(names)
    found = sum(got[k]["n_owner"] == 1 for k in range(len(names), len(names) + len(keys)))
    assert found >= 0.95 * len(keys), (found, len(keys))
    chance = "9f1234b7c05de8a3466b0ffe12d7c39a5be480d1"  # digits in a row by chance
    (row,) = secret_scan(docs(spark, f"commit {chance}")).collect()
    assert row["classes"] == "owned"


def test_spans_overlapping_a_base_span_are_left_out_of_crowded_texts(spark):
    token, base = "Zx81kLm02QpRs77TuVw45", "password=Zx81kLm02QpRs77TuVw46"
    text = f"{token} {base} " * 50_000
    start = time.time()
    (got,) = secret_scan(docs(spark, text)).collect()
    assert got["n_assign"] == 50_000 and got["n_owner"] == 50_000 and time.time() - start < 60
    assert got["spans"].startswith(f"owner:0:21,assign:22:{22 + len(base)},owner:")


def test_licenses_by_diagonals(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = ["Released under the MIT License.", "x " + notice, "x " + notice.replace("hereby granted", "hereby freely granted"), "CC BY-NC, cc by nc; Apache License, Version 2.0", "permission is hereby granted", "mit license under the"]
    got = {x["doc_id"]: x for x in license_scan(docs(spark, *texts)).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["base_labels"], got[0]["score"]) == (1, 1, "mit", 1.0)
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and got[1]["score"] == 1.0
    assert got[2]["labels"] == "mit" and 0.8 <= got[2]["score"] < 1
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"]) == (3, 0, 6, "apache-2,cc-by-nc")
    assert got[4]["labels"] == got[5]["labels"] == "" and got[5]["first_word"] is None


def test_whole_licence_bodies_with_edits_are_found(spark):
    from filingmill.llm.licenses import NOTICES

    r = random.Random(3)
    texts, want = [], []
    for label, body in NOTICES[-5:]:
        ws = body.split()
        for _ in range(3):
            edited = list(ws)
            for _ in range(len(ws) // 60):  # a word more, a word less, another word
                edited.insert(r.randrange(len(edited)), "inserted")
                del edited[r.randrange(len(edited))]
                edited[r.randrange(len(edited))] = "changed"
            texts.append(" ".join([*words(30, len(texts)), *edited, *words(30, 900 + len(texts))]))
            want.append(label)
    texts.append(" ".join(x for _, body in NOTICES[-5:] for x in body.split()[:9]))  # beginnings only
    got = {x["doc_id"]: x for x in license_scan(docs(spark, *texts)).collect()}
    assert all(label in got[k]["labels"].split(",") and got[k]["score"] >= 0.8 for k, label in enumerate(want))
    assert "isc" not in got[len(want)]["labels"]


def test_licences_of_one_family_are_told_apart(spark):
    from filingmill.llm.licenses import NOTICES

    texts, want = [], []
    for label, body in NOTICES:
        ws = re.findall("[A-Za-z0-9]+", body)
        texts.append(" ".join([*words(20, len(texts)), *ws, *words(20, 900 + len(texts))]))
        want.append((label, 20, 20 + len(ws)))
    lesser = next(body for label, body in NOTICES if label == "lgpl" and "Lesser" in body)
    texts.append(lesser.replace("Lesser", "Library"))  # a licence that no template names
    texts.append(lesser + " " + "and then. " * 5 + next(body for label, body in NOTICES if label == "gpl" and "General" in body))
    got = {x["doc_id"]: x for x in license_scan(docs(spark, *texts)).collect()}
    for k, (label, start, end) in enumerate(want):
        labels = set(got[k]["labels"].split(","))
        assert label in labels and all(x.split("-3")[0] == label.split("-3")[0] for x in labels), (want[k], labels)
        assert (start, end, label, 1.0) in {(x["start"], x["end"], x["label"], x["share"]) for x in got[k]["spans"]}
    assert got[len(want)]["labels"] == "" and got[len(want) + 1]["labels"] == "gpl,lgpl"


def test_words_hash_alike_however_texts_are_laid_out():
    texts = ["Aé b", "", None, "b aé", "x" * 1000]
    (_, _, raw, offsets), *_ = common.text_chunks(pa.array(texts))
    words_, first, length = common.word_hashes(raw, offsets, "blank")
    assert first.tolist() == [0, 2, 2, 2, 4, 5] and words_[0] == words_[3] and words_[1] == words_[2] and length[-1] == 1000
