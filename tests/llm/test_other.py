"""Pages, vectors and conversations; the pipeline."""

from __future__ import annotations

import hashlib
import json
import random
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filingmill.llm import chat, html_text, oracles, queries, topk
from filingmill.llm.native import running_totals, with_spans

PAGES = "page_id long, url string, html string"


def texts(spark, *pages, url="http://a.example.com/x"):
    rows = [(k, url, p) for k, p in enumerate(pages)]
    return [x["text"] for x in html_text.main_texts(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


BODY = "<h1>Title &amp; more</h1><p>First <b>pa</b>rt,<br>second&nbsp; line.</p><p>Next.</p>"
MAIN = "Title & more First part, second line. Next."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>x</a></nav><article>{BODY}</article><footer>&copy; x</footer></body></html>",
        f"<body><header><h2>Site</h2></header><main><div class='cookie-notice'>We use cookies</div><article class='post'>{BODY}<div class='comments'><p>Nice!</p></div></article></main><aside>more</aside>",
        f"<body class='has-sidebar'><div id=page><div class='sidebar'><p>{'long side text ' * 50}</p></div><div class='main-content'>{BODY}<form><p>mail</p><input></form></div></div>",
        f"<body><div class=menu><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div><section class=content>{BODY}<ul class='related-posts'><li>r</ul></section><div id='footer'>f</div>",
        f"<body><article>{BODY}</article><section id=comments><article class='comment'><p>{'I think so. ' * 80}</p></article></section>",
        f"<body><div class='ad'>Buy</div><script>var x='</p><p>no';</script><!-- <p>no</p> --><article>{BODY}</article><div class=advert><p>{'buy now ' * 100}</p></div>",
        f"<BODY><ARTICLE>{BODY}<p hidden>no</p><button>no</button><noscript>no</noscript></ARTICLE></BODY>",
        f"<body><article>{BODY.replace('</p>', '')}<a hre",
        f"<body><div id=navBar>x</div><div role='navigation'>y</div><div class='wrap'><div class='sideBar'>{'z ' * 200}</div><div class='pageContent'>{BODY}<div id=userComments>c</div></div></div><div id='cookie-banner'>k</div>",
    ],
)
def test_main_text(spark, page):
    assert texts(spark, page) == [MAIN]


def test_an_article_in_containers_side_by_side_is_whole(spark):
    lead, rest = "lead text " * 60, "other text " * 36
    assert texts(spark, f"<body><div class=lead><p>{lead}</p></div><div class=rest><p>{rest}</p></div><div class=tiny>x</div></body>") == [f"{lead}{rest}".strip()]
    table = f"<body><p>{rest}</p><table><tr><td>{lead}</td></tr></table><p>{rest}</p></body>"
    assert texts(spark, table) == [f"{rest}{lead}{rest}".strip()]


def test_parts_beside_the_winner_are_read_whatever_their_size(spark):
    intro, rest, links = "Intro words here. " * 8, "Body of text. " * 60, "link words " * 30
    page = f"<body><div class=page><div class=intro><p>{intro}</p></div><div class=text><p>{rest}</p></div><div class=k9><a href=x>{links}</a></div></div></body>"
    assert texts(spark, page) == [f"{intro}{rest}".strip()]
    parts = ["One sentence. " * 20, "Two. " * 3, "Three. " * 2]
    page = "<body><main>" + "".join(f"<section class={c}><p>{t}</p></section>" for c, t in zip("abc", parts, strict=True)) + "</main></body>"
    assert texts(spark, page) == ["".join(parts).strip()]


@pytest.mark.parametrize("name", ["comment-content", "sidebar-content", "footer-main", "comments-area", "commentlist", "commentList", "comment-section", "related-content"])
def test_names_of_what_is_no_main_text(spark, name):
    long, article = "More and more of it. " * 90, "The article itself. " * 20
    assert texts(spark, f"<body><div class=post><p>{article}</p></div><div class='{name}'><p>{long}</p></div></body>") == [article.strip()]
    assert texts(spark, f"<body><article><p>{article}</p><div class='{name}'><p>{long}</p></div></article></body>") == [article.strip()]


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "page-with-sidebar", "layout-sidebar-right"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrappers_named_after_a_sidebar_are_read(spark, name, tag):
    page = f"<body><div class='{name}'><div class=sidebar><p>{'side ' * 40}</p></div><{tag}>{BODY}</{tag}></div><div class='related-posts'><article>more</article></div></body>"
    assert texts(spark, page) == [MAIN]


NAMES = ["elementor-widget-container", "search-results", "form-page", "widget-content", "share-content", "header-inner", "social-studies", "content login-required", "entry-content related", "article-alert", "sidebar", "comments"]


@pytest.mark.parametrize("name", NAMES)
def test_a_name_alone_deletes_no_text(spark, name):
    """Whatever the container of a page's whole text is called, the text is found; menus and footers round it aren't."""
    page = f"<body><nav><a href=/>Home</a></nav><div class='{name}'>{BODY}</div><footer>f</footer></body>"
    assert texts(spark, page) == [MAIN]
    assert texts(spark, f"<body><form id=aspnetForm><div class='{name}'><div>{BODY}</div></div></form></body>") == [MAIN]


def test_quotes_count_at_the_start_of_a_value_only(spark):
    pages = ["<div><p data-x=it's>Hello it is me</p><p>it's second</p></div>", "<div><p title='a > b' x=\"c>d\" = y>one</p><p a=\"never closed>two</p></div>"]
    assert texts(spark, *pages) == ["Hello it is me it's second", "one two"]


@pytest.mark.parametrize("page", ["<div>" * 16_000 + "deep" + "</p>" * 16_000, "<svg>" * 16_000 + "deep", "<div class='a b'>x" * 16_000])
def test_deep_and_unbalanced_pages_take_linear_time(page):
    start = time.time()
    html_text.Page(page).votes()
    assert time.time() - start < 2


class Walk(HTMLParser):
    """All text of well-formed pages by the standard library's reader, a list of blocks."""

    def __init__(self):
        super().__init__()
        self.out, self.part = [], []

    def end(self):
        if text := " ".join("".join(self.part).split()):
            self.out.append(text)
        self.part = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.part.append(" ")
        elif tag in ("div", "p", "ul", "li", "h2", "section", "blockquote"):
            self.end()

    def handle_endtag(self, tag):
        if tag != "br":
            self.handle_starttag(tag, [])

    def handle_data(self, data):
        self.part.append(data)


def random_part(r, depth, word):
    """Random well-formed markup of text."""
    if depth == 0 or r.random() < 0.3:
        return " ".join(r.choice([word, word.upper(), "&amp;", "&eacute;t&#233;", f"<b>{word}</b>{word}", f"<i class='ad x'>{word}</i>", "<br>", "\n  "]) if "ad" not in word else word for _ in range(r.randrange(1, 9)))
    tag = r.choice(["p", "div", "div class='k1 z'", "section id=s3", "h2", "ul", "blockquote", "span"])
    inner = "".join(random_part(r, depth - 1, word) for _ in range(r.randrange(1, 4)))
    inner = f"<li>{inner}</li>" if tag == "ul" else inner
    return f"<{tag}>{inner}</{tag.split()[0]}>"


def test_blocks_like_the_standard_librarys_reader():
    r = random.Random(5)
    for k in range(300):
        page = "".join(random_part(r, 4, f"w{k}") for _ in range(3)).replace(" class='ad x'", "")
        page = re.sub(r"<p>(.*?)</p>", lambda m: f"<p>{re.sub(r'</?(?:p|div|ul|li|h2|section|blockquote)[^>]*>', ' ', m[1])}</p>", page, flags=re.S)
        walk = Walk()
        walk.feed(page)
        walk.close()
        walk.end()
        assert " ".join(html_text.Page(page).texts).split() == " ".join(walk.out).split()


def test_random_pages_give_their_article_and_nothing_else(spark):
    """By construction: an article of random markup among parts of other kinds, which also stand in it."""
    r = random.Random(6)
    pages, want = [], []
    noise = ["<nav>{}</nav>", "<div class='site-sidebar'>{}</div>", "<aside>{}</aside>", "<div id=comments><p>{}</p></div>", "<form>{}</form>", "<div class='ad'>{}</div>", "<footer>{}</footer>", "<ul class='related-posts'><li>{}</li></ul>", "<script>{}</script>", "<div class=cookie-notice>{}</div>"]
    for k in range(60):
        parts = [" ".join(f"text{k}" for _ in range(r.randrange(5, 40))) for _ in range(r.randrange(3, 7))]
        inside = [f"<p>{x}</p>" for x in parts]
        for _ in range(r.randrange(3)):
            inside.insert(r.randrange(len(inside) + 1), r.choice(noise).format("noise " * r.randrange(1, 30)))
        around = [r.choice(noise).format("noise " * r.randrange(1, 60)) for _ in range(4)]
        shell = r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class='post-content'>{}</div>", "<div class='row'><div class='col'>{}</div></div>"])
        pages.append("<html><head><title>t</title><body>" + "".join(around[:2]) + shell.format("".join(inside)) + "".join(around[2:]) + "</body></html>")
        want.append(" ".join(parts))
    rows = [(k, f"http://h{k}.example.com/", p) for k, p in enumerate(pages)]
    got = [x["text"] for x in html_text.main_texts(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]
    assert got == want


def test_a_hosts_pages_vote(spark):
    """One page's side text is longer than its article; the host's other pages outvote it."""
    page = lambda side, body: f"<body><div class=alpha7><p>{side}</p></div><div class=beta{len(body)}><p>{body}</p></div></body>"
    pages = [page("side", f"body {k} " * 40) for k in range(5)] + [page("side " * 30, "short body")]
    got = texts(spark, *pages)
    assert got[5] == "short body" and got[0] == ("body 0 " * 40).strip()


def test_pages_with_nothing(spark):
    assert texts(spark, "", None, "<p>no container", "a < b &lt; c &#233; &am", "<body></body>", "<") == ["", "", "no container", "a < b < c é &am", "", "<"]


def test_odd_pages(spark):
    rows = [(None, None, None), (1, None, "<body>x</body>"), (1, None, "<body>x</body>"), (2, "no host", "<body>" + "<div>" * 3000 + "deep" + "</div>" * 10), (3, "http://h/", "<p>" + "long " * 300_000)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'z' as host", "'z' as text", "1 as paths", "2 as _host")
    got = html_text.main_texts(df).collect()
    assert sorted((x["page_id"] or 0, x["n_chars"]) for x in got) == [(0, 0), (1, 1), (1, 1), (2, 4), (3, 300_000 * 5 - 1)]
    assert html_text.main_texts(spark.createDataFrame([], PAGES)).count() == 0
    plain = html_text.main_texts(df, broadcast_paths=0).collect()
    assert sorted(x["text"] for x in plain) == sorted(x["text"] for x in got)


# --- vectors -----------------------------------------------------------------------------------------------------------


def brute(ids, v, k=5, every=50):
    out = []
    for i in range(len(ids)):
        if ids[i] % every == 0:
            scores = [(-sum(int(a) * int(b) for a, b in zip(v[i], v[j], strict=True)), ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
            out += [(ids[i], r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("dim,spread", [(2, 1), (8, 30), (32, 3)])
def test_topk_is_exact(spark, dim, spread):
    r = np.random.default_rng(dim)
    x = r.normal(size=(700, dim)) * r.choice([0.0, 0.1, 1.0, spread], 700)[:, None]
    x[100:140] = x[50]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top_products(df, block=100, query_block=4)
    v = np.floor(256 * x).astype(np.int64)
    assert sorted(tuple(row) for row in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(list(range(700)), v.tolist())


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (6, []), (None, [1.0, 1.0]), (7, [1e6, 1e6]), (8, [1.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as v", "'x' as query", "0 as qb")
    got = sorted(tuple(x) for x in topk.top_products(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(0, 1, 7, 256 * 256 * 10**6 * 3), (0, 2, 5, 256 * 128 * 3), (0, 3, 5, 256 * 128 * 3)]
    assert topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_norm_buckets_are_exact(spark, spread):
    """Many buckets of unlike lengths, queries that reach the first only and queries that reach all, and components that no double's fraction fits."""
    r = np.random.default_rng(7)
    x = r.normal(size=(600, 6)) * np.exp(r.normal(size=600) * spread)[:, None]
    x[50] = 0
    x[60:64] = np.floor(r.normal(size=(4, 6)) * 2**21) * 2.0**24
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").where("vec_id not in (100, 150)")
    ids = [k for k in range(600) if k not in (100, 150)]
    v = [[int(np.floor(256 * c)) for c in x[k]] for k in ids]
    want = [w for w in brute(ids, v)]
    if max(abs(w[3]) for w in want) >= 1 << 63:
        with pytest.raises(Exception, match="larger than a long"):
            topk.top_products(df, block=40, query_block=4).collect()
        x[60:64] /= 2.0**20
        df = spark.createDataFrame([(k, x[k].tolist()) for k in ids], "vec_id long, embedding array<double>")
        v = [[int(np.floor(256 * c)) for c in x[k]] for k in ids]
        want = brute(ids, v)
    got = topk.top_products(df, block=40, query_block=4)
    assert sorted(tuple(row) for row in got.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_large_products_stay_whole():
    v = np.array([[2**40, 3], [2**40 + 1, 5], [7, 2**41]], np.int64)
    got = topk.search_block(np.array([9]), v[:1], np.array([1, 2, 3]), v, 3)
    assert [s for _, _, s in got] == sorted((sum(int(a) * int(b) for a, b in zip(v[0], w, strict=True)) for w in v), reverse=True)


# --- conversations -----------------------------------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "\\\\b", "</turn>\n", '<turn role="assistant">\nx</turn>\n', "\\l \\h \\q #<\"", "é\n\n", "x" * 100_000]
    rows = [(k, j, ("user", "assistant", 'odd"<role', None)[j % 4], t) for k in range(3) for j, t in enumerate(nasty)] + [(None, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a")]
    df = spark.createDataFrame(rows, CONV)
    for c in ("record", "formatted", "loss", "turns", "x", "content"):
        df = df.selectExpr("*", f"1 as {c}")
    got = {x["conv_id"]: x for x in chat.chat_digests(df).collect()}
    assert len(got) == 5 and got[5]["n_turns"] == 2 and got[None]["n_turns"] == 1
    mine = [(r or "", t or "") for _, _, r, t in rows[:9]]
    loss = "".join(t for r, t in mine if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k in range(3):
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (9, sha("".join(f"{r}\n{t}\n" for r, t in mine)), len(loss), sha(loss))
    assert chat.chat_digests(spark.createDataFrame([], CONV)).count() == 0


def test_layouts_by_fingerprint(spark):
    want = [("user", "a"), ("assistant", "b")]
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"turns": [{"text": "a", "role": "user"}, {"text": "b", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, {"instruction": "a", "output": "b"}, {"instruction": "a", "input": "", "output": "b"}, {"prompt": "a", "completion": "b"},
        {"prompt": "a", "response": "b"}, {"question": "a", "answer": "b"},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(100, "{"), (101, None), (102, '{"other": 1}')], "k long, j string")
    got = {x["k"]: x["turns"] for x in chat.json_turns(df, "j").collect()}
    assert all([tuple(t) for t in got[k]] == want for k in range(len(records))), got
    assert got[100] is got[101] is got[102] is None


def test_typed_and_json_records_share_fingerprints(spark):
    record = {"messages": [{"role": "user", "content": "a"}]}
    a = chat.json_turns(spark.createDataFrame([(json.dumps(record),)], "j string"), "j").first()
    b = chat.typed_turns(spark.createDataFrame([(record,)], "r struct<messages:array<struct<role:string,content:string>>>"), "r").first()
    assert (a["fingerprint"], a["turns"]) == (b["fingerprint"], b["turns"])


def test_running_totals_and_spans(spark):
    r = random.Random(1)
    for n in (0, 1, 255, 256, 257, 1000):
        x = [r.randrange(9) for _ in range(n)]
        got = spark.createDataFrame([(x,)], "x array<long>").select(running_totals(F.col("x")).alias("t")).first()["t"]
        assert got == np.cumsum(x).tolist()
    row = with_spans(spark.createDataFrame([("ab12é345 6",)], "t string"), "t", {"n": "[0-9]+"}).first()
    assert [(s["start"], s["end"], s["value"]) for s in row["n"]] == [(2, 4, "12"), (5, 8, "345"), (9, 10, "6")]


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(4)
    body = lambda k, n=80: " ".join(" ".join(f"w{r.randrange(3000)}" for _ in range(10)) + "." for _ in range(n // 10))
    texts = [body(k) for k in range(40)]
    passage = " ".join(f"q{k}" for k in range(60)) + "."
    item = " ".join(f"b{k}" for k in range(30))
    texts[10] = texts[3]  # a copy
    near = texts[4].split()
    near[5] = "changed"
    texts[11] = " ".join(near).replace(".", "")  # one long line, so that only the shingles tell
    texts[4] = texts[4].replace(".", "")
    texts[20] += "\n" + passage
    texts[21] += "\n" + passage
    texts[22] += " " + item
    texts[30] += " vile idiot worthless vile idiot worthless vile"
    labels = [(k, 1, 0) for k in range(40) if k != 30]
    for k in range(40, 60):
        texts.append(body(k) + (" vile idiot worthless" * 3))
        labels.append((k, 1, 1))
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {x["doc_id"]: x for x in docs.collect()}
        assert all(x["n_chars"] == len(x["text"]) for x in rows.values())
        kept.append(rows)
    quality, lines, near_, clean = kept
    assert set(quality) == set(range(40)) - {30}
    assert set(lines) == set(quality) - {10} and passage in lines[20]["text"] and passage not in lines[21]["text"]
    assert set(near_) == set(lines) - {11} and set(clean) == set(near_) - {22}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in packed} == set(clean)


def test_what_stands_nowhere_else_stays_in_the_pipeline(spark):
    shared, own = " ".join(f"q{k}" for k in range(900)) + ".", " ".join(f"own{k}" for k in range(100)) + "."
    rows = [(1, shared, "en", "s", len(shared)), (2, f"{shared}\n{own}", "en", "s", 1), (3, shared, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"]: x["text"] for x in corpus_pipeline.lines(spark, docs, "").collect()} == {1: shared, 2: own}


def test_near_copies_are_spared():
    from filingmill.llm.line_dedup import spared

    block = lambda start, end, row=1, words=100: {"start": start, "end": end, "first": row, "first_row": row, "first_words": words}
    near = [block(0, 40), block(41, 100)]
    assert spared(near, [], 100, 0.8, 30) == [] and spared(near, [], 100, 0.0, 30) == [(0, 40), (41, 100)]
    assert spared(near, [(40, 41)], 100, 0.8, 30) == [(0, 100)]  # an exact copy goes
    assert spared([block(0, 100, words=100)], [], 130, 0.5, 30) == [(0, 100)]  # a passage of its own
    assert spared([block(0, 90, words=5000)], [], 100, 0.8, 30) == [(0, 90)]  # a part of a long text is no near copy
    others = [block(0, 60, 2, 500), block(60, 115), block(117, 160)]  # what a third text has first goes all the same
    assert spared(others, [], 160, 0.8, 30) == [(0, 60)]


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and oracles.CHAT
