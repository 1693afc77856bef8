"""Data source, keyed state, bucketed tables, interval and similarity joins, passes, ranks, names in texts, evidence through derivations."""

from __future__ import annotations

import datetime
import os
import random
import re
import resource
from datetime import timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filingmill import vocab
from filingmill.functions import names
from filingmill.operators import candidates, derivation, intervals, registry, similar, tables
from filingmill.operators.bucketed import Bucketed
from filingmill.sources import paged, passes
from filingmill.streaming import keyed

# --- names -----------------------------------------------------------------------------------------------------------


def test_spans_are_all_occurrences():
    r = random.Random(4)
    words = ("ab", "abc", "b c", "c", "a", "abcab")
    for _ in range(200):
        text = "".join(r.choice("aAbBc  \t\nİ") for _ in range(r.randrange(40)))
        got = sorted((s, e, k) for s, e, k, _ in names.spans(text, words))
        want = sorted((m.start(1), m.end(1), k) for k, w in enumerate(words) for m in re.finditer("(?=(" + re.escape(w).replace(r"\ ", "[ \t]+") + "))", text, re.I) if not (w.startswith(" ") or w.endswith(" ")))
        assert got == want, text


def test_names_within_longer_ones_are_told():
    hits = {(s, e, k): inside for s, e, k, inside in names.spans("Net  Profit margin, net profit", ("net profit", "net profit margin", "margin"))}
    assert hits == {(0, 11, 0): True, (0, 18, 1): False, (12, 18, 2): True, (20, 30, 0): False}


def test_names_are_plain():
    listed = vocab.text_names()
    assert all(n == n.lower() == " ".join(n.split()) for *_, n in listed)
    for lang in ("en", "zh"):
        assert {f for code, f, *_ in listed if code == lang} | {"equity_attributable_to_parent"} == set(vocab.STATEMENT_OF)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Profit for the year 年內溢利 12 5,321,000", {"12", "5,321,000"}), ("Revenue 3 12,000 11,000", {"3", "12,000"}), ("$11.3 billion of revenues", {"11.3"}), ("revenues of $11.3 billion", {"11.3"}),
        ("Gross margin 45 in 2024", {"45", "2024"} - {"2024"}), ("revenue\n5", set()), ("revenue -5", {"-5"}), ("revenue - 5", set()),
    ],
)
def test_amounts_of_a_name(text, want):
    found = {a for s, e, _, inside in names.spans(text, tuple({n for *_, n in vocab.text_names()})) if not inside for *_, a in candidates.amounts(text, s, e)}
    assert found == want


def test_profit_past_a_note_is_the_best(spark):
    rows = [(1, "Profit for the year 年內溢利 12 5,321,000", "en"), (2, "It had $11.3 billion of revenues in all", "en"), (3, "净利率 12.5\n归属于母公司股东的净利润 900", "zh")]
    got = {(x["doc_id"], x["field"]): x["value"] for x in candidates.best(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1, "net_profit"] == 5321000.0 and got[2, "revenue"] == 11300.0 and got[3, "net_margin"] == 12.5 and got[3, "net_profit_attributable_to_parent"] == 900.0


def test_a_text_without_line_breaks_takes_bounded_memory():
    text = ("total revenue 20,703,294 and profit for the year 4,700,278 as well as other words " * 130_000)[: 10 << 20]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text], "lang": ["en"]})
    before, rows, most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
    for part in candidates._scan(iter([batch]), vocab.text_names()):
        rows, most = rows + len(part), max(most, part.nbytes)
    assert rows >= 2 * len(text) // 82 - 2 and most < 2 * candidates.BATCH_BYTES
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kilobytes


def test_labels_by_one_pass(spark):
    labels = [("en", "Total Revenues (note 3)"), ("en", "prerevenue"), ("en", "noncontrolling profit for the year"), ("zh", "其中：营业收入"), ("zh", "Revenue"), ("en", None), (None, "revenue"), ("en", "Gross  profit")]
    got = {(x["lang"], x["label"], x["metric"]) for x in tables.label_metrics(spark.createDataFrame(labels, "lang string, label string")).collect()}
    assert got == {("en", "Total Revenues (note 3)", "revenue"), ("zh", "其中：营业收入", "revenue"), ("en", "Gross  profit", "gross_profit")}


# --- evidence --------------------------------------------------------------------------------------------------------


def test_evidence_goes_through_derived_facts(spark):
    rows = [("d", 0, "revenue", "p", False, "e1"), ("d", 2, "operating_cost", "p", False, "e2"), ("d", 4, "gross_profit", "p", True, None), ("d", 6, "gross_margin", "p", True, "e9"), ("x", 4, "gross_profit", "p", True, None), ("x", 2, "operating_cost", "p", True, None), ("x", 0, "revenue", "p", False, "e1")]
    facts = spark.createDataFrame(rows, "doc_id string, fact_seq int, metric string, period_id string, is_derived boolean, evidence_id string")
    deps = vocab.dependency_dim(spark)
    got = {(x["doc_id"], x["fact_seq"]): x["inherited"] for x in derivation.inherited(facts, deps).collect()}
    assert got == {("d", 4): ["e1", "e2"], ("d", 6): ["e1", "e2"], ("x", 4): ["e1"], ("x", 2): ["e1"]}  # x: two that come from each other
    paths = {(x["fact_seq"], tuple(x["path"]), x["dep_fact_seq"]) for x in derivation.reached(derivation.derivation_edges(facts.where("doc_id = 'd'"), deps)).collect()}
    assert paths == {(4, (0,), 0), (4, (1,), 2), (6, (0,), 4), (6, (1,), 0), (6, (0, 0), 0), (6, (0, 1), 2)}
    only = {(x["doc_id"], x["fact_seq"]): x["inherited"] for x in derivation.inherited(facts.withColumn("fact_seq", F.col("fact_seq") * F.when(F.col("metric") == "operating_cost", 4).otherwise(1)), deps, parity=True).collect()}
    assert only["d", 4] == ["e1"] and only["d", 6] == ["e1"]  # the cost stands behind


# --- bucketed tables -------------------------------------------------------------------------------------------------

ROW = "k long, v string, seq long"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}


def state(table):
    return sorted((x["k"], x["v"]) for x in table.read().collect())


def test_upserts_write_touched_buckets_only(spark, tmp_path):
    t = Bucketed(spark, str(tmp_path / "t"), ROW, ["k"], 8)
    df = lambda rows: spark.createDataFrame(rows, ROW)
    assert state(t) == [] and t.upsert(df([]), "seq") == set()
    t.upsert(df([(k, "a", k) for k in range(100)]), "seq")
    before = files(t.path)
    touched = t.upsert(df([(3, "b", 1), (3, "c", 2), (200, "n", 3)]), "seq")
    assert len(touched) <= 2 and all(before[f] == m for f, m in files(t.path).items() if f in before)
    assert len(files(t.path)) - len(before) == len(touched)
    want = {k: "a" for k in range(100)} | {3: "c", 200: "n"}
    assert state(t) == sorted(want.items())
    assert t.insert_ignore(df([(3, "z", 1)]), "seq") == set() and state(t) == sorted(want.items())
    t.insert_ignore(df([(3, "z", 1), (300, "y", 9), (300, "x", 5)]), "seq")
    want[300] = "x"
    assert state(t) == sorted(want.items())
    t.delete(df([(3, None, None), (999, None, None)]))
    del want[3]
    assert state(t) == sorted(want.items())
    t.append(df([(1, "again", 1)]))
    assert state(t) == sorted([*want.items(), (1, "again")])


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, tmp_path):
    t = Bucketed(spark, str(tmp_path / "t"), ROW, ["k"], 4)
    df = lambda rows: spark.createDataFrame(rows, ROW)
    t.upsert(df([(k, "a", k) for k in range(20)]), "seq")
    t.write(df([(1, "lost", 1)]), 2)  # and the run ends here
    assert state(t) == [(k, "a") for k in range(20)]
    t.upsert(df([(2, "b", 1)]), "seq")
    assert state(t) == sorted((k, "b" if k == 2 else "a") for k in range(20))


def test_a_bucket_may_get_empty(spark, tmp_path):
    t = Bucketed(spark, str(tmp_path / "t"), ROW, ["k"], 2)
    t.upsert(spark.createDataFrame([(1, "a", 1)], ROW), "seq")
    t.delete(spark.createDataFrame([(1, "", 1)], ROW))
    assert state(t) == []


# --- joins -----------------------------------------------------------------------------------------------------------


def test_dyadic_ranges_make_up_the_interval(spark):
    rows = [(a, b) for a in (-9, 0, 3, 7, 100) for b in (-10, 0, 5, 7, 8, 130, 700)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", intervals.dyadic(F.col("a"), F.col("b"), 4).alias("cuts")).collect()
    for x in got:
        held = sorted(p for c in x["cuts"] for p in range(c["block"] << c["level"], (c["block"] + 1) << c["level"]))
        assert held == list(range(x["a"], x["b"] + 1)), x


def test_intervals_of_any_width(spark):
    r = random.Random(6)
    spans = [(k, r.choice("xy"), a := r.randrange(-50, 900), a + r.choice([-1, 0, 1, 7, 120, 800])) for k in range(60)] + [(90, "x", None, 5), (91, None, 1, 5)]
    points = [(k, r.choice("xyz"), r.randrange(-60, 1000)) for k in range(300)] + [(900, "x", None), (901, None, 3)]
    a, b = spark.createDataFrame(spans, "i long, key string, first long, last long"), spark.createDataFrame(points, "p long, key string, day long")
    inside = lambda s, p: None not in (s[1], s[2], p[2]) and s[1] == p[1] and s[2] <= p[2] <= s[3]
    joined = intervals.interval_join(a, b, ["key"], "first", "last", "day", levels=6)
    assert sorted((x["i"], x["p"]) for x in joined.collect()) == sorted((s[0], p[0]) for s in spans for p in points if inside(s, p))
    assert not re.search("NestedLoop|Cartesian", joined._jdf.queryExecution().toString())
    left = intervals.interval_join(a, b, ["key"], "first", "last", "day", how="left")
    assert sorted((x["i"], -1 if x["p"] is None else x["p"]) for x in left.collect()) == sorted((s[0], p) for s in spans for p in ([q[0] for q in points if inside(s, q)] or [-1]))


def test_similar_labels_are_all_pairs(spark):
    r = random.Random(9)
    base = ["adjusted ebitda margin", "active users monthly", "gross merchandise volume", "same store sales", "订单金额合计", "x"]
    rows = []
    for k in range(120):
        s = list(r.choice(base))
        for _ in range(r.randrange(3)):
            s[r.randrange(len(s))] = r.choice("abcdeé ")
        rows.append((k, "".join(s), r.choice(["u", "v"])))
    rows += [(500, None, "u"), (501, "", "u"), (502, "same store sales", None)]
    grams = lambda t: {f" {t} "} if len(t) < 2 else {f" {t} "[i : i + 3] for i in range(len(t))}
    norm = lambda t: re.sub(" +", " ", t.strip()).lower()
    want = {}
    for i, (a, x, u) in enumerate(rows):
        for b, y, v in rows[i + 1 :]:
            if None not in (x, y, u, v) and u == v:
                p, q = grams(norm(x)), grams(norm(y))
                if (c := len(p & q) / (len(p) * len(q)) ** 0.5) > 0.7:
                    want[a, b] = (round(c, 9), "merge" if c > 0.9 else "review")
    got = {(x["a"], x["b"]): (round(x["similarity"], 9), x["band"]) for x in similar.similar_labels(spark.createDataFrame(rows, "id long, label string, unit string"), ["unit"]).collect()}
    assert got == want and len(want) > 50


# --- ranks, statistics, passes ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [[5, 1 << 40, -3, 7, 10**15], list(range(1000, 0, -1)), [], [3]])
def test_ranks_of_sparse_numbers(spark, keys):
    df = registry.with_ranks(spark.createDataFrame([(k,) for k in keys], "k long").repartition(3), "k")
    assert [(x["k"], x["rank"]) for x in df.orderBy("k").collect()] == [(k, n) for n, k in enumerate(sorted(keys), 1)]
    assert "Window" not in df._jdf.queryExecution().toString()


def test_ranks_by_two_columns(spark):
    rows = [(r, c) for r in ("b", "a", None) for c in (3, 1, 2)]
    got = registry.with_ranks(spark.createDataFrame(rows, "g string, k long"), "g", "k", width=2).collect()
    assert {(x["g"], x["k"]): x["rank"] for x in got} == {(g, c): 3 * i + j for i, g in enumerate((None, "a", "b")) for j, c in enumerate((1, 2, 3), 1)}


def test_statistics_in_one_scan(spark):
    rows = [("CN", "annual", True, 10), ("CN", None, False, 5), (None, "annual", None, None)]
    log = spark.createDataFrame(rows, "market string, kind string, done boolean, size long")
    df = registry.collection_stats(log, F.col("done"), ["market", "kind"], "size", {"market": ["CN", "HK"]})
    got = {(x["dimension"], x["key"]): x["n"] for x in df.collect()}
    assert got == {("total", "all"): 3, ("total", "downloaded"): 1, ("total", "bytes"): 15, ("total", "megabytes_x100"): 0, ("market", "CN"): 2, ("market", None): 1, ("market", "HK"): 0, ("kind", "annual"): 2, ("kind", None): 1}
    assert registry.collection_stats(log, F.col("done"), ["market", "kind"], "size")._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    assert {x["key"]: x["n"] for x in registry.collection_stats(log.limit(0), F.col("done"), [], "size").collect()} == {"all": 0, "downloaded": 0, "bytes": 0, "megabytes_x100": 0}


def test_passes_until_nothing_is_missing(spark):
    day = lambda n: datetime.date(2024, 1, 1) + timedelta(days=n)
    events = [(k, "x", day(k * k % 60)) for k in range(90)] + [(1000 + k, "y", day(5)) for k in range(9)]
    store = spark.createDataFrame(events, "id long, key string, day date")
    asked = []

    def answer(requests, most=4):
        asked.append(requests.count())
        hits = intervals.interval_join(requests.withColumns({"a": F.unix_date("first_day"), "b": F.unix_date("last_day")}), store.withColumn("d", F.unix_date("day")), ["key"], "a", "b", "d")
        from pyspark.sql import Window

        w = Window.partitionBy("slice_id")
        return hits.withColumns({"announced": F.count("*").over(w), "r": F.row_number().over(w.orderBy("id"))}).where(F.col("r") <= most).select("slice_id", "announced", "id")

    requests = spark.createDataFrame([("x", day(0), day(59)), ("y", day(0), day(9)), ("none", day(0), day(3))], "key string, first_day date, last_day date")
    slices, rows = passes.asked_until_complete(requests, answer)
    got = slices.collect()
    days = {}
    for x in got:
        for n in range((x["last_day"] - x["first_day"]).days + 1):
            assert days.setdefault((x["key"], x["first_day"] + timedelta(days=n)), 1)  # no day in two slices
        of = [e for e in events if e[1] == x["key"] and x["first_day"] <= e[2] <= x["last_day"]]
        assert x["announced"] == len(of) and x["stored"] == min(4, len(of)) and x["complete"] == (len(of) <= 4)
        assert x["complete"] or x["first_day"] == x["last_day"]
    assert len(days) == 60 + 10 + 4
    assert rows.count() == sum(x["stored"] for x in got) == rows.select("id").distinct().count()
    assert len(asked) <= passes.PASSES
    few, _ = passes.asked_until_complete(requests, answer, passes=2)
    assert not few.where("key = 'x'").agg(F.bool_and("complete")).first()[0] and few.agg(F.max("pass")).first()[0] == 2


# --- data source -----------------------------------------------------------------------------------------------------


class Counting(paged.PlainText):
    """Writes down which pages were asked for."""

    def page(self, number):
        with open(os.environ["PAGES_ASKED"], "a") as f:
            f.write(f"{number}\n")
        if self.pages[number - 1] == "bad":
            raise ValueError("unreadable")
        return super().page(number)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    (at / "sub").mkdir(parents=True)
    (at / "a.txt").write_text("a1\fa2\fa3")
    (at / "sub" / "b.txt").write_text("b1")
    (at / "broken.txt").write_bytes(b"\xff\xfe\xff")
    (at / "other.dat").write_text("no")
    return str(at)


def test_pages_of_files(spark, folder):
    df = paged.paged_documents(spark, folder, "filingmill.sources.paged:PlainText", "*.txt", partition_bytes=4)
    got = sorted(((os.path.basename(x["source"]), x["num_pages"], x["page_no"], x["text"], x["error"] and x["error"].split(":")[0]) for x in df.collect()), key=str)
    assert got == [("a.txt", 3, 1, "a1", None), ("a.txt", 3, 2, "a2", None), ("a.txt", 3, 3, "a3", None), ("b.txt", 1, 1, "b1", None), ("broken.txt", None, None, None, "UnicodeDecodeError")]
    assert df.rdd.getNumPartitions() == 3 and len({x["file_hash"] for x in df.collect()}) == 3
    assert paged.paged_documents(spark, f"file://{folder}", "filingmill.sources.paged:PlainText", "*.txt").count() == 5


def test_only_asked_pages_are_parsed(spark, folder, tmp_path):
    at = tmp_path / "asked"
    at.write_text("")
    os.environ["PAGES_ASKED"] = str(at)
    reader = paged.PruningReader({"path": folder, "pattern": "*.txt", "parser": "tests.test_mechanisms:Counting"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    left = list(reader.pushFilters([In(("page_no",), (1, 3, 9)), GreaterThan(("page_no",), 1), EqualTo(("source",), "x")]))
    assert left == [EqualTo(("source",), "x")]
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert [(x["page_no"], x["text"]) for x in rows] == [(3, "a3")] and at.read_text() == "3\n"
    some = paged.Pages()
    assert some.take(LessThanOrEqual(("page_no",), 2)) and list(some.of(5)) == [1, 2] and not some.take(EqualTo(("text",), 1))


def test_filters_reach_the_parser(spark, folder):
    own = spark.newSession()
    own.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = paged.paged_documents(own, folder, "filingmill.sources.paged:PlainText", "*.txt").where("page_no = 2")
    assert [x["text"] for x in df.collect()] == ["a2"]
    assert paged.paged_documents(own, folder, "filingmill.sources.paged:PlainText", "*.txt").where("page_no >= 2 and page_no < 4").count() == 2


def test_requests_are_checked(spark):
    rows = [("p", None, None), (None, "u", "1-3"), ("p", "u", None), (None, "", None), ("p", None, "x"), ("p", None, ""), ("p", None, " 1, 2-4 "), ("p", None, "3-1")]
    got = [x["problem"] for x in paged.checked_requests(spark.createDataFrame(rows, "path string, url string, pages string").coalesce(1)).collect()]
    assert got == [None, None, "path_or_url", "path_or_url", "pages", "pages", None, "pages"]


# --- keyed state -----------------------------------------------------------------------------------------------------


def ran(df, at, name, **trigger):
    run = df.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-progress").outputMode("append").trigger(**trigger or {"availableNow": True}).start()
    assert run.awaitTermination(60)
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}").collect()


def test_first_arrivals_over_restarts(spark, tmp_path):
    own, at = keyed.keyed_state(spark), str(tmp_path)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    put = lambda n, rows: spark.createDataFrame(rows, "k string, seq long").coalesce(1).write.parquet(f"{at}/in/{n}")
    feed = lambda lifetime=None: keyed.first_arrivals(own.readStream.schema("k string, seq long").option("recursiveFileLookup", "true").parquet(f"{at}/in"), ["k"], "seq", lifetime)
    put(1, [("a", 2), ("a", 1), ("b", 3)])
    assert sorted((x["k"], x["seq"]) for x in ran(feed(), at, "out")) == [("a", 1), ("b", 3)]
    short, long = timedelta(milliseconds=1), timedelta(days=30)
    assert [len(ran(feed(life), at, name, once=True)) for life, name in ((short, "short"), (long, "long"))] == [2, 2]
    put(2, [("a", 0), ("c", 9)])
    assert sorted((x["k"], x["seq"]) for x in ran(feed(), at, "out")) == [("a", 1), ("b", 3), ("c", 9)]
    assert sorted((x["k"], x["seq"]) for x in ran(feed(short), at, "short", once=True)) == [("a", 0), ("a", 1), ("b", 3), ("c", 9)]  # forgotten
    assert sorted((x["k"], x["seq"]) for x in ran(feed(long), at, "long", once=True)) == [("a", 1), ("b", 3), ("c", 9)]


def test_cached_results_of_another_version_miss(spark, tmp_path):
    own, at = keyed.keyed_state(spark), str(tmp_path)
    put = lambda n, rows: spark.createDataFrame(rows, "file_hash string, seq long, extractor_version string, payload string").coalesce(1).write.parquet(f"{at}/in/{n}")
    feed = lambda: keyed.cached_lookups(own.readStream.schema("file_hash string, seq long, extractor_version string, payload string").option("recursiveFileLookup", "true").parquet(f"{at}/in"))
    put(1, [("h", 2, "1", None), ("h", 1, "1", "p"), ("h", 0, "1", None), ("h", 3, "2", None), ("g", 4, "1", None)])
    got = {(x["file_hash"], x["seq"]): (x["hit"], x["payload"]) for x in ran(feed(), at, "out")}
    assert got == {("h", 0): (False, None), ("h", 2): (True, "p"), ("h", 3): (False, None), ("g", 4): (False, None)}
    put(2, [("h", 6, "1", None), ("h", 8, "2", "q"), ("h", 9, "2", None), ("h", 10, "1", None)])
    got = {(x["file_hash"], x["seq"]): (x["hit"], x["payload"]) for x in ran(feed(), at, "out") if x["seq"] > 5}
    assert got == {("h", 6): (True, "p"), ("h", 9): (True, "q"), ("h", 10): (False, None)}
