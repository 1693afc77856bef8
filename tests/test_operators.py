"""Registry, cache, derivation, sources and streams on small rows."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from filingmill import schemas, vocab
from filingmill.functions.text import TYPE_WORDS
from filingmill.operators import analysis, cache, candidates, context, facts, merge, periods, registry, responses, shape, tables
from filingmill.sources import announcements, documents, html_rows
from filingmill.streaming import ingest

AS_OF = "2024-06-01 00:00:00"


def test_ranks_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("k"))
    got = [r["rank"] for r in registry.with_ranks(df, "k", width=5000).orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_add_reactivates_and_inserts(spark):
    base = {f.name: None for f in spark.createDataFrame([], schemas.REGISTRY).schema}
    old = [base | {"id": 5, "file_hash": "a", "stock_name": "old", "market": "CN", "file_path": "p", "is_available": False}, base | {"id": 6, "file_hash": None, "is_available": True}]
    reg = spark.createDataFrame([tuple(r.values()) for r in old], schemas.REGISTRY)
    columns = [c for c in base if c not in ("id", "is_available", "download_time", "last_accessed")]
    new = [{"file_hash": "a", "file_path": "q1", "market": None, "seq": 1}, {"file_hash": "a", "file_path": "q2", "market": "HK", "seq": 2}, {"file_hash": "b", "file_path": "r", "seq": 3}, {"file_hash": None, "file_path": "s", "seq": 4}]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reg.schema if f.name in columns) + ", seq bigint"
    incoming = spark.createDataFrame([tuple(n.get(c) for c in [*columns, "seq"]) for n in new], ddl)
    got = {r["id"]: r for r in registry.add(reg, incoming, AS_OF).collect()}
    assert (got[5]["is_available"], got[5]["file_path"], got[5]["market"], got[5]["stock_name"]) == (True, "q2", "HK", "old")
    assert [(got[i]["file_hash"], got[i]["file_path"]) for i in (7, 8)] == [("b", "r"), (None, "s")] and len(got) == 4


def test_cache_versions(spark):
    c = spark.createDataFrame([("h", "v1", "1", "{}", 1, 1, None), ("h", "v2", "0", "{}", 1, 1, None)], schemas.CACHE)
    wanted = spark.createDataFrame([("h", "v1"), ("h", "v2"), ("x", "v1")], "file_hash string, schema_version string")
    assert {(r["file_hash"], r["schema_version"]): r["hit"] for r in cache.lookup(wanted, c, "1").collect()} == {("h", "v1"): True, ("h", "v2"): False, ("x", "v1"): False}
    assert cache.invalidate(c, wanted.where("file_hash = 'h'"), "v2").count() == 1 and cache.invalidate(c, wanted).count() == 0
    empty = cache.stats(spark.createDataFrame([], schemas.CACHE)).first()
    assert (empty["entries"], empty["kilobytes_x100"], empty["mean_ms"], empty["first"]) == (0, 0, 0, None)


def derived(spark, **given):
    row = facts.derive(spark.createDataFrame([("d", *map(float, given.values()))], "doc_id string, " + ", ".join(f"{k} double" for k in given))).first()
    return row.asDict()


def test_derivations(spark):
    x = derived(spark, revenue=1000000, gross_profit=400000, operating_cost=1, total_assets=1000000, total_liabilities=600000, current_assets=500000, current_liabilities=250000, inventory=100000, operating_cash_flow=500000, capital_expenditure=200000)
    assert (x["gross_margin"], x["debt_ratio"], x["current_ratio"], x["quick_ratio"], x["free_cash_flow"], x["operating_cost"]) == (40.0, 60.0, 2.0, 1.6, 300000.0, 600000.0)
    assert set(x["derived"]) == {"operating_cost", "gross_margin", "debt_ratio", "current_ratio", "quick_ratio", "free_cash_flow"}
    y = derived(spark, revenue=0, gross_profit=10, net_profit=100, eps=2, total_equity=500, capital_expenditure=0, operating_cash_flow=0)
    assert (y["gross_margin"], y["net_margin"], y["total_shares"], y["bps"], y["roe"], y["free_cash_flow"]) == (None, None, 50.0, 10.0, 20.0, 0.0)


@pytest.mark.parametrize(
    "text,name,kinds,primary",
    [
        ("2025 Q4 and full year results, year ended Dec 31, 2025", "2026_quarterly_en.pdf", {"2025FY", "2024FY", "2025Q4_SINGLE", "BS_2025-12-31"}, "2025FY"),
        ("2025 Q3 results, nine months ended Sep 30, 2025", "2025_quarterly_q3_en.pdf", {"2025Q3_YTD", "2025Q3_SINGLE", "BS_2025-09-30"}, "2025Q3_YTD"),
    ],
)
def test_periods(spark, text, name, kinds, primary):
    p = periods.periods(periods.identified(spark.createDataFrame([("d", name, name, text)], "doc_id string, file_name string, path string, text string")))
    assert kinds <= {r["period_id"] for r in p.collect()} and periods.period_keys(p).first()["primary_id"] == primary


def test_text_candidates(spark):
    rows = [("a", "In RMB'000\nTotal revenue 20,703,294 18,000,000\nProfit for the year 4,700,278", "en"), ("b", "11. PROFIT FOR THE YEAR 11.", "en"), ("c", "营业收入 1,234.5", "en"), ("d", "x", "zh"), ("e", None, "zh")]
    got = {(r["doc_id"], r["field"]): round(r["value"], 3) for r in candidates.best(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()}
    assert got == {("a", "revenue"): 20703.294, ("a", "net_profit"): 4700.278, ("c", "revenue"): 1234.5}


def test_related_parties(spark):
    cells = [("d", 1, 1, 0, 0, "关联方"), ("d", 1, 1, 0, 1, "金额"), ("d", 1, 1, 1, 0, "甲公司"), ("d", 1, 1, 1, 1, "50"), ("d", 1, 1, 1, 2, "1,200"), ("d", 1, 1, 2, 0, "乙"), ("d", 1, 1, 2, 1, "5"), ("d", 2, 1, 0, 0, "其他"), ("d", 2, 1, 1, 0, "丙"), ("d", 2, 1, 1, 1, "999")]
    got = tables.related_parties(spark.createDataFrame(cells, schemas.CELLS), ["关联方"]).collect()
    assert [(r["party_name"], r["amounts"]) for r in got] == [("甲公司", [1200.0])]


def test_statement_shapes(spark):
    df = spark.createDataFrame([("2023-12-31", "1,000", None), (None, None, None)], "fiscalDateEnding string, totalRevenue string, netIncome string")
    got = shape.statements(df, "income_statement", "X", "s").collect()
    assert len(got) == 1 and got[0]["report_date"] == "2023-12-31" and got[0]["total_revenue"]["num"] == 1000.0
    info = shape.stock_info(spark.createDataFrame([("A", "n")], "symbol string, name string"), "tushare").first()
    assert (info["symbol"], info["ts_code"], info["source"]) == ("A", "", "tushare")
    assert {r["report_type"] for r in shape.report_bundle({"income_statement": df}, "X", "s", "annual").collect()} == {"annual"}


def test_hk_feed(spark):
    items = [{"newsId": "1", "title": "2024 Annual Report", "webPath": "/sehk/2025/0318/a.pdf", "relTime": "18/03/2025", "stock": [{"sc": "700", "sn": "T"}]}, {"newsId": "2", "title": "Annual Report", "webPath": "", "stock": [{"sc": "1", "sn": "x"}]}, {"newsId": "3", "title": "Annual Report", "webPath": "/b.pdf", "stock": []}]
    answers = spark.createDataFrame([(json.dumps({"newsInfoLst": items}),), (json.dumps(items[:1]),), (None,)], "j string")
    got = announcements.hk_announcements(answers, "j", "http://h", "annual").collect()
    assert [(r["stock_code"], r["pdf_url"], r["language"], r["year"], r["market"]) for r in got] == [("00700", "http://h/sehk/2025/0318/a.pdf", "en", 2024, "SEHK")] * 2
    assert "annual" in TYPE_WORDS


def test_html_result_rows(spark):
    page = "<table class='other'><tr><td>a</td></tr></table><table class='table x'><tr><th>T</th></tr><tr><td>Release Time:04/02/2026 19:21</td><td>700</td><td><a href='/f/1_c.pdf'>年報 2025</a></td></tr><tr><td>x</td><td>y</td><td><a href='/no.html'>n</a></td></tr></table>"
    df = spark.createDataFrame([("00700", page), ("1", None), ("2", "<table><tr><td>04/02/2024</td><td>b</td><td><a href='http://q/z.pdf'>Report</a></td></tr></table>")], "stock_code string, html string")
    got = {r["stock_code"]: r for r in html_rows.search_results(df, "http://h/").collect()}
    assert (got["00700"]["pdf_url"], got["00700"]["language"], got["00700"]["year"]) == ("http://h/f/1_c.pdf", "zh", 2025)
    assert got["2"]["pdf_url"] == "http://q/z.pdf" and got["2"]["year"] == 2024 and "1" not in got


def test_parsed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("page one\fpage two\fthree")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xff")
    parsed = documents.parsed_files(spark, str(tmp_path), documents.plain_parser, "*.txt")
    got = {r["source"][-5:]: r for r in documents.read_documents(parsed, "1-2,9").collect()}
    assert [p["text"] for p in got["a.txt"]["page_texts"]] == ["page one", "page two"] and got["a.txt"]["missing"] == [9]
    assert not got["b.txt"]["success"] and "Unicode" in got["b.txt"]["error"]
    whole = {r["source"][-5:]: r["full_text"] for r in documents.read_documents(parsed, full_text=True).collect()}
    assert whole["a.txt"] == "page one\n\npage two\n\nthree"
    assert documents.read_documents(parsed, "5-2").where("success").count() == 0
    pages, cells = documents.pages_and_cells(parsed)
    assert pages.count() == 3 and cells.count() == 0 and documents.listed_files(spark, str(tmp_path)).count() == 0


def test_latest_reports_keep_last_values(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "seq long, id string, title string, publish_timestamp long")
    got = merge.latest_reports([df((1, "a", "first", 10), (2, "b", "b", 30)), df((1, "a", "last", 20), (2, "c", "c", 30))], F.col("id"), 3).collect()
    assert [(r["id"], r["title"]) for r in got] == [("b", "b"), ("c", "c"), ("a", "last")]


def test_analysis(spark):
    q = spark.createDataFrame([("x", 8093 + k, float(k + 1)) for k in range(6) if k != 2], "company string, q long, v double")
    got = {r["q"]: r for r in analysis.growth(analysis.trailing(q, ["company"], "q", "v"), ["company"], "q", "v").collect()}
    assert all(r["ttm"] is None for r in got.values()) and got[8094]["qoq"] == 1.0 and got[8097]["yoy"] == 4.0 and got[8096]["qoq"] is None


def test_vocabulary_fits():
    assert len(vocab.SPECS) == 42 and len(vocab.STATEMENT_OF) == 42
    assert all(m in vocab.STATEMENT_OF for by in vocab.LABELS.values() for m in by) and all(d in vocab.STATEMENT_OF for _, ds in vocab.FORMULAS.values() for d in ds)


def test_stream_appends_each_key_once(spark, tmp_path):
    feed, table, check = tmp_path / "feed", str(tmp_path / "table"), str(tmp_path / "check")
    feed.mkdir()
    schema = spark.createDataFrame([], "id string, seq long, title string").schema
    write = lambda name, rows: (feed / name).write_text("\n".join(json.dumps(dict(zip(("id", "seq", "title"), r, strict=True))) for r in rows))
    write("1.json", [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")])
    ingest.append_new(ingest.polled(spark, str(feed), schema), table, "id", "seq", check).awaitTermination()
    write("2.json", [("b", 4, "again"), ("c", 5, "new")])
    ingest.append_new(ingest.polled(spark, str(feed), schema), table, "id", "seq", check).awaitTermination()
    assert sorted((r["id"], r["seq"]) for r in spark.read.parquet(table).collect()) == [("a", 1), ("b", 2), ("c", 5)]


def test_identity_of_the_registry(spark):
    docs = spark.createDataFrame([("d", "h", "1", None, "US"), ("e", None, "2", "own", None)], "doc_id string, file_hash string, stock_code string, stock_name string, market string")
    reg = spark.createDataFrame([("h", "00700", "T", "HK")], "file_hash string, stock_code string, stock_name string, market string")
    got = {r["doc_id"]: r for r in context.with_identity(docs, reg).collect()}
    assert (got["d"]["stock_code"], got["d"]["stock_name"], got["d"]["market"]) == ("00700", "T", "US") and got["e"]["stock_code"] == "2"


@pytest.mark.parametrize("path,want", [("a/b.pdf", "/r/a/b.pdf"), ("a/../b.pdf", "/r/b.pdf"), ("../r-x/a", None), ("/etc/x", None), ("a/../../x", None)])
def test_paths_stay_inside(path, want):
    if want:
        assert context.confined("/r", path) == want
    else:
        with pytest.raises(ValueError):
            context.confined("/r", path)


def test_cache_table_is_made_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS made LOCATION '{tmp_path}'")
    context.create_cache_table(spark, "made.cache")
    context.create_cache_table(spark, "made.cache")
    assert spark.table("made.cache").columns[0] == "file_hash"
    spark.sql("DROP DATABASE made CASCADE")


def test_broken_payloads_are_empty(spark):
    got = context.read_payloads(spark.createDataFrame([("{",), (None,), ('{"a": 1}',)], "payload string"), "a int").collect()
    assert [r["parsed"] and r["parsed"]["a"] for r in got] == [None, None, 1]


def _by_hand(target, allowed, rows):
    """The primary and the comparison of one value, row by row."""
    strict = [o for o in rows if o["column_role"] in allowed and o["column_role"] != "unknown"]
    fits = [o for o in rows if o["column_role"] in allowed]
    some = [o for o in rows if o in strict or (o["column_role"] == "unknown" and o["is_comparison"])] if strict else fits or rows
    rank = lambda o: (o["is_comparison"], -abs(o["value"]) if strict else abs(o["value"] - target), bool(strict) and o not in strict, o["obs_seq"])
    line = sorted(some, key=rank)
    first = line[0]
    off = lambda o: abs(o["value"] - first["value"])
    same_row = [o for o in line[1:] if off(o) > 1e-9 and o["row_label"] == first["row_label"]]
    marked = [o for o in line if o["is_comparison"]]
    if same_row:
        second = min(same_row, key=lambda o: ((o["page"], o["table_index"]) != (first["page"], first["table_index"]), off(o), not o["is_comparison"], o["obs_seq"]))
    elif marked:
        second = min(marked, key=lambda o: (off(o), o["obs_seq"]))
    else:
        second = next((o for o in line[1:] if off(o) > 1e-9), None)
    return first["obs_seq"], second and second["obs_seq"]


def test_chosen_observations_are_those_of_brute_force(spark):
    r = random.Random(5)
    names = ["doc_id", "obs_seq", "statement", "metric", "page", "table_index", "row_label", "column_header", "column_role", "column_year", "is_comparison", "raw_value", "value", "snippet"]
    rows, values, want = [], [], {}
    for k in range(300):
        allowed = r.choice([["full_year"], ["full_year", "unknown"], ["ytd"], ["single_q", "ytd"]])
        roles, labels = r.choice([["full_year", "unknown"], ["unknown"], ["ytd", "full_year", "unknown"]]), r.choice([["a"], ["a", "b"], [f"l{n}" for n in range(9)]])
        mine = [
            dict(zip(names, [f"d{k}", n, "s", "m", r.randrange(2), r.randrange(2), r.choice(labels), "h", r.choice(roles), None, r.random() < 0.4, "v", float(r.randrange(-6, 7)), "x"], strict=True))
            for n in range(r.randrange(1, 7))
        ]
        target = float(r.randrange(-6, 7))
        rows += [tuple(o[c] for c in names) for o in mine]
        values.append((f"d{k}", "s", "m", target, allowed))
        want[f"d{k}"] = _by_hand(target, allowed, mine)
    v = spark.createDataFrame(values, "doc_id string, statement string, metric string, value double, allowed array<string>")
    got = {}
    for x in facts.chosen_observations(v, spark.createDataFrame(rows, schemas.OBSERVATIONS)).collect():
        got.setdefault(x["doc_id"], {})[x["place"]] = x["obs_seq"]
    assert {d: (x["primary"], x.get("comparison")) for d, x in got.items()} == want
    plan = facts.primary_observations(v, spark.createDataFrame(rows, schemas.OBSERVATIONS))._jdf.queryExecution().toString()
    assert "Window" not in plan


def test_answers_have_their_shapes(spark):
    asks = spark.createDataFrame([(1, "600000", "CN", None, 2), (2, "600000", "CN", "annual", None), (3, "x", "CN", "annual", 0), (4, None, None, None, 5)], "request_id int, stock_code string, market string, report_type string, limit int")
    reports = spark.createDataFrame(
        [("600000", "CN", "annual", "web", "t", "u1", "2024-01-01", 5), ("600000", "CN", "quarterly", "web", "t", "u2", None, None), ("600000", "CN", "annual", "web", None, "u3", "2024-05-01", 7), ("600000", "HK", "annual", "web", "t", "u4", "2024-01-01", 5)],
        "stock_code string, market string, report_type string, source string, title string, url string, publish_date string, file_size int",
    )
    out = responses.search_answers(asks, reports)
    assert out.schema["answer"].dataType.simpleString() == spark.createDataFrame([], schemas.SEARCH_ANSWER).schema.simpleString()
    got = {x["request_id"]: x["answer"] for x in out.collect()}
    assert [x["url"] for x in got[1]["reports"]] == ["u3", "u1"] and [x["report_type"] for x in got[2]["reports"]] == ["annual", "annual"]
    assert (got[3]["count"], got[3]["reports"], got[3]["source"], got[4]["count"]) == (0, [], None, 0) and got[1]["source"] == "web"
    assert responses.search_answers(asks.limit(0), reports).count() == 0

    base = {f.name: None for f in spark.createDataFrame([], schemas.REGISTRY).schema}
    (entry,) = responses.file_entries(spark.createDataFrame([tuple((base | {"id": 3, "file_size": 9}).values())], schemas.REGISTRY)).collect()
    assert entry["entry"]["id"] == 3 and entry["entry"]["file_size"] == 9 and entry["entry"]["download_time"] is None

    records = spark.createDataFrame([("a", 5.0, None), ("b", None, None)], "doc_id string, revenue double, eps double")
    got = {x["doc_id"]: x for x in responses.extraction_answers(records).collect()}
    assert got["a"]["answer"]["income_statement"]["revenue"] == 5.0 and got["a"]["n_fields"] == 1 and got["a"]["answer"]["financial_metrics"] is None
    assert got["b"]["answer"]["income_statement"] is None and got["b"]["n_fields"] == 0
    told = spark.createDataFrame([("a", 0, "revenue", 6.0), ("a", 1, "revenue", 4.0), ("a", 1000, "eps", 0.5)], "doc_id string, fact_seq int, metric string, value double")
    got = {x["doc_id"]: x for x in responses.extraction_answers(records, told).collect()}
    assert got["a"]["answer"]["income_statement"]["revenue"] == 6.0 and got["a"]["n_fields"] == 1 and got["b"]["n_fields"] == 0
