"""What keeps queries within memory, disk and time as their tables grow."""

from __future__ import annotations

from pyspark.sql import functions as F

import re

from filingmill import schemas, staging, vocab
from filingmill.operators import candidates, facts, intervals, periods, similar, tables
from filingmill.plans import mechanism_queries
from filingmill.plans.registry import QUERIES
from filingmill.sources import paged


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line and "Broadcast" not in line]


def test_facts_are_built_in_one_pass_by_document(spark):
    """A derived fact through a derived one, a comparison and a single quarter; each input is shuffled once, by document, and nothing is staged."""
    given = {"revenue": 100.0, "gross_profit": 40.0, "net_profit": 10.0}
    record = spark.createDataFrame([("d", *(given.get(m) for m in vocab.STATEMENT_OF))], schemas.RECORD)
    row = lambda seq, metric, role, older, value: ("d", seq, vocab.INCOME, metric, 1, 1, metric, f"h{older}", role, None, older, str(value), value, "s")
    seen = [row(1, "revenue", "full_year", False, 100.0), row(2, "revenue", "full_year", True, 90.0), row(1, "gross_profit", "full_year", False, 40.0), row(1, "net_profit", "single_q", False, 3.0)]
    filings = spark.createDataFrame([("d", "q4_full_year", 2023)], "doc_id string, kind string, fiscal_year int")
    spans = periods.periods(filings)
    documents = spark.createDataFrame([("d", "USD", "million")], "doc_id string, currency string, amount_unit string")
    built, evidence = facts.build_facts(facts.derive(record), spans, spark.createDataFrame(seen, schemas.OBSERVATIONS), documents)
    assert len(exchanges(built)) <= 4 and all("hashpartitioning(doc_id" in line for line in exchanges(built))
    got = {(x["metric"], x["period_id"]): (x["value"], x["evidence_ids"]) for x in built.collect()}
    assert got["revenue", "2023FY"] == (100.0, ["ev_0001"]) and got["revenue", "2022FY"] == (90.0, ["ev_0002"])
    assert got["operating_cost", "2023FY"] == (60.0, ["ev_0001", "ev_0003"]) and got["gross_margin", "2023FY"][1] == ["ev_0003", "ev_0001"]
    assert got["net_profit", "2023Q4_SINGLE"] == (3.0, ["ev_0004"]) and got["net_profit", "2023FY"] == (10.0, ["ev_0004"])
    assert {x["evidence_id"]: x["raw_value"] for x in evidence.collect()} == {"ev_0001": "100.0", "ev_0002": "90.0", "ev_0003": "40.0", "ev_0004": "3.0"}


def test_points_of_a_left_interval_join_are_not_broadcast(spark):
    windows = spark.createDataFrame([(1, 0, 30), (1, 40, 50)], "k int, a int, b int")
    points = spark.range(1000).selectExpr("1 as k", "id", "cast(id % 35 as int) as day")
    joined = intervals.interval_join(windows, points, ["k"], "a", "b", "day", how="left")
    sides = re.findall(r"BroadcastHashJoin .*?(Inner|LeftOuter), (BuildLeft|BuildRight)", joined._jdf.queryExecution().executedPlan().toString())
    assert sides and all(kind == "Inner" for kind, _ in sides)
    assert joined.where("a = 0").count() == sum(k % 35 <= 30 for k in range(1000)) and [r["id"] for r in joined.where("a = 40").collect()] == [None]


def test_daily_requests_read_each_event_once(spark):
    """Events aren't doubled ahead of the count of distinct ones."""
    plan = QUERIES["src15_daily_requests"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("parquet") <= 4  # of what was asked and what was empty, not of events


def test_candidates_are_dealt_evenly_and_judged_once(spark):
    """One file of texts is no single task, and filters don't compute an amount anew."""
    documents = spark.createDataFrame([(1, "In HKD million\nTotal revenue 2,500", "en")], "doc_id long, text string, lang string").coalesce(1)
    best = candidates.best(documents)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Repartition \d+, true|RepartitionByExpression", plan) and plan.count("0{3}") == 1
    assert [(r["field"], r["value"]) for r in best.collect() if r["field"] == "revenue"] == [("revenue", 2500.0)]


def test_copies_of_labels_are_linked_by_classes(spark):
    rows = [(k, "net revenue of the year" if k % 2 else "Net  revenue of the years", "u") for k in range(1, 401)] + [(500, "cash", "u"), (501, "net revenue of the year", "v"), (502, None, "u")]
    got = {r["id"]: (r["class_id"], r["other"], r["band"]) for r in similar.linked_labels(spark.createDataFrame(rows, "id long, label string, unit string"), ["unit"]).collect()}
    assert len(got) == 402 and 502 not in got and got[500] == (500, None, None) and got[501] == (501, None, None)
    assert all(got[k] == ((1, 2, "merge") if k % 2 else (2, 1, "merge")) for k in range(1, 401))


def test_observations_are_dealt_by_size_and_sorted_as_they_are(spark, monkeypatch):
    """Larger inputs make more parts, not larger ones, and what is sorted by value holds none of the structs that the choice is made by."""
    monkeypatch.setattr(staging, "PART_BYTES", 4096)
    for name in ("win2_primary_observation", "win3_comparison_observation"):
        chosen = QUERIES[name](spark, "/root/testdata/sf0.001")
        parts = [int(re.search(r"hashpartitioning\(.*, (\d+)\)", line)[1]) for line in exchanges(chosen) if "REPARTITION_BY_NUM" in line]
        assert parts and all(n == -(-staging.input_bytes(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")) // 4096) for n in parts)
        assert "j#" not in chosen._jdf.queryExecution().optimizedPlan().toString()


def test_row_picks_are_shuffled_once_by_part(spark, monkeypatch):
    """Values and records come dealt by document, in more parts where there is more input; nothing is shuffled after."""
    monkeypatch.setattr(staging, "PART_BYTES", 4096)
    lines = exchanges(QUERIES["agg6_agg7_row_picks"](spark, "/root/testdata/sf0.001"))
    parts = -(-staging.input_bytes(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")) // 4096)
    assert len(lines) == 2 and all(re.search(rf"hashpartitioning\(l_partkey#\d+L, {parts}\), REPARTITION_BY_NUM", line) for line in lines)


def test_cells_stay_where_their_filings_are(spark):
    """No join on the way from cells to observations shuffles cells, nor are rows shuffled to their labels."""
    lines = exchanges(QUERIES["jon8_flt10_flt11_dat6_str8_observations"](spark, "/root/testdata/sf0.001"))
    assert lines and all("REPARTITION_BY_NUM" in line and "hashpartitioning(doc_id" in line for line in lines)


def test_facts_of_filings_send_no_filings_to_the_driver(spark):
    """Only labels and fixed values are broadcast, whatever Spark guesses of files' sizes; no step on the way from cells to facts shuffles cells."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    built = QUERIES["mth3_win8_jon9_agg6_built_facts"](spark, "/root/testdata/sf0.001")
    plan = built._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", plan)
    assert keys and all("doc_id" not in k and "orderkey" not in k for k in keys)
    lines = exchanges(built)
    assert lines and all("REPARTITION_BY_NUM" in line and "hashpartitioning(doc_id" in line for line in lines)


def test_odd_tables_give_what_they_did(spark):
    """A table without a page gives no values but counts among its document's tables; of dates in rows without a number one is read."""
    rows = [(None, 0, [["Balance sheet", "2024"], ["Total assets", "7"]]), (1, 1, [["Notes", "2024"], ["Total assets", "8"]]), (1, 2, [["Income statement", "12/31/2024", "31/12/2023"], ["Revenue", "10", "20"]])]
    cells = [("d", page, t, None if (t, r) == (2, 0) else r, c, cell) for page, t, table in rows for r, row in enumerate(table) for c, cell in enumerate(row)] + [("d", 1, 2, 2, 0, "Net income"), ("d", 1, 2, 2, 1, "3"), ("d", 1, 2, 2, 2, "4")]
    documents = spark.createDataFrame([("d", "en", 2024)], "doc_id string, lang string, fiscal_year int")
    frame = spark.createDataFrame(cells, schemas.CELLS)
    assert sorted((r["metric"], r["value"]) for r in tables.table_values(frame, documents).collect()) == [("net_profit", 3.0), ("revenue", 10.0)]
    assert {(r["metric"], r["value"]) for r in tables.observations(frame, documents).collect()} == {("total_assets", 8.0), ("revenue", 10.0), ("revenue", 20.0), ("net_profit", 3.0), ("net_profit", 4.0)}


def test_quality_of_filings_sends_no_filings_to_the_driver(spark):
    plan = QUERIES["agg9_jon11_arr5_quality_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all("doc_id" not in k for k in re.findall(r"Broadcast\w*Join \[([^\]]*)\]", plan)) and "SortMergeJoin" in plan


def test_conversations_are_packed_many_to_a_file(spark, tmp_path, monkeypatch):
    """Not a file for each conversation; what a page holds doesn't matter."""
    monkeypatch.setattr(mechanism_queries, "shared_folder", lambda _: str(tmp_path))
    odd = {-7: ["a\fb\\", None, "\\N"], 1: [""], 2: ["x", "y"]}
    said = odd | {k: [f"{k}-{turn}" for turn in range(k % 5 + 1)] for k in range(3, 300)}
    rows = [(k, turn, text) for k, texts in said.items() for turn, text in enumerate(texts)]
    spark.createDataFrame([*rows, (None, 0, "no")], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/in/conversations.parquet")
    got = QUERIES["src17_pages_asked"](spark, f"{tmp_path}/in").collect()
    assert len([f for at in tmp_path.glob("pages-*") for f in at.rglob("*") if f.suffix in (".parquet", ".txt")]) <= spark.sparkContext.defaultParallelism
    want = [(str(k), n + 1, len(texts), texts[n]) for k, texts in said.items() for n in (0, 2) if n < len(texts)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_small_files_are_dealt_to_many_tasks(tmp_path):
    for k in range(600):
        (tmp_path / f"{k}.txt").write_text("a")
    parts = paged.PagedReader({"path": str(tmp_path), "pattern": "*.txt", "partitionBytes": 100 * paged.OPEN_BYTES}).partitions()
    assert len(parts) >= 6 and sum(len(p.paths) for p in parts) == 600
