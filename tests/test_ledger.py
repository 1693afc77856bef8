"""Small filings through the whole extraction."""

from __future__ import annotations

import pytest

from filingmill import schemas
from filingmill.engine import Ledger


def run(spark, text, tables, name="2025_annual_en.pdf"):
    pages = spark.createDataFrame([("d", name, k, t) for k, t in enumerate(text if isinstance(text, list) else [text], 1)], schemas.PAGES)
    cells = [("d", page, t, r, c, cell) for t, (page, table) in enumerate(tables, 1) for r, row in enumerate(table) for c, cell in enumerate(row)]
    return Ledger().extract(pages, spark.createDataFrame(cells, schemas.CELLS))


def values(x):
    return {(r["metric"], r["period_id"]): r for r in x.facts.collect()}


COMPARISON = [
    (1, [["Consolidated income statement", "Year ended Dec 31, 2025", "Year ended Dec 31, 2024"], ["Total revenues", "11,300", "10,820"], ["Net income", "900", "850"]]),
    (2, [["Cash flow statement", "Year ended Dec 31, 2025", "Year ended Dec 31, 2024"], ["Net cash provided by operating activities", "1,200", "1,100"]]),
]


@pytest.fixture(scope="module")
def annual(spark):
    return run(spark, "Annual report 2025. Year ended December 31, 2025. USD million.", COMPARISON)


def test_comparison_facts(annual):
    f = values(annual)
    assert [f[m, "2024FY"]["value"] for m in ("revenue", "net_profit", "operating_cash_flow")] == [10820, 850, 1100]
    assert [f[m, "2025FY"]["value"] for m in ("revenue", "net_profit", "operating_cash_flow")] == [11300, 900, 1200]
    assert all(r["evidence_ids"] for r in f.values())
    assert annual.evidence.count() >= 6
    assert f["revenue", "2025FY"]["confidence"] == 0.96 and f["revenue", "2024FY"]["confidence"] == 0.95


def test_quality_is_ok_and_units(annual):
    q = annual.quality.first()
    assert (q["status"], q["issues"]) == ("ok", [])
    f = values(annual)
    assert (f["revenue", "2025FY"]["currency"], f["revenue", "2025FY"]["unit"]) == ("USD", "million")
    assert (f["net_margin", "2025FY"]["currency"], f["net_margin", "2025FY"]["unit"]) == (None, "percent")


def test_derived_inherits_evidence(annual):
    f = values(annual)
    margin = f["net_margin", "2025FY"]
    assert margin["source_method"] == "derived" and margin["confidence"] == 1.0 and len(margin["evidence_ids"]) == 2
    assert margin["value"] == 7.96


def test_low_confidence_is_cut(annual):
    cut = annual.confident(0.96)
    assert ("revenue", "2024FY") not in values(cut)
    q = cut.quality.first()
    assert q["status"] == "partial" and q["issues"][-1]["type"] == "confidence_filtered" and "income_statement.revenue@2024FY" in q["issues"][-1]["affected_facts"]


def test_year_to_date_column_is_preferred(spark):
    table = [["Income statement", "Three months ended Sep 30, 2025", "Nine months ended Sep 30, 2025"], ["Total revenues", "3,000", "9,000"]]
    x = run(spark, "2025 third quarter results announcement, nine months ended Sep 30, 2025", [(1, table)], "2025_quarterly_q3_en.pdf")
    f = values(x)
    assert f["revenue", "2025Q3_YTD"]["value"] == 9000 and f["revenue", "2025Q3_SINGLE"]["value"] == 3000
    assert {r["column_role"] for r in x.evidence.collect()} == {"ytd", "single_q"}


def test_noncontrolling_rows_are_no_profit(spark):
    table = [["Income statement", "Year ended Dec 31, 2025"], ["Net income attributable to noncontrolling interests", "100"], ["Net income attributable to shareholders", "900"]]
    f = values(run(spark, "Annual report 2025", [(1, table)]))
    assert f["net_profit_attributable_to_parent", "2025FY"]["value"] == 900


def test_segment_tables_are_skipped(spark):
    x = run(spark, "Annual report 2025 revenue 5,000 million", [(3, [["Segment Results", "2025"], ["Total revenues", "9,999"]])])
    assert "segment_table_skipped" in [i["type"] for i in x.quality.first()["issues"]]
    assert values(x)["revenue", "2025FY"]["value"] == 5000 and values(x)["revenue", "2025FY"]["source_method"] == "text_regex"


def test_cross_check(spark):
    table = [["Income statement", "Year ended Dec 31, 2025"], ["Net income", "1,000"]]
    metrics = [["Financial highlights", "Year ended Dec 31, 2025"], ["Basic earnings per share", "1.0"], ["Total shares in issue", "500"]]
    x = run(spark, "Annual report 2025", [(1, table), (1, metrics)])
    assert "cross_check_failed" in [i["type"] for i in x.quality.first()["issues"]]


def test_chinese_tables(spark):
    tables = [(1, [["合并损益表", "2025年度"], ["营业收入", "100,000,000"]]), (2, [["资产负债表", "2025年度"], ["资产总计", "500,000,000"], ["负债合计", "300,000,000"]])]
    f = values(run(spark, "证券代码：600000 2025 年度报告", tables, "2025_annual.pdf"))
    assert f["revenue", "2025FY"]["value"] == 1e8 and f["total_assets", "BS_2025-12-31"]["value"] == 5e8
    assert f["debt_ratio", "2025FY"]["value"] == 60.0


def test_no_period_no_facts(spark):
    x = run(spark, "Nothing to classify here", [(1, [["Income statement", "2025"], ["Total revenues", "5,000"]])], "x_en.pdf")
    assert x.facts.count() == 0 and x.periods.count() == 0
