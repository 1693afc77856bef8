from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from filingmill.functions import arrays, dates, numbers, text, validators
from filingmill.operators.candidates import score, suspicious


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,want",
    [("1,234,567.89", 1234567.89), ("-1,234,567", -1234567), ("1，234，567", 1234567), ("  123456 ", 123456), ("－5", -5), ("１２", 12), ("1e5", 100000), ("abc", None), ("N/A", None), ("-", None), ("", None), (None, None), ("12.5%", None), ("100万", None), ("(1,234)", None), ("12d", None), ("nan", None), ("1_0", None)],
)
def test_parse_number(spark, raw, want):
    assert value(spark, numbers.parse_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("$1,200", (1200.0, None)), ("12%", (12.0, None)), ("--", (None, "")), ("None", (None, "")), (None, (None, "")), ("abc", (None, "abc"))])
def test_lenient_number(spark, raw, want):
    x = value(spark, numbers.lenient_number(F.lit(raw).cast("string")))
    assert (x["num"], x["raw"]) == want


@pytest.mark.parametrize("spec,want", [("1-3,5", [1, 2, 3, 5]), ("2,2,1", [1, 2]), ("7-", list(range(7, 10008))), ("0", None), ("5-2", None), ("-3", None), ("", None), ("x", None), (" 1 , 2 - 3 ", [1, 2, 3]), ("99999999999", None)])
def test_page_ranges(spark, spec, want):
    assert value(spark, arrays.page_ranges(F.lit(spec))) == want


@pytest.mark.parametrize(
    "symbol,market,want",
    [("000001", "CN", []), ("00001", "CN", ["symbol_format_cn"]), ("00700", "HK", []), ("AAPL", "US", []), (" aapl ", "us", []), ("TOOLONG", "US", ["symbol_format_us"]), ("", "CN", ["symbol_missing"]), ("1", "XX", ["market_unknown"]), ("1", None, ["market_unknown"])],
)
def test_symbols(spark, symbol, market, want):
    assert value(spark, validators.symbol_errors(F.lit(symbol), F.lit(market).cast("string"))) == want


@pytest.mark.parametrize(
    "start,end,want",
    [("2020-01-01", "2021-01-01", []), ("2021-01-01", "2020-01-01", ["start_after_end"]), ("2020-13-01", None, ["start_format"]), (None, "x", ["end_format"]), ("2000-01-01", "2021-01-01", ["range_too_long"]), (None, None, []), ("2023-02-30", None, ["start_format"])],
)
def test_date_ranges(spark, start, end, want):
    assert value(spark, validators.date_range_errors(F.lit(start).cast("string"), F.lit(end).cast("string"))) == want


@pytest.mark.parametrize("keyword,want", [("ok", []), ("x" * 51, ["keyword_too_long"]), ("  ", ["keyword_missing"]), (None, ["keyword_missing"]), ("a<b", ["keyword_unsafe"]), ("x;" * 30, ["keyword_too_long", "keyword_unsafe"])])
def test_keywords(spark, keyword, want):
    assert value(spark, validators.keyword_errors(F.lit(keyword).cast("string"))) == want


def test_years_types_and_records(spark):
    assert value(spark, validators.years_errors(F.array(F.lit(1980), F.lit(2020)), 2024)) == ["year_out_of_range"]
    assert value(spark, validators.years_errors(F.array(*[F.lit(2000)] * 11), 2024)) == ["too_many_years"]
    assert value(spark, validators.type_errors(F.lit("weekly"))) == ["type_unknown"] and value(spark, validators.market_errors(F.lit("hk"))) == []
    row = F.array(F.struct(F.lit(None).cast("string").alias("report_date")))
    assert value(spark, validators.record_errors(F.lit("x"), F.lit(None), F.lit("s"), row)) == ["statement_missing", "report_date_missing"]


@pytest.mark.parametrize(
    "method,params,want",
    [("search_x", {"keyword": "a<"}, ["keyword_unsafe"]), ("get_x", {"symbol": "1", "market": "HK", "year": "1900"}, ["symbol_format_hk", "year_too_early"]), (None, {}, ["method_missing"]), ("get_x", {}, []), ("other", {"keyword": "<"}, [])],
)
def test_requests(spark, method, params, want):
    df = spark.createDataFrame([(method, params)], "m string, p map<string,string>")
    assert df.select(validators.request_errors(F.col("m"), F.col("p"), 2024).alias("e")).first()["e"] == want


def test_times(spark):
    assert value(spark, dates.hk_time(F.lit("Release Time:04/02/2026 19:21"))) == dt.datetime(2026, 2, 4, 19, 21)
    assert value(spark, dates.hk_time(F.lit("04/02/2026"))) == dt.datetime(2026, 2, 4) and value(spark, dates.hk_time(F.lit("soon"))) is None
    assert value(spark, dates.cn_time(F.lit("1700000000000"), F.lit(None).cast("string"))) == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert value(spark, dates.cn_time(F.lit("n/a"), F.lit("2024-05-06"))) == dt.datetime(2024, 5, 6)


@pytest.mark.parametrize(
    "body,want",
    [
        ("2025 Interim Report, six months", ("semi_annual", "interim_report", "semi_annual")), ("2025 Q4 and full year results", ("quarterly", "results_announcement", "full_year_in_quarterly_announcement")),
        ("Q3 results announcement", ("quarterly", "results_announcement", "quarter")), ("第一季度报告", ("quarterly", "quarterly_report", "quarter")), ("Annual Report", ("annual", "annual_report", "annual")),
        ("annual results", ("annual", "results_announcement", "annual")), ("hello", (None, None, None)),
    ],
)
def test_report_identity(spark, body, want):
    assert tuple(value(spark, text.report_identity(F.lit(body)))) == want


@pytest.mark.parametrize("title,want,parity", [("2023年半年度报告", "semi_annual", "annual"), ("2023年年度报告", "annual", "annual"), ("2023年第一季度报告", "quarterly_1", "quarterly_1"), ("公告", "other", "other")])
def test_filing_kinds(spark, title, want, parity):
    assert value(spark, text.filing_kind(F.lit(title))) == want and value(spark, text.filing_kind(F.lit(title), parity=True)) == parity


def test_titles(spark):
    t = lambda title, kind: value(spark, text.matches_type(F.lit(title), kind))
    assert t("2023 Annual Report", "annual") and not t("2023年半年度報告", "annual") and not t("Date of Board Meeting, Annual Report", "annual")
    assert t("Third Quarter 2024", "quarterly") and not t("Overseas Regulatory Announcement Q3", "quarterly") and t("中期報告", "semi_annual")
    hint = lambda title, kind, year: value(spark, text.period_hint(F.lit(title), F.lit(kind), F.lit(year)))
    assert hint("Q4 and Full Year", "quarterly", 2025) == "2025_q4_fy" and hint("x", "annual", 2025) == "2025_fy" and hint("x", "semi_annual", 2024) == "2024_h1"


@pytest.mark.parametrize("args,want", [(("v1", "v2", "x"), "v1"), ((None, "v1", None), "v1"), ((None, None, "application/vnd.v1+json"), "v1"), (("v9", None, None), "v2")])
def test_schema_versions(spark, args, want):
    assert value(spark, text.schema_version(*(F.lit(a).cast("string") for a in args))) == want


def test_metadata(spark):
    assert value(spark, text.amount_unit(F.lit("column of figures"))) == "none" and value(spark, text.amount_unit(F.lit("column"), parity=True)) == "million"
    assert value(spark, text.amount_unit(F.lit("in RMB'000"))) == "million" and value(spark, text.currency_of(F.lit("HK$ m"))) == "HKD"
    assert value(spark, text.stock_code(F.lit("Stock Code: 700"), F.lit("/a/hk_stocks/00005/x.pdf"), F.lit("en"))) == "00005"
    assert value(spark, text.stock_code(F.lit("Stock Code: 0700"), F.lit(""), F.lit("en"))) == "00700"
    assert value(spark, text.line_of(F.lit("ab\ncde f\ng"), F.lit(4), F.lit(6))) == "cde f"


@pytest.mark.parametrize("line,field,v,want", [("11. PROFIT FOR THE YEAR 11.", "net_profit", 11.0, True), ("Revenue 3 12,000 11,000", "revenue", 3.0, True), ("Gross revenue 5,000", "revenue", 5000.0, True), ("Earnings per share 4,708", "eps", 4708.0, True), ("Total revenue 5,000", "revenue", 5000.0, False)])
def test_suspicious_matches(spark, line, field, v, want):
    assert value(spark, suspicious(F.lit(field), F.lit(line), F.lit(line), F.lit(v))) is want


def test_scores(spark):
    s = lambda field, raw, v, near: value(spark, score(F.lit(field), F.lit(raw), F.lit(v), F.lit(near)))
    assert s("revenue", "5,000", 5000.0, "x total revenue in RMB million") == 6 and s("eps", "0.87", 0.87, "non-ifrs note 3") == -1


@pytest.mark.parametrize("near,want", [("in RMB'000", 0.001), ("US$ billion", 1000.0), ("thousand", 0.001), ("rmb million", 1.0)])
def test_unit_multipliers(spark, near, want):
    assert value(spark, numbers.unit_multiplier(F.lit("x"), F.lit(near))) == want


def test_cosine_and_bands(spark):
    a = lambda *xs: F.array(*(F.lit(float(x)) for x in xs))
    assert value(spark, numbers.cosine(a(1, 0), a(1, 0))) == 1.0 and value(spark, numbers.cosine(a(0, 0), a(1, 0))) is None
    assert [value(spark, numbers.similarity_band(F.lit(x))) for x in (0.95, 0.9, 0.7)] == ["merge", "review", "keep_apart"]
