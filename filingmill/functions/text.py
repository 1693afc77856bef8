"""Titles, labels, names and addresses of filings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import stripped


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def normalized_label(text: Column) -> Column:
    """Lower case, single spaces, plain brackets and dashes."""
    return F.translate(F.lower(F.regexp_replace(stripped(text), r"[\s　 ]+", " ")), "（）–—", "()--")


def sanitized(text: Column) -> Column:
    """Without the characters that shells and pages give meaning to, at most 200 long; '' for null."""
    return F.coalesce(F.substring(stripped(F.translate(text, "<>;&|$`\n\r\t", "")), 1, 200), F.lit(""))


def safe_file_name(name: Column) -> Column:
    """Without the characters that file systems forbid."""
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "")


def clean_name(name: Column) -> Column:
    """A company name without markup, white space and forbidden characters."""
    return safe_file_name(F.regexp_replace(F.regexp_replace(name, "<[^>]+>", ""), r"[\s　]+", ""))


# Titles of abridged or superseded versions; notices that are no report.
SUMMARY_WORDS = ["摘要", "提要", "正文的公告", "更正公告", "补充公告", "修订说明", "英文版", "english", "已取消"]
NOTICE_WORDS = ["date of board meeting", "board meeting", "notice to investors", "announcement date", "董事會召開日期", "董事会召开日期", "董事會會議日期", "董事会会议日期", "investor notice"]
HALF_YEAR_WORDS = ["中期", "半年", "interim", "half year", "half-year", "six months"]
TYPE_WORDS = {
    "annual": ["年報", "年度報告", "annual report", "annual results"],
    "semi_annual": ["中期報告", "中期業績", "interim report", "interim results", "half year", "half-year", "six months", "six-month", "h1", "1h"],
    "results": ["業績公告", "全年業績", "results announcement"],
}
QUARTER_WORDS = r"\bq[1-4]\b|\b[1-4]q\b|(first|second|third|fourth) quarter|(three|nine) months|quarterly (results|report)|第?[一二三四]季度"


def is_summary(title: Column) -> Column:
    return contains_any(F.lower(title), SUMMARY_WORDS)


def matches_type(title: Column, report_type: str) -> Column:
    """Whether a title is a report of the type: notices aren't, and half-year words rule out annual ones."""
    low = F.lower(title)
    if report_type == "quarterly":
        kind = ~low.contains("overseas regulatory announcement") & low.rlike(QUARTER_WORDS)
    else:
        kind = contains_any(low, TYPE_WORDS.get(report_type, ["\0"]))
        if report_type == "annual":
            kind = ~contains_any(low, HALF_YEAR_WORDS) & kind
    return ~contains_any(low, NOTICE_WORDS) & kind


# Title words of the kinds of mainland filings.
_KINDS = [
    ("semi_annual", ["半年度报告", "半年报", "中报", "semi-annual"]),
    ("annual", ["年度报告", "年报", "annual report"]),
    ("quarterly_1", ["第一季度报告", "一季度报告", "一季报", "first quarter"]),
    ("quarterly_3", ["第三季度报告", "三季度报告", "三季报", "third quarter"]),
    ("quarterly", ["季度报告", "季报", "quarterly"]),
]


def filing_kind(title: Column, parity: bool = False) -> Column:
    """annual, semi_annual, quarterly_1, quarterly_3, quarterly or other.

    The half-year words hold the annual ones; `parity` asks for the annual ones first, which files half-year reports as annual.
    """
    order = [_KINDS[1], _KINDS[0], *_KINDS[2:]] if parity else _KINDS
    return F.coalesce(*(F.when(contains_any(title, words), kind) for kind, words in order), F.lit("other"))


# The friendly names of filings, in the order in which they are tried.
_FRIENDLY = [
    ("半年度报告摘要", ["半年度报告摘要", "中报摘要"]), ("半年度报告", ["半年度报告", "中报"]), ("年度报告摘要", ["年度报告摘要", "年报摘要"]), ("年度报告", ["年度报告", "年报"]),
    ("第三季度报告", ["第三季度报告", "三季报"]), ("第一季度报告", ["第一季度报告", "一季报"]), ("季度报告", ["季度报告", "季报"]),
    ("业绩预告", ["业绩预告"]), ("业绩快报", ["业绩快报"]), ("临时公告", ["临时公告"]),
]


def friendly_kind(title: Column, parity: bool = False) -> Column:
    order = [_FRIENDLY[2], _FRIENDLY[3], _FRIENDLY[0], _FRIENDLY[1], *_FRIENDLY[4:]] if parity else _FRIENDLY
    return F.coalesce(*(F.when(contains_any(F.lower(title), words), name) for name, words in order), F.lit("其他公告"))


def file_name(title: Column, year: Column, as_of: str) -> Column:
    """`year_kind.pdf`, at most 150 characters before the ending; as_of (yyyyMMdd) stands in for a missing year."""
    name = F.concat(F.coalesce(year.cast("string"), F.lit(as_of)), F.lit("_"), friendly_kind(title), F.lit(".pdf"))
    return F.when(F.length(name) > 150, F.concat(F.substring(name, 1, 150), F.lit(".pdf"))).otherwise(name)


def quarter_number(text: Column) -> Column:
    """1 to 4, the first quarter that is named."""
    low = F.lower(text)
    names = [("first", "一"), ("second", "二"), ("third", "三"), ("fourth", "四")]
    return F.coalesce(*(F.when(low.rlike(rf"\bq{k}\b|\b{k}q\b|{en} quarter|第?{zh}季度"), k) for k, (en, zh) in enumerate(names, 1)))


def report_identity(text: Column) -> Column:
    """struct<report_type,doc_type,period_type> by the head of a filing: half-year words first, then quarters, then annual ones."""
    head = F.substring(text, 1, 10000)
    low = F.lower(head)
    results = low.contains("results announcement") | contains_any(head, ["業績公告", "业绩公告"])
    full_year = contains_any(low, ["full year", "year ended"]) | contains_any(head, ["全年", "年度"])
    quarter = quarter_number(head)
    quarterly = quarter.isNotNull() | low.contains("quarterly") | contains_any(head, ["季度报告", "季度業績", "季报"])
    interim = contains_any(low, ["interim report", "interim results", "half-year", "half year", "six months"]) | contains_any(head, ["中期報告", "半年度报告", "中期业绩"])
    annual = low.contains("annual report") | contains_any(head, ["年度报告", "年報", "年报"])
    annual_results = low.contains("annual results") | contains_any(head, ["全年業績", "全年业绩"])
    say = lambda a, b, c: F.struct(F.lit(a).cast("string").alias("report_type"), F.lit(b).cast("string").alias("doc_type"), F.lit(c).cast("string").alias("period_type"))
    return (
        F.when(interim, say("semi_annual", "interim_report", "semi_annual"))
        .when(quarterly & F.coalesce(quarter == 4, F.lit(False)) & full_year, say("quarterly", "results_announcement", "full_year_in_quarterly_announcement"))
        .when(quarterly & results, say("quarterly", "results_announcement", "quarter"))
        .when(quarterly, say("quarterly", "quarterly_report", "quarter"))
        .when(annual, say("annual", "annual_report", "annual"))
        .when(annual_results, say("annual", "results_announcement", "annual"))
        .otherwise(say(None, None, None))
    )


def period_label(title: Column, report_type: Column) -> Column:
    """q1 to q4 of a quarterly title, q4_fy where it covers the year as well."""
    quarter = F.concat(F.lit("q"), quarter_number(title).cast("string"))
    whole = contains_any(F.lower(title), ["full year", "全年", "年度", "annual results", "year ended"])
    return F.when(report_type == "quarterly", F.when((quarter == "q4") & whole, "q4_fy").otherwise(quarter))


def period_hint(title: Column, report_type: Column, year: Column) -> Column:
    """`2025_q3`, `2025_fy`, `2025_h1`, or the label alone without a year."""
    label = period_label(title, report_type)
    end = F.coalesce(label, F.when(report_type == "annual", "fy").when(report_type == "semi_annual", "h1"))
    return F.when(year.isNotNull(), F.concat_ws("_", year.cast("string"), end)).otherwise(label)


def is_cjk_title(title: Column) -> Column:
    return title.rlike("[的是在有年月日報告公司股份]")


def title_language(title: Column, path: Column) -> Column:
    return F.when(is_cjk_title(title) | path.contains("_c."), "zh").otherwise("en")


def english_url(url: Column) -> Column:
    return F.when(url.endswith("_c.pdf"), F.replace(url, F.lit("_c.pdf"), F.lit(".pdf"))).when(url.contains("_c."), F.replace(url, F.lit("_c."), F.lit(".")))


def chinese_url(url: Column) -> Column:
    return F.when(~url.contains("_c.") & url.endswith(".pdf"), F.replace(url, F.lit(".pdf"), F.lit("_c.pdf")))


# Exchanges by the first three digits of a code.
EXCHANGES = {"sz": ["000", "001", "002", "003"], "szcy": ["300"], "sh": ["600", "601", "603", "605"], "shkcp": ["688"], "bj": ["430", *(str(n) for n in range(831, 840))]}


def exchange(code: Column) -> Column:
    head = F.substring(code, 1, 3)
    return F.coalesce(*(F.when(head.isin(codes), name) for name, codes in EXCHANGES.items()), F.lit("unknown"))


def padded_code(code: Column, size: int = 5) -> Column:
    """With noughts in front up to the size; longer codes stay whole."""
    return F.when(F.length(code) < size, F.lpad(code, size, "0")).otherwise(code)


def language_vote(text: Column, name: Column, english: list[str], chinese: list[str]) -> Column:
    """en if the file name says so, or if strictly more of the English words stand in the text than of the Chinese."""
    low = F.lower(name)
    hits = lambda words: reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words))
    named = low.contains("_en.") | low.contains("_en_") | low.contains("english")
    return F.when(F.coalesce(named, F.lit(False)) | F.coalesce(hits(english) > hits(chinese), F.lit(False)), "en").otherwise("zh")


# The words whose presence is counted for a filing's language.
ENGLISH_WORDS = ["Revenue", "Net Profit", "Total Assets", "Total Liabilities", "Cash Flow", "Finance Costs", "Equity"]
CHINESE_WORDS = ["营业收入", "净利润", "资产总计", "负债合计", "现金流量", "财务费用", "股东权益"]


def audited(text: Column) -> Column:
    """false if the head says unaudited, true if it says audited, else null."""
    low = F.lower(F.substring(text, 1, 10000))
    return F.when(contains_any(low, ["unaudited", "未經審核", "未经审计"]), False).when(contains_any(low, ["audited", "經審核", "经审计"]), True)


def schema_version(query: Column, header: Column, accept: Column) -> Column:
    """v1 or v2: the query's wish, then the header's, then the Accept line's; v2 otherwise."""
    wish = lambda c: F.when(c.isin("v1", "v2"), c)
    spoken = F.when(F.lower(accept).contains("v1"), "v1").when(F.lower(accept).contains("v2"), "v2")
    return F.coalesce(wish(query), wish(header), spoken, F.lit("v2"))


def report_types(types: Column) -> Column:
    """The wished types, or all three if none or `all` is among them."""
    every = F.array(F.lit("annual"), F.lit("semi_annual"), F.lit("quarterly"))
    given = F.filter(types, lambda t: t.isNotNull() & (t != ""))
    return F.when(types.isNull() | (F.size(given) == 0) | F.array_contains(given, "all"), every).otherwise(given)


def type_folder(report_type: Column) -> Column:
    return F.when(report_type.startswith("quarterly"), "quarterly").when(report_type.isin("annual", "semi_annual"), report_type).otherwise("other")


def search_url(base: str, keyword: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(keyword))


def line_of(text: Column, start: Column, end: Column) -> Column:
    """The line round a place (0-based, end exclusive)."""
    before, after = F.substring(text, F.lit(1), start), text.substr(end + 1, F.length(text))
    return F.concat(F.substring_index(before, "\n", -1), text.substr(start + 1, end - start), F.substring_index(after, "\n", 1))


def currency_of(text: Column) -> Column:
    """The first currency named: USD, HKD or CNY."""
    found = F.lower(F.regexp_extract(text, r"(?i)(US\$|HK\$|USD|HKD|RMB|CNY|人民币|港元|美元)", 1))
    return F.when(found.isin("us$", "usd", "美元"), "USD").when(found.isin("hk$", "hkd", "港元"), "HKD").when(found.isin("rmb", "cny", "人民币"), "CNY")


def amount_unit(text: Column, parity: bool = False) -> Column:
    """million, billion or none. parity: `mn` counts even inside another word."""
    thousands = text.rlike(r"(?i)(US\$|HK\$|USD|HKD|RMB|CNY)[’'` ]?0{3}|(人民币|港元|美元)\s*(千元|千)")
    unit = F.lower(F.regexp_extract(text, r"(?i)(million|mn|billion|百万|亿|千)" if parity else r"(?i)(\bmillion\b|\bmn\b|\bbillion\b|百万|亿|千)", 1))
    return F.when(thousands | unit.isin("million", "mn", "百万"), "million").when(unit.isin("billion", "亿"), "billion").otherwise("none")


def stock_code(text: Column, path: Column, lang: Column) -> Column:
    """From the head of the text, else from the path."""
    head = F.substring(text, 1, 20000)
    hk = F.nullif(F.regexp_extract(head, r"(?i)\b(?:HKEX|Stock\s+Codes?)\s*[:：]\s*0?(\d{4,5})\b", 1), F.lit(""))
    cn = F.nullif(F.regexp_extract(text, r"证券代码[：:\s]*(\d{6})", 1), F.lit(""))
    of_path = F.nullif(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"/(?:hk_stocks|cn_stocks)/(\d{5,6})(?:/|$)", 1), F.lit(""))
    return F.coalesce(F.when(lang == "en", padded_code(hk)).otherwise(cn), of_path)
