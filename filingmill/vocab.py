"""Dimension data of the library: keywords, rules and formulas that operators join or match with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INCOME, BALANCE, CASH, METRICS = "income_statement", "balance_sheet", "cash_flow_statement", "financial_metrics"

# The fields of the four statements, in the order in which facts are built.
FIELDS = {
    INCOME: ["revenue", "operating_cost", "gross_profit", "operating_profit", "total_profit", "net_profit", "net_profit_attributable_to_parent", "net_profit_deducted", "interest_expense", "rd_expense", "gross_margin", "net_margin"],
    BALANCE: ["total_assets", "current_assets", "cash_and_equivalents", "accounts_receivable", "inventory", "fixed_assets", "goodwill", "intangible_assets", "total_liabilities", "current_liabilities", "short_term_debt", "long_term_debt", "bonds_payable", "total_equity", "equity_attributable_to_parent"],
    CASH: ["operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "capital_expenditure", "free_cash_flow"],
    METRICS: ["eps", "eps_diluted", "bps", "dividend_per_share", "roe", "roa", "debt_ratio", "current_ratio", "quick_ratio", "total_shares"],
}
SPECS = [(seq, statement, metric) for seq, (statement, metric) in enumerate((s, m) for s, ms in FIELDS.items() for m in ms)]
STATEMENT_OF = {metric: statement for _, statement, metric in SPECS}

# Units by metric, and metrics that may be smaller than 1.
UNIT_OF = {m: "percent" for m in ("gross_margin", "net_margin", "roe", "roa", "debt_ratio")} | {m: "ratio" for m in ("current_ratio", "quick_ratio")} | {m: "per_share" for m in ("eps", "eps_diluted", "bps", "dividend_per_share")} | {"total_shares": "shares"}
NO_FLOOR = sorted(m for m, unit in UNIT_OF.items() if unit != "shares")

# What each derived metric is computed from.
FORMULAS = {
    "operating_cost": ("operating_cost = revenue - gross_profit", ["revenue", "gross_profit"]),
    "gross_profit": ("gross_profit = revenue - operating_cost", ["revenue", "operating_cost"]),
    "gross_margin": ("gross_margin = gross_profit / revenue * 100", ["gross_profit", "revenue"]),
    "net_margin": ("net_margin = net_profit / revenue * 100", ["net_profit", "revenue"]),
    "debt_ratio": ("debt_ratio = total_liabilities / total_assets * 100", ["total_liabilities", "total_assets"]),
    "current_ratio": ("current_ratio = current_assets / current_liabilities", ["current_assets", "current_liabilities"]),
    "quick_ratio": ("quick_ratio = (current_assets - inventory) / current_liabilities", ["current_assets", "inventory", "current_liabilities"]),
    "roa": ("roa = net_profit / total_assets * 100", ["net_profit", "total_assets"]),
    "roe": ("roe = net_profit / equity * 100", ["net_profit", "total_equity"]),
    "free_cash_flow": ("free_cash_flow = operating_cash_flow - capital_expenditure", ["operating_cash_flow", "capital_expenditure"]),
    "bps": ("bps = total_equity / total_shares", ["total_equity", "total_shares"]),
    "total_shares": ("total_shares = net_profit / eps", ["net_profit", "eps"]),
}

#: Row labels by language and metric, our own choice of usual names.
LABELS = {
    "en": {
        "revenue": ["total revenues", "revenue", "turnover", "net sales"], "operating_cost": ["cost of sales", "cost of revenue"], "gross_profit": ["gross profit"],
        "operating_profit": ["operating profit", "profit from operations"], "total_profit": ["profit before tax", "income before tax"], "net_profit": ["net income", "net profit", "profit for the year", "profit for the period"],
        "net_profit_attributable_to_parent": ["profit attributable to", "net income attributable to"], "interest_expense": ["finance costs", "interest expense"], "rd_expense": ["research and development"],
        "total_assets": ["total assets"], "current_assets": ["total current assets"], "cash_and_equivalents": ["cash and cash equivalents"], "accounts_receivable": ["trade receivables", "accounts receivable"],
        "inventory": ["inventories", "inventory"], "fixed_assets": ["property, plant and equipment"], "goodwill": ["goodwill"], "intangible_assets": ["intangible assets"], "total_liabilities": ["total liabilities"],
        "current_liabilities": ["total current liabilities"], "short_term_debt": ["short-term borrowings"], "long_term_debt": ["long-term borrowings"], "bonds_payable": ["bonds payable"], "total_equity": ["total equity"],
        "equity_attributable_to_parent": ["equity attributable to owners"], "operating_cash_flow": ["net cash provided by operating activities", "net cash from operating activities"],
        "investing_cash_flow": ["net cash used in investing activities"], "financing_cash_flow": ["net cash used in financing activities"], "capital_expenditure": ["capital expenditures", "capital expenditure"],
        "eps": ["basic earnings per share", "earnings per share"], "eps_diluted": ["diluted earnings per share"], "bps": ["net assets per share"], "dividend_per_share": ["dividend per share"],
        "roe": ["return on equity"], "current_ratio": ["current ratio"], "quick_ratio": ["quick ratio"], "total_shares": ["total shares in issue"],
    },
    "zh": {
        "revenue": ["营业收入", "营业总收入"], "operating_cost": ["营业成本"], "gross_profit": ["毛利"], "operating_profit": ["营业利润"], "total_profit": ["利润总额"], "net_profit": ["净利润"],
        "net_profit_attributable_to_parent": ["归属于母公司股东的净利润"], "net_profit_deducted": ["扣非净利润"], "interest_expense": ["财务费用"], "rd_expense": ["研发费用"], "total_assets": ["资产总计"],
        "current_assets": ["流动资产合计"], "cash_and_equivalents": ["货币资金"], "accounts_receivable": ["应收账款"], "inventory": ["存货"], "fixed_assets": ["固定资产"], "goodwill": ["商誉"], "intangible_assets": ["无形资产"],
        "total_liabilities": ["负债合计"], "current_liabilities": ["流动负债合计"], "short_term_debt": ["短期借款"], "long_term_debt": ["长期借款"], "bonds_payable": ["应付债券"], "total_equity": ["所有者权益合计"],
        "operating_cash_flow": ["经营活动产生的现金流量净额"], "investing_cash_flow": ["投资活动产生的现金流量净额"], "financing_cash_flow": ["筹资活动产生的现金流量净额"], "capital_expenditure": ["购建固定资产"],
        "eps": ["基本每股收益"], "eps_diluted": ["稀释每股收益"], "bps": ["每股净资产"], "dividend_per_share": ["每股股利"], "roe": ["净资产收益率"], "current_ratio": ["流动比率"], "quick_ratio": ["速动比率"], "total_shares": ["总股本"],
    },
}

#: What running text calls fields, besides row labels; our own choice, in lower case.
TEXT_NAMES = {
    "en": {
        "revenue": ["total revenue"], "operating_cost": ["cost of goods sold"], "operating_profit": ["operating income"], "total_profit": ["profit before taxation", "profit before income tax"],
        "net_profit_deducted": ["net profit excluding non-recurring items"], "interest_expense": ["interest expenses"], "rd_expense": ["r&d expenses", "r&d expense"], "gross_margin": ["gross margin", "gross profit margin"],
        "net_margin": ["net margin", "net profit margin"], "accounts_receivable": ["trade and notes receivables"], "fixed_assets": ["fixed assets"], "short_term_debt": ["short-term loans", "short-term debt"],
        "long_term_debt": ["long-term loans", "long-term debt"], "total_equity": ["shareholders' equity", "shareholders’ equity"], "operating_cash_flow": ["net cash generated from operating activities", "cash generated from operating activities"],
        "investing_cash_flow": ["net cash from investing activities"], "financing_cash_flow": ["net cash from financing activities"], "free_cash_flow": ["free cash flow"], "eps_diluted": ["diluted eps"],
        "bps": ["book value per share"], "dividend_per_share": ["dividends per share"], "roa": ["return on assets", "return on total assets"], "debt_ratio": ["debt ratio", "gearing ratio"], "total_shares": ["issued shares", "outstanding shares"],
    },
    "zh": {
        "operating_cost": ["营业总成本"], "total_profit": ["税前利润"], "net_profit_attributable_to_parent": ["归母净利润", "归属于上市公司股东的净利润"], "net_profit_deducted": ["扣除非经常性损益后的净利润", "扣除非经常性损益的净利润"],
        "interest_expense": ["利息费用", "利息支出"], "rd_expense": ["研发支出"], "gross_margin": ["毛利率"], "net_margin": ["净利率"], "total_assets": ["总资产"], "cash_and_equivalents": ["现金及现金等价物"],
        "total_liabilities": ["总负债"], "total_equity": ["股东权益合计"], "equity_attributable_to_parent": ["归母权益", "归属于母公司股东权益", "归属于母公司股东的权益", "归属于母公司所有者权益", "归属于母公司所有者的权益"],
        "operating_cash_flow": ["经营活动现金流量净额"], "free_cash_flow": ["自由现金流量", "自由现金流"], "eps": ["每股收益"], "dividend_per_share": ["每股派息", "每股分红", "每股现金股利"], "roa": ["总资产收益率"], "debt_ratio": ["资产负债率"],
    },
}

# Words near an amount that tell for it or against it: points, the field they count for (None: all), words.
NEAR_POINTS = [
    (2, None, ["rmb", "hkd", "usd", "million", "billion", "thousand"]),
    (2, "revenue", [" revenue 收入", " total revenue ", "總收入"]),
    (2, "net_profit", ["profit for the period", "profit for the year", "期內溢利", "年內溢利"]),
    (-2, None, ["non-ifrs"]),
    (-1, None, ["note", "附注"]),
]
# Sizes that tell for an amount: points, fields, least and greatest size.
SIZE_POINTS = [(1, ["revenue", "total_assets", "total_liabilities", "total_equity"], 1000, None), (1, ["eps", "eps_diluted"], None, 20)]
# A mark of thousands or decimals in the amount, and its points.
MARK_POINTS = (1, "[,.]")

# Labels that look like a metric's and aren't.
NOT_LABELS = {
    "revenue": ["company sales", "other revenue", "other operating revenue", "excluding the impact of f/x", "deferred revenue", "unearned revenue", "interest revenue", "investment revenue", "franchise fees", "franchisee", "其他收益", "其他业务收入", "递延收入", "利息收入"],
    "net_profit": ["noncontrolling", "non-controlling", "minority interests", "非控股", "少数股东", "net profit margin", "profit ratio", "adjusted net income"],
    "net_profit_attributable_to_parent": ["noncontrolling", "non-controlling", "minority interests", "非控股", "少数股东"],
    "cash_and_equivalents": ["restricted cash", "pledged deposits", "time deposits", "受限制现金", "受限货币资金", "受限制銀行存款", "抵押存款"],
    "accounts_receivable": ["other receivables", "receivables financing", "due from related parties", "其他应收", "应收关联方", "应收款项融资"],
    "operating_cash_flow": ["before changes in working capital", "excluding working capital", "未计营运资金变动", "營運資金變動前"],
    "total_equity": ["net profit", "净利润"],
    "operating_cost": ["sales and marketing", "selling expenses", "销售费用"],
    "operating_profit": ["core operating profit", "adjusted operating profit"],
}

# What the head of a table says of its statement and of its columns' roles; the first that matches holds.
STATEMENT_WORDS = [
    (CASH, ["cash flow", "现金流量", "現金流量"]),
    (BALANCE, ["balance sheet", "financial position", "assets and liabilities", "资产负债", "財務狀況"]),
    (INCOME, ["income statement", "statement of income", "profit or loss", "营收", "损益", "收益", "业绩", "業績"]),
    (METRICS, ["financial highlights", "key financial", "主要财务指标", "主要財務指標"]),
]
ROLE_WORDS = [
    ("point_in_time", ["as at", "as of"]),
    ("single_q", ["three months", "3 months", "quarter ended", "single quarter", "本季度", "单季", "單季", "三个月", "三個月"]),
    ("ytd", ["nine months", "9 months", "six months", "6 months", "year to date", "year-to-date", "ytd", "cumulative", "累计", "累計", "年初至今", "九个月", "九個月", "半年", "六个月", "六個月"]),
    ("full_year", ["year ended", "full year", "12 months", "annual", "全年", "年度"]),
    ("point_in_time", ["截至", "於", "于"]),
]
ROLES = ["unknown", "full_year", "ytd", "single_q", "point_in_time"]

# The periods that a filing of each kind reports, in order:
# kind, suffix of the id, year offset, scope, quarter, quarters up to date, first and last day, primary, comparison.
PERIOD_RULES = [
    ("semi_annual", "H1_YTD", 0, "year_to_date", None, 2, "01-01", "06-30", True, False),
    ("q4_full_year", "Q4_SINGLE", 0, "single_quarter", 4, None, "10-01", "12-31", False, False),
    ("q4_full_year", "FY", 0, "full_year", None, 4, "01-01", "12-31", True, False),
    ("q4_full_year", "FY", -1, "full_year", None, 4, "01-01", "12-31", False, True),
    ("q1", "Q1_YTD", 0, "year_to_date", None, 1, "01-01", "03-31", True, False),
    ("q2", "H1_YTD", 0, "year_to_date", None, 2, "01-01", "06-30", True, False),
    ("q2", "Q2_SINGLE", 0, "single_quarter", 2, None, "04-01", "06-30", False, False),
    ("q3", "Q3_YTD", 0, "year_to_date", None, 3, "01-01", "09-30", True, False),
    ("q3", "Q3_SINGLE", 0, "single_quarter", 3, None, "07-01", "09-30", False, False),
    ("q4", "Q4_YTD", 0, "year_to_date", None, 4, "01-01", "12-31", True, False),
    ("q4", "Q4_SINGLE", 0, "single_quarter", 4, None, "10-01", "12-31", False, False),
    ("annual", "FY", 0, "full_year", None, 4, "01-01", "12-31", True, False),
    ("annual", "FY", -1, "full_year", None, 4, "01-01", "12-31", False, True),
]
#: The balance-sheet days of each kind: day, year offset, primary, comparison.
INSTANT_RULES = [
    ("semi_annual", "06-30", 0, True, False), ("q4_full_year", "12-31", 0, True, False), ("q4_full_year", "12-31", -1, False, True), ("q1", "03-31", 0, True, False), ("q2", "06-30", 0, True, False),
    ("q3", "09-30", 0, True, False), ("q4", "12-31", 0, True, False), ("annual", "12-31", 0, True, False), ("annual", "12-31", -1, False, True),
]


def rows(spark: SparkSession, columns: dict[str, str], values: list[tuple]) -> DataFrame:
    """A small constant table as literals of the plan. columns: type by name."""
    structs = [F.struct(*(F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, columns.items(), strict=True))) for row in values]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def text_names() -> list[tuple[str, str, int, str]]:
    """(language, field, place in the field's list, name): what an amount of running text may follow, row labels last."""
    out = []
    for lang, labels in LABELS.items():
        for field in STATEMENT_OF:
            names = dict.fromkeys([*TEXT_NAMES[lang].get(field, []), *labels.get(field, [])])
            out += [(lang, field, k, name) for k, name in enumerate(names)]
    return out


def spec_dim(spark: SparkSession) -> DataFrame:
    """(spec_seq, statement, metric, formula, unit_class, floor)."""
    return rows(
        spark,
        {"spec_seq": "int", "statement": "string", "metric": "string", "formula": "string", "unit_class": "string", "floor": "double"},
        [(k, s, m, FORMULAS.get(m, (None,))[0], UNIT_OF.get(m, "amount"), 0.0 if m in NO_FLOOR else 1.0) for k, s, m in SPECS],
    )


def dependency_dim(spark: SparkSession) -> DataFrame:
    """(metric, dep_seq, dep_statement, dep_metric): what derived metrics come from."""
    return rows(spark, {"metric": "string", "dep_seq": "int", "dep_statement": "string", "dep_metric": "string"}, [(m, k, STATEMENT_OF[d], d) for m, (_, ds) in FORMULAS.items() for k, d in enumerate(ds)])


def period_dim(spark: SparkSession) -> DataFrame:
    """(kind, seq, suffix, shift, scope, fiscal_quarter, ytd_through_quarter, first, last, is_primary, is_comparison), spans before instants."""
    spans = [(kind, k, *rest) for k, (kind, *rest) in enumerate(PERIOD_RULES)]
    instants = [(kind, 100 + k, None, shift, "point_in_time", None, None, None, day, primary, comparison) for k, (kind, day, shift, primary, comparison) in enumerate(INSTANT_RULES)]
    types = {"kind": "string", "seq": "int", "suffix": "string", "shift": "int", "scope": "string", "fiscal_quarter": "int", "ytd_through_quarter": "int", "first": "string", "last": "string", "is_primary": "boolean", "is_comparison": "boolean"}
    return rows(spark, types, spans + instants)
