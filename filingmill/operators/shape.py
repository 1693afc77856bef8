"""Statements of many sources brought to standard columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import lenient_number

# The names that sources give to standard columns, by statement.
SOURCE_NAMES = {
    "balance_sheet": {
        "total_assets": ["资产总计", "totalAssets", "total_assets"], "total_liabilities": ["负债合计", "totalLiabilities", "total_liabilities"], "shareholders_equity": ["股东权益合计", "totalShareholderEquity", "shareholders_equity"],
        "cash_and_equivalents": ["货币资金", "cashAndCashEquivalentsAtCarryingValue", "cash"], "accounts_receivable": ["应收账款", "currentNetReceivables", "accounts_receivable"], "inventory": ["存货", "inventory"], "property_plant_equipment": ["固定资产", "propertyPlantEquipment", "ppe"],
    },
    "income_statement": {
        "total_revenue": ["营业总收入", "totalRevenue", "revenue"], "operating_income": ["营业利润", "operatingIncome", "operating_income"], "net_income": ["净利润", "netIncome", "net_income"], "gross_profit": ["毛利润", "grossProfit", "gross_profit"],
        "operating_expenses": ["营业费用", "operatingExpenses", "operating_expenses"], "interest_expense": ["利息费用", "interestExpense", "interest_expense"], "tax_expense": ["所得税费用", "incomeTaxExpense", "tax_expense"],
    },
    "cash_flow": {
        "operating_cash_flow": ["经营活动现金流量净额", "operatingCashflow", "operating_cash_flow"], "investing_cash_flow": ["投资活动现金流量净额", "cashflowFromInvestment", "investing_cash_flow"], "financing_cash_flow": ["筹资活动现金流量净额", "cashflowFromFinancing", "financing_cash_flow"],
        "net_cash_flow": ["现金流量净额", "changeInCash", "net_cash_flow"], "free_cash_flow": ["自由现金流", "freeCashFlow", "free_cash_flow"], "capital_expenditures": ["资本支出", "capitalExpenditures", "capex"],
    },
}
DATE_NAMES = ["报告日期", "fiscalDateEnding", "date", "report_period", "end_date"]
STOCK_FIELDS = ["symbol", "name", "market", "industry", "sector", "list_date"]
SOURCE_FIELDS = {"tushare": ["ts_code", "area", "fullname"], "alpha_vantage": ["description", "market_cap", "pe_ratio", "dividend_yield"], "akshare": ["current_price", "change_percent"]}


def _first(df: DataFrame, names: list[str]):
    here = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*here) if here else F.lit(None).cast("string")


def statements(df: DataFrame, statement_type: str, symbol: str, source: str) -> DataFrame:
    """One record for each row: report_date and the standard columns as struct<num,raw>, each from the first of its names that has a value. Rows with nothing go."""
    names = SOURCE_NAMES.get(statement_type, {})
    out = df.select(F.lit(symbol).alias("symbol"), F.lit(statement_type).alias("statement_type"), F.lit(source).alias("source"), _first(df, DATE_NAMES).alias("report_date"), *(lenient_number(_first(df, ns)).alias(n) for n, ns in names.items()))
    some = F.coalesce("report_date", *(F.coalesce(F.col(n)["num"].cast("string"), F.nullif(F.col(n)["raw"], F.lit(""))) for n in names))
    return out.where(some.isNotNull())


def stock_info(df: DataFrame, source: str) -> DataFrame:
    """The common fields, those of the source, and '' for what is missing."""
    field = lambda c: F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None), F.lit("")).alias(c)
    return df.select(*map(field, STOCK_FIELDS), F.lit(source).alias("source"), *map(field, SOURCE_FIELDS.get(source, [])))


def report_bundle(parts: dict[str, DataFrame], symbol: str, source: str, report_type: str) -> DataFrame:
    """The statements of an annual or quarterly bundle in one table."""
    done = [statements(df, kind, symbol, source).withColumn("report_type", F.lit(report_type)) for kind, df in parts.items()]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out
