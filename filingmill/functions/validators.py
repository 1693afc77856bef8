"""Checks of requests and records: each gives the errors as an array of codes, empty if all is well."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import is_day
from .numbers import stripped
from .text import contains_any

# What is supported.
MARKETS, TYPES = ["CN", "HK", "US"], ["annual", "semi_annual", "quarterly", "balance_sheet", "income_statement", "cash_flow"]
SYMBOLS = {"CN": "^[0-9]{6}$", "HK": "^[0-9]{5}$", "US": "^[A-Z]{1,5}$"}
UNSAFE = ["<", ">", ";", "&", "|", "$", "`"]
MOST_DAYS, MOST_YEARS, MOST_KEYWORD, FIRST_YEAR = 3650, 10, 50, 1990


def errors(*checks: tuple[Column, str]) -> Column:
    """The codes of the conditions that hold."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for bad, code in checks)), lambda e: e.isNotNull())


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def symbol_errors(symbol: Column, market: Column) -> Column:
    plain, known = F.upper(stripped(symbol)), F.upper(market)
    wrong = [(~_empty(symbol) & (known == m) & ~plain.rlike(p), f"symbol_format_{m.lower()}") for m, p in SYMBOLS.items()]
    return errors((_empty(symbol), "symbol_missing"), *wrong, (~_empty(symbol) & ~F.coalesce(known.isin(MARKETS), F.lit(False)), "market_unknown"))


def market_errors(market: Column) -> Column:
    return errors((_empty(market), "market_missing"), (~_empty(market) & ~F.upper(market).isin(MARKETS), "market_unknown"))


def type_errors(report_type: Column) -> Column:
    return errors((_empty(report_type), "type_missing"), (~_empty(report_type) & ~report_type.isin(TYPES), "type_unknown"))


def date_range_errors(start: Column, end: Column) -> Column:
    a, b = F.try_to_date(start, "yyyy-M-d"), F.try_to_date(end, "yyyy-M-d")
    good = is_day(start) & is_day(end)
    return errors((~_empty(start) & ~is_day(start), "start_format"), (~_empty(end) & ~is_day(end), "end_format"), (good & (a > b), "start_after_end"), (good & (F.datediff(b, a) > MOST_DAYS), "range_too_long"))


def year_errors(year: Column, as_of_year: int) -> Column:
    return errors((year < FIRST_YEAR, "year_too_early"), (year > as_of_year + 1, "year_too_late"))


def years_errors(years: Column, as_of_year: int) -> Column:
    return errors((F.size(years) > MOST_YEARS, "too_many_years"), (F.exists(years, lambda y: (y < FIRST_YEAR) | (y > as_of_year + 1)), "year_out_of_range"))


def keyword_errors(keyword: Column) -> Column:
    plain = stripped(keyword)
    return errors((_empty(keyword) | (plain == ""), "keyword_missing"), (F.length(plain) > MOST_KEYWORD, "keyword_too_long"), (contains_any(plain, UNSAFE), "keyword_unsafe"))


def record_errors(symbol: Column, statement: Column, source: Column, data: Column) -> Column:
    """data: array of records with report_date."""
    return errors(
        (symbol.isNull(), "symbol_missing"), (statement.isNull(), "statement_missing"), (source.isNull(), "source_missing"),
        (F.size(data) == 0, "data_empty"), (F.exists(data, lambda r: r["report_date"].isNull()), "report_date_missing"),
    )


def request_errors(method: Column, params: Column, as_of_year: int) -> Column:
    """params: map<string,string>. Searches check keyword and market; gets check symbol, type and year."""
    given = lambda k: params[k].isNotNull()
    none = F.array().cast("array<string>")
    part = lambda when, errs: F.when(F.coalesce(when, F.lit(False)), errs).otherwise(none)
    search, get = method.startswith("search_"), method.startswith("get_")
    return F.concat(
        errors((method.isNull(), "method_missing"), (params.isNull(), "params_missing")),
        part(search & given("keyword"), keyword_errors(params["keyword"])),
        part(search & given("market"), market_errors(params["market"])),
        part(get & given("symbol") & given("market"), symbol_errors(params["symbol"], params["market"])),
        part(get & given("report_type"), type_errors(params["report_type"])),
        part(get & given("year"), year_errors(params["year"].try_cast("int"), as_of_year)),
    )
