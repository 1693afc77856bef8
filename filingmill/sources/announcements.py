"""Announcement feeds: fetched JSON and HTML as DataFrames, and the requests that would fetch them.

Fetching itself is out of scope: a crawler writes the answers to files, this reads them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, text


def cn_announcements(answers: DataFrame, pdf_base: str, exclude_summary: bool = True) -> DataFrame:
    """One row for each announcement of search answers (schemas.CN_FEED): time, address, kind, year and exchange added.

    Abridged versions go if asked; so do items whose time is no number of milliseconds.
    """
    a = answers.select(F.explode("announcements").alias("a")).select("a.*")
    title, when = F.coalesce("announcementTitle", F.lit("")), F.col("announcementTime").try_cast("bigint")
    kept = a.where(when.isNotNull())
    if exclude_summary:
        kept = kept.where(~text.is_summary(title))
    url = F.coalesce("adjunctUrl", F.lit(""))
    return kept.select(
        F.col("announcementId").alias("announcement_id"), title.alias("announcement_title"), F.col("secCode").alias("stock_code"), F.col("secName").alias("stock_name"), F.col("announcementTime").alias("announcement_time"),
        F.date_format(F.timestamp_millis(when), "yyyy-MM-dd").alias("announcement_date"), F.when(url != "", F.concat(F.lit(pdf_base + "/"), url)).otherwise("").alias("pdf_url"), url.alias("adjunct_url"),
        F.coalesce(F.col("adjunctSize").try_cast("bigint"), F.lit(0)).alias("file_size"), text.filing_kind(title).alias("report_type"), dates.title_year(title).alias("year"), text.exchange(F.col("secCode")).alias("exchange"),
    )


def hk_announcements(answers: DataFrame, column: str, base: str, report_type: str) -> DataFrame:
    """Rows of an announcement page's JSON in `column`: an object with a list, or a bare list. The first stock of an item counts; items without stock or path go."""
    listed = F.coalesce(F.from_json(column, f"struct<newsInfoLst:array<{schemas.HK_ITEM}>>")["newsInfoLst"], F.from_json(column, f"array<{schemas.HK_ITEM}>"))
    x = answers.select(F.explode(listed).alias("x")).select("x.*").where((F.size("stock") > 0) & (F.coalesce("webPath", F.lit("")) != ""))
    title = F.coalesce("title", F.lit(""))
    return x.select(
        F.col("newsId").alias("news_id"), text.padded_code(F.coalesce(F.col("stock")[0]["sc"], F.lit(""))).alias("stock_code"), F.col("stock")[0]["sn"].alias("stock_name"), title.alias("title"),
        F.concat(F.lit(base), "webPath").alias("pdf_url"), F.col("webPath").alias("web_path"), F.col("relTime").alias("release_time"), F.col("size").alias("file_size"), F.coalesce("market", F.lit("SEHK")).alias("market"),
        text.title_language(title, F.col("webPath")).alias("language"), F.lit(report_type).alias("report_type"), dates.title_year(title, F.col("webPath"), F.col("relTime")).alias("year"),
    ).where(text.matches_type(F.col("title"), report_type))


def with_publish_time(reports: DataFrame, market: str) -> DataFrame:
    """publish_time (ISO, or null) and publish_timestamp (seconds, 0 without a time)."""
    when = dates.cn_time(F.col("announcement_time"), F.col("announcement_date")) if market == "CN" else dates.hk_time(F.col("release_time"))
    seconds = F.coalesce(F.unix_timestamp(when.cast("timestamp")), F.lit(0))
    return reports.withColumn("publish_time", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss")).withColumn("publish_timestamp", seconds)


def identity(market: str) -> Column:
    """What makes two reports the same: the first of several fields that isn't empty."""
    names = ["adjunct_url", "announcement_id", "pdf_url", "announcement_title"] if market == "CN" else ["web_path", "news_id", "pdf_url", "title"]
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.lit(""))


def internal_ids(reports: DataFrame, dim: DataFrame, limit: int = 100_000) -> DataFrame:
    """reports with internal_id, looked up by stock_code in dim (code, internal_id), the smallest of several; null where unknown.

    dim is broadcast if it has at most `limit` codes.
    """
    dim = dim.groupBy(F.col("code").alias("stock_code")).agg(F.min("internal_id").alias("internal_id"))
    small = dim.limit(limit + 1).count() <= limit
    return reports.join(F.broadcast(dim) if small else dim, "stock_code", "left")


def backward_windows(spark: SparkSession, end: str, days: int = 120, years: int = 2) -> DataFrame:
    """(window_no, start_date, end_date): windows of fixed width from `end` back over the years, newest first; the last may be shorter."""
    last = F.to_date(F.lit(end))
    first = F.add_months(last, -12 * years)
    span = spark.range(1).select(last.alias("e"), first.alias("s"))
    n = F.ceil(F.datediff("e", "s") / days).cast("int")
    w = span.select("s", "e", F.explode(F.sequence(F.lit(0), n - 1)).alias("window_no"))
    return w.select("window_no", F.greatest("s", F.date_sub("e", (F.col("window_no") + 1) * days)).alias("start_date"), F.date_sub("e", F.col("window_no") * days).alias("end_date"))


def search_requests(spark: SparkSession, languages: list[str], headlines: list[str]) -> DataFrame:
    """(language, headline) of every request of a search: the product of two short lists."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, languages))).alias("language")).select("language", F.explode(F.array(*map(F.lit, headlines))).alias("headline"))


# Categories of report types, and exchanges by the beginning of a code.
CATEGORIES = {
    "annual": "category_ndbg_szsh",
    "semi_annual": "category_bndbg_szsh",
    "quarterly_1": "category_yjdbg_szsh",
    "quarterly_3": "category_sjdbg_szsh",
    "quarterly": "category_yjdbg_szsh;category_sjdbg_szsh",
    "all_reports": "category_ndbg_szsh;category_bndbg_szsh;category_yjdbg_szsh;category_sjdbg_szsh",
}
BOARDS = {"sse": ["600", "601", "603", "605", "688"], "szse": ["000", "002", "300"], "bj": ["43", "83", "87"]}


def cn_search_requests(asks: DataFrame, today: str, days: int = 3 * 365) -> DataFrame:
    """asks with what each search sends: page_no, page_size, board, search_key, category, first_day and last_day (ISO).

    asks: stock_code, company_name, report_type, start_date, end_date, exchange, limit, page; nulls and '' are unset. Without a
    start the last `days` up to today are asked for, whatever the end; without an end it is today. The key is the company's
    name, else the code. The board follows from the code where the exchange is unset or `all`, else szse. A page holds
    three times the limit (30), as abridged versions go later, and 30 at least. Unknown types are asked for as annual.
    """
    unset = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    code, start, end = unset("stock_code"), unset("start_date"), unset("end_date")
    named = F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, heads)), lambda h: code.startswith(h)), board) for board, heads in BOARDS.items()))  # noqa: B023
    exchange = F.coalesce(unset("exchange"), F.lit("all"))
    categories = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return asks.withColumns(
        {
            "page_no": F.coalesce("page", F.lit(1)),
            "page_size": F.greatest(F.coalesce("limit", F.lit(30)) * 3, F.lit(30)),
            "board": F.when(exchange != "all", exchange).otherwise(F.coalesce(named, F.lit("szse"))),
            "search_key": F.coalesce(unset("company_name"), code, F.lit("")),
            "category": F.coalesce(F.try_element_at(categories, F.col("report_type")), F.lit(CATEGORIES["annual"])),
            "first_day": F.coalesce(start, F.date_format(F.date_sub(F.to_date(F.lit(today)), days), "yyyy-MM-dd")),
            "last_day": F.coalesce(F.when(start.isNotNull(), end), F.lit(today)),
        }
    )


def daily_requests(spark: SparkSession, year: int) -> DataFrame:
    """(day, until): one request a day, each up to the next day; neighbours overlap, so results are to be deduplicated by their key."""
    days = F.explode(F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31))))
    return spark.range(1).select(days.alias("day")).withColumn("until", F.date_add("day", 1))


def slices(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """(slice_no, start_date, end_date) of a span in steps."""
    a, b = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    starts = F.posexplode(F.sequence(a, b, F.expr(f"interval {days} day")))
    return spark.range(1).select(starts.alias("slice_no", "start_date")).select("slice_no", "start_date", F.least(F.date_add("start_date", days - 1), b).alias("end_date"))


def keyword_records(announcements: DataFrame) -> DataFrame:
    """Keyword search results cleaned: no markup in titles, time as text, file name of at most 150 characters."""
    title = F.regexp_replace("announcementTitle", "<[^>]+>", "")
    return announcements.withColumns(
        {
            "title": title,
            "time": F.date_format(F.timestamp_millis(F.col("announcementTime").try_cast("bigint")), "yyyy-MM-dd HH:mm:ss"),
            "file_stem": F.substring(text.safe_file_name(F.concat_ws("_", "secCode", "secName", title)), 1, 150),
        }
    )


def complete(stored: DataFrame, announced: int) -> bool:
    """Whether a search has stored all that was announced: the stop of repeated passes."""
    return stored.count() >= announced
