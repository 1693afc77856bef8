"""Years, days and publishing times of filings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def hk_time(text: Column) -> Column:
    """`Release Time:04/02/2026 19:21` or a day alone."""
    plain = F.trim(F.replace(text, F.lit("Release Time:"), F.lit("")))
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in ("dd/MM/yyyy HH:mm", "dd/MM/yyyy")))


def cn_time(millis: Column, day: Column) -> Column:
    """Milliseconds since the epoch, else a day. UTC."""
    return F.coalesce(F.timestamp_millis(millis.try_cast("bigint")).cast("timestamp_ntz"), F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))


def title_year(title: Column, url: Column | None = None, release: Column | None = None) -> Column:
    """Of the title, else of the path `/2025/`, else of the release day."""
    ways = [_found(title, "(20[0-9]{2})")]
    if url is not None:
        ways.append(_found(url, "/(20[0-9]{2})/"))
    if release is not None:
        ways.append(_found(release, r"[0-9]{2}/[0-9]{2}/(20[0-9]{2})"))
    return F.coalesce(*ways).cast("int")


def fiscal_year(text: Column, report_period: Column, name: Column) -> Column:
    """The year before a period word, or after `year ended`; else that of the report period, else of the file name."""
    head = F.substring(text, 1, 4000)
    return F.coalesce(
        _found(head, r"(?i)(20\d{2})\s*(?:q[1-4]|(?:first|second|third|fourth) quarter|interim|annual|full year)"),
        _found(head, r"(?i)(?:year|period)\s+ended?\s+.*?(20\d{2})"),
        _found(report_period, r"(20\d{2})"),
        _found(name, r"(20\d{2})"),
    ).cast("int")


def column_year(header: Column) -> Column:
    return _found(header, "(20[0-9]{2})").cast("int")


def is_day(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & F.try_to_date(text, "yyyy-M-d").isNotNull(), F.lit(False))


def period_days(year: Column, name: Column) -> Column:
    """struct<start,end> of q1 to q4, h1 and fy."""
    first = F.when(name == "q2", 4).when(name == "q3", 7).when(name == "q4", 10).when(name.isin("q1", "h1", "fy"), 1)
    months = F.when(name == "fy", 12).when(name == "h1", 6).when(name.isin("q1", "q2", "q3", "q4"), 3)
    start = F.make_date(year, first, F.lit(1))
    return F.struct(start.alias("start"), F.date_sub(F.add_months(start, months), 1).alias("end"))


def report_date(*fields: Column) -> Column:
    """The first that is given, days as yyyy-MM-dd."""
    return F.coalesce(*(f.cast("string") for f in fields))
