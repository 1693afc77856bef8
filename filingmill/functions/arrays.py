"""Page ranges and other arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_RANGE = 10000
_RANGES = r"^\s*[0-9]+\s*(-\s*[0-9]*\s*)?(,\s*[0-9]+\s*(-\s*[0-9]*\s*)?)*$"


def page_ranges(spec: Column) -> Column:
    """`1-3,5,7-` as sorted distinct pages; null if any part is wrong. An open range goes on for 10000 pages."""
    parts = F.split(spec, ",")
    low = lambda p: F.trim(F.substring_index(p, "-", 1)).try_cast("int")
    high = lambda p: F.when(~p.contains("-"), low(p)).when(F.trim(F.substring_index(p, "-", -1)) == "", low(p) + OPEN_RANGE).otherwise(F.trim(F.substring_index(p, "-", -1)).try_cast("int"))
    right = spec.rlike(_RANGES) & F.forall(parts, lambda p: (low(p) > 0) & (low(p) <= high(p)))
    return F.when(right, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p)))))))


def split_pages(pages: Column, total: Column) -> Column:
    """struct<valid,missing>: the wished pages that there are, and those that there aren't."""
    return F.struct(F.filter(pages, lambda p: p <= total).alias("valid"), F.filter(pages, lambda p: p > total).alias("missing"))


def filled_fields(scalars: list[Column], lists: list[Column] = ()) -> Column:
    """Scalars that aren't null, and the items of lists."""
    out = F.lit(0)
    for c in scalars:
        out = out + c.isNotNull().cast("int")
    for c in lists:
        out = out + F.when(c.isNull(), 0).otherwise(F.size(c))
    return out


def ordered_union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def head_text(table: Column, n_rows: int) -> Column:
    """The cells of a table's first rows in one line, nulls and line breaks gone."""
    cells = F.filter(F.flatten(F.filter(F.slice(table, F.lit(1), F.lit(n_rows)), lambda r: r.isNotNull())), lambda c: c.isNotNull() & (c != ""))
    return F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " ")
