"""Numbers in text, ratios and units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def stripped(text: Column) -> Column:
    """Without white space at its ends, the ideographic kind included."""
    return F.regexp_replace(text, r"^[\s　 ]+|[\s　 ]+$", "")


def parse_number(text: Column) -> Column:
    """A number with thousands commas, ASCII or full-width; null for anything else, such as `(1,234)`, `12%` or words."""
    plain = stripped(F.regexp_replace(F.translate(text, "０１２３４５６７８９", "0123456789"), "[,，]", ""))
    plain = F.regexp_replace(plain, "^[-－]+", "-")
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def lenient_number(text: Column) -> Column:
    """struct<num,raw>: money and percent signs are dropped; what is no number stays as raw text, blanks as ''."""
    plain = stripped(F.regexp_replace(text, "[,$%]", ""))
    blank = text.isNull() | plain.isin("", "--", "None")
    number = F.when(~blank & plain.rlike(_NUMBER), plain.try_cast("double"))
    return F.struct(number.alias("num"), F.when(blank, "").when(number.isNull(), text).alias("raw"))


def present(x: Column) -> Column:
    """x where it is neither missing nor zero: a zero amount counts as not given."""
    return F.nullif(x, F.lit(0.0))


def rounded(x: Column, places: int = 2) -> Column:
    """Half up, by a rule that other engines share."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def percent_of(part: Column, whole: Column) -> Column:
    return rounded(F.try_divide(present(part), present(whole)) * 100)


def unit_multiplier(match: Column, context: Column) -> Column:
    """What turns an amount into millions: three noughts after a currency, or words near it."""
    near = F.lower(context)
    return (
        F.when(context.contains("000") & near.rlike(r"(?:rmb|cny|usd|hkd|hk\$|us\$)[’'` ]?0{3}"), 0.001)
        .when(F.lower(match).contains("billion") | near.contains("billion"), 1000.0)
        .when(near.contains("thousand"), 0.001)
        .otherwise(1.0)
    )


def to_currency_units(value: Column, unit: Column) -> Column:
    """An amount in whole currency units."""
    return value * F.when(unit == "billion", 1e9).when(unit == "million", 1e6).when(unit == "thousand", 1e3).otherwise(1.0)


def presentation(value: Column) -> Column:
    """Currency units in hundreds of millions, as reports are read."""
    return value / 1e8


def similarity_band(score: Column) -> Column:
    """What is done with a proposed merge of two metrics."""
    return F.when(score > 0.9, "merge").when(score > 0.7, "review").otherwise("keep_apart")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
