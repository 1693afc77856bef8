"""Table cells: what a table is about, what its columns mean, and the values that its rows give."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.dates import column_year
from ..functions.names import spans, word_bounded
from ..functions.numbers import parse_number, stripped
from ..functions.text import contains_any, normalized_label
from ..staging import staged
from ..vocab import STATEMENT_OF

TABLE = ["doc_id", "page", "table_index"]
#: Labels that name a metric, up to which they are sent to all tasks, so that rows needn't be shuffled to them.
BROADCAST_LABELS = 100_000
#: A table whose page or number is missing gives no values, but counts where a document's tables are told apart.
PLACED = "page is not null and table_index is not null"
SEGMENT_WORDS = ["segment results", "all other segments", "reportable segments"]


def one_line(cell: Column) -> Column:
    return F.replace(cell, F.lit("\n"), F.lit(" "))


def _head(rows: int) -> Column:
    """The first rows' cells in one lower-case line."""
    some = (F.col("row_no") < rows) & (F.coalesce("cell", F.lit("")) != "")
    cells = F.array_sort(F.collect_list(F.when(some, F.struct("row_no", "col_no", one_line(F.lower("cell")).alias("c")))))
    return F.array_join(F.transform(cells, lambda x: x["c"]), " ")


def statement_of(head: Column) -> Column:
    return F.coalesce(*(F.when(contains_any(head, words), name) for name, words in vocab.STATEMENT_WORDS), F.lit("unknown"))


def role_of(header: Column) -> Column:
    low = F.lower(header)
    return F.coalesce(*(F.when(contains_any(low, words), role) for role, words in vocab.ROLE_WORDS), F.lit("unknown"))


def table_profiles(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, statement, is_segment): by the first eight rows; segment tables (first six) only in English filings."""
    heads = cells.where("row_no < 8").groupBy(*TABLE).agg(_head(8).alias("h8"), _head(6).alias("h6"))
    return heads.join(documents.select("doc_id", "lang"), "doc_id").select(*TABLE, statement_of(F.col("h8")).alias("statement"), ((F.col("lang") == "en") & contains_any(F.col("h6"), SEGMENT_WORDS)).alias("is_segment"))


def column_profiles(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, col_no, column_header, column_year, column_role, is_comparison) of every column but the first.

    A header is the cells of the first three rows; a column without one has that of the column before it.
    """
    heads = cells.where("row_no < 3 and col_no > 0").groupBy(*TABLE, "col_no").agg(F.array_sort(F.collect_list(F.when(F.coalesce("cell", F.lit("")) != "", F.struct("row_no", stripped(one_line(F.col("cell"))).alias("c"))))).alias("x"))
    own = F.trim(F.array_join(F.filter(F.transform("x", lambda x: x["c"]), lambda c: c != ""), " "))
    filled = F.last(F.nullif(own, F.lit("")), ignorenulls=True).over(Window.partitionBy(*TABLE).orderBy("col_no").rowsBetween(Window.unboundedPreceding, 0))
    p = heads.withColumn("column_header", filled).drop("x").join(documents.select("doc_id", "fiscal_year"), "doc_id")
    header = F.coalesce("column_header", F.lit(""))
    p = p.withColumn("column_year", column_year(header)).withColumn("column_role", role_of(header))
    older = contains_any(F.lower(header), ["comparative", "corresponding"]) | F.coalesce(F.col("column_year") < F.col("fiscal_year"), F.lit(False))
    return p.withColumn("is_comparison", older).drop("fiscal_year")


def label_metrics(labels: DataFrame, extra: list[str] = ()) -> DataFrame:
    """labels (lang, label) -> (lang, label, statement, metric) of the metrics that a row's label names.

    English words count as whole words, Chinese ones anywhere; labels that a metric's blacklist has are out. Labels are made
    distinct first, so their number doesn't grow with the tables; each is read once, for all words and blacklists together.
    """
    each = labels.select("lang", "label").distinct().withColumn("norm", normalized_label(F.col("label")))
    words = [(lang, STATEMENT_OF[m], m, w) for lang, by in vocab.LABELS.items() for m, ws in by.items() for w in ws]
    barred = [(m, w) for m, ws in vocab.NOT_LABELS.items() for w in ws]
    return each.mapInArrow(lambda batches: _named(batches, words, barred), "lang string, label string, statement string, metric string")


def _named(batches: Iterator[pa.RecordBatch], words: list[tuple[str, str, str, str]], barred: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    names = (*(w for *_, w in words), *(w for _, w in barred))
    for batch in batches:
        rows = []
        for lang, label, norm in zip(*(batch[c].to_pylist() for c in ("lang", "label", "norm")), strict=True):
            hits = list(spans(norm, names)) if norm else []
            bad = {barred[k - len(words)][0] for _, _, k, _ in hits if k >= len(words)}
            own = [(start, end, words[k]) for start, end, k, _ in hits if k < len(words) and words[k][0] == lang]
            rows += dict.fromkeys((lang, label, statement, m) for start, end, (_, statement, m, _) in own if m not in bad and (lang != "en" or word_bounded(norm, start, end)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["lang", "label", "statement", "metric"])


def _row_metrics(cells: DataFrame, documents: DataFrame, label: Column) -> DataFrame:
    """label_metrics of all rows' labels, as (lang, row_label, statement, metric)."""
    labels = cells.where("col_no = 0").select("doc_id", label.alias("label")).join(documents.select("doc_id", "lang"), "doc_id")
    named = staged(label_metrics(labels).withColumnRenamed("label", "row_label"))
    return F.broadcast(named) if named.count() <= BROADCAST_LABELS else named


def _gathered(cells: DataFrame, documents: DataFrame, *told: str) -> DataFrame:
    """(doc_id, page, table_index, rows, and columns of documents): each table in one row, its rows in order as (row_no, row), each of them its cells in order as (col_no, cell). Tables without a head row are out, as table_profiles has none."""
    rows = cells.groupBy(*TABLE, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "cell"))).alias("row"))
    tables = rows.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("row_no", "row"))).alias("rows")).where(F.exists("rows", lambda r: r["row_no"] < 8))
    return tables.join(documents.select("doc_id", *told), "doc_id")


def _filled(cell: Column) -> Column:
    return F.coalesce(cell, F.lit("")) != ""


def _profiled(tables: DataFrame) -> DataFrame:
    """Gathered tables with `statement` and `is_segment`, by the rules of table_profiles."""
    head = lambda n: F.array_join(F.flatten(F.transform(F.filter("rows", lambda r: r["row_no"] < n), lambda r: F.transform(F.filter(r["row"], lambda c: _filled(c["cell"])), lambda c: one_line(F.lower(c["cell"]))))), " ")
    heads = tables.withColumns({"_h8": head(8), "_h6": head(6)})
    return heads.withColumns({"statement": statement_of(F.col("_h8")), "is_segment": (F.col("lang") == "en") & contains_any(F.col("_h6"), SEGMENT_WORDS)}).drop("_h8", "_h6")


def _columns(rows: str, fiscal_year: Column) -> Column:
    """The columns of a gathered table, as structs of what column_profiles tells of them."""
    head = F.filter(rows, lambda r: r["row_no"] < 3)
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(head, lambda r: F.transform(F.filter(r["row"], lambda c: c["col_no"] > 0), lambda c: c["col_no"])))))
    parts = lambda k: F.flatten(F.transform(head, lambda r: F.transform(F.filter(r["row"], lambda c: (c["col_no"] == k) & _filled(c["cell"])), lambda c: stripped(one_line(c["cell"])))))
    own = F.transform(numbers, lambda k: F.named_struct(F.lit("col_no"), k, F.lit("own"), F.trim(F.array_join(F.filter(parts(k), lambda c: c != ""), " "))))
    # the last header up to each column, by a fold over the columns
    header = lambda before, c: F.when(c["own"] != "", c["own"]).otherwise(F.try_element_at(before, F.lit(-1))["column_header"])
    named = F.aggregate(own, F.array().cast("array<struct<col_no:int,column_header:string>>"), lambda before, c: F.concat(before, F.array(F.named_struct(F.lit("col_no"), c["col_no"].cast("int"), F.lit("column_header"), header(before, c)))))
    dated = F.transform(named, lambda c: F.named_struct(F.lit("col_no"), c["col_no"], F.lit("column_header"), c["column_header"], F.lit("column_year"), column_year(F.coalesce(c["column_header"], F.lit("")))))
    older = lambda c: contains_any(F.lower(F.coalesce(c["column_header"], F.lit(""))), ["comparative", "corresponding"]) | F.coalesce(c["column_year"] < fiscal_year, F.lit(False))
    return F.transform(dated, lambda c: F.named_struct(F.lit("col_no"), c["col_no"], F.lit("column_header"), c["column_header"], F.lit("column_year"), c["column_year"], F.lit("column_role"), role_of(F.coalesce(c["column_header"], F.lit(""))), F.lit("is_comparison"), older(c)))


def observations(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """Every value that a table row gives for a metric (schemas.OBSERVATIONS), in the order of tables, rows and columns.

    documents: (doc_id, lang, fiscal_year). Segment tables are skipped; a classified table gives only its own statement's
    metrics; amounts under 1 are no values. Cells are gathered by table once, and then joined no more; cells and documents
    that come dealt by doc_id are not shuffled.
    """
    spark = cells.sparkSession
    tables = _profiled(_gathered(cells, documents, "lang", "fiscal_year")).where(f"not is_segment and {PLACED}").withColumn("columns", _columns("rows", F.col("fiscal_year")))
    label = stripped(one_line(F.col("cell")))
    labels = F.flatten(F.transform(F.filter("rows", lambda r: r["row_no"].isNotNull()), lambda r: F.transform(F.filter(r["row"], lambda c: c["col_no"] == 0), lambda c: F.named_struct(F.lit("row_no"), r["row_no"], F.lit("row"), r["row"], F.lit("cell"), c["cell"]))))
    rows = tables.select(*TABLE, "lang", F.col("statement").alias("table_statement"), "columns", F.explode(labels).alias("x"))
    rows = rows.select(*TABLE, "lang", "table_statement", "columns", "x.row_no", "x.row", stripped(one_line(F.col("x.cell"))).alias("row_label")).where("row_label <> ''")
    rows = rows.join(_row_metrics(cells, documents, label), ["lang", "row_label"]).where("table_statement = 'unknown' or table_statement = statement")
    floors = F.broadcast(vocab.spec_dim(spark).select("metric", "floor"))
    snippet = F.substring(F.array_join(F.transform(F.filter("row", lambda c: (c["col_no"] < 4) & _filled(c["cell"])), lambda c: stripped(one_line(c["cell"]))), " "), 1, 200)
    values = rows.join(floors, "metric").withColumn("snippet", snippet).withColumn("v", F.explode(F.filter("row", lambda c: c["col_no"] > 0)))
    o = values.withColumn("value", parse_number(one_line(F.col("v.cell")))).where("abs(value) >= floor").withColumn("c", F.get(F.filter("columns", lambda c: c["col_no"] == F.col("v.col_no")), 0))
    o = o.select("doc_id", "statement", "metric", "page", "table_index", "row_no", F.col("v.col_no").alias("col_no"), "row_label", stripped(F.col("v.cell")).alias("raw_value"), "value", "snippet", "c")
    seq = F.row_number().over(Window.partitionBy("doc_id", "statement", "metric").orderBy("page", "table_index", "row_no", "col_no")).cast("long")
    return o.select(
        "doc_id", seq.alias("obs_seq"), "statement", "metric", "page", "table_index", "row_label", "c.column_header", F.coalesce("c.column_role", F.lit("unknown")).alias("column_role"), "c.column_year",
        F.coalesce("c.is_comparison", F.lit(False)).alias("is_comparison"), "raw_value", "value", "snippet",
    )


def _tier(statement: Column, of: Column) -> Column:
    return F.when(statement == of, 1).when(statement == "unknown", 2).when(of == vocab.METRICS, 3)


def tables_for(profiles: DataFrame, statement: str) -> DataFrame:
    """The tables to read a statement from: those classified as it, else the unclassified ones, else (metrics only) all."""
    tier = _tier(F.col("statement"), F.lit(statement))
    best = F.min("tier").over(Window.partitionBy("doc_id"))
    return profiles.withColumn("tier", tier).where("tier is not null").withColumn("best", best).where("tier = best").drop("tier", "best")


def year_end_columns(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, year_end_col): rows are read until two year-end dates are found; of the last two by column that of the greater year."""
    year = F.regexp_extract("cell", r"(?:12/31|31/12)/?(20[0-9]{2})", 1)
    found = cells.select(*TABLE, "row_no", "col_no", year.alias("y")).where("y <> ''").withColumn("y", F.col("y").cast("int"))
    upto = Window.partitionBy(*TABLE).orderBy("row_no").rangeBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.count("*").over(upto)).where("before < 2")
    last = F.slice(F.sort_array(F.collect_list(F.struct("col_no", "row_no", "y")), asc=False), 1, 2)
    best = F.element_at(F.array_sort(F.transform("x", lambda d: F.struct((-d["y"]).alias("y"), d["col_no"].alias("c")))), 1)["c"]
    return found.groupBy(*TABLE).agg(last.alias("x")).select(*TABLE, best.alias("year_end_col"))


def value_near(values: Column, index: Column) -> Column:
    """The number at a place of a row's array, else one or two to its right, else one to its left; null beyond the row."""
    at = lambda k: F.get(values, index + k)
    left = F.when(index > 0, at(-1))
    return F.when(index < F.size(values), F.coalesce(at(0), at(1), at(2), left))


def first_above(values: Column, least: Column) -> Column:
    """The first number of a row's array whose size is above a bound: notes and numbering are skipped."""
    return F.get(F.filter(values, lambda v: F.abs(v) > least), 0)


def row_values(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, row_no, lang, statement (of the table), row_label, values, year_end_col): rows as arrays of numbers, the label's place null."""
    number = F.when(F.col("col_no") > 0, parse_number(F.replace("cell", F.lit("\n"), F.lit(""))))
    rows = cells.groupBy(*TABLE, "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.replace("cell", F.lit("\n"), F.lit("")))).alias("row_label"), F.array_sort(F.collect_list(F.struct("col_no", number.alias("v")))).alias("x")
    )
    rows = rows.where("size(x) > 1").withColumn("values", F.transform("x", lambda x: x["v"])).drop("x").join(table_profiles(cells, documents), TABLE).join(documents.select("doc_id", "lang"), "doc_id")
    ends = year_end_columns(cells)
    return rows.join(ends, TABLE, "left").withColumn("year_end_col", F.when(F.col("lang") == "en", F.col("year_end_col")))


def _year_end(rows: str) -> Column:
    """The column of a gathered table that year_end_columns finds; null without dates."""
    year = lambda c: F.regexp_extract(c, r"(?:12/31|31/12)/?(20[0-9]{2})", 1)
    dates = F.flatten(F.transform(rows, lambda r: F.transform(F.filter(r["row"], lambda c: year(c["cell"]) != ""), lambda c: F.named_struct(F.lit("col_no"), c["col_no"], F.lit("row_no"), r["row_no"], F.lit("y"), year(c["cell"]).cast("int")))))
    second = lambda found: F.get(found, 1)["row_no"]  # noqa: E731  rows without a number come first
    upto = lambda found: F.filter(found, lambda d: (F.size(found) < 2) | (second(found).isNotNull() & (d["row_no"].isNull() | (d["row_no"] <= second(found)))))
    last = lambda found: F.slice(F.sort_array(upto(found), asc=False), 1, 2)
    best = F.transform(F.array(dates), lambda found: F.array_min(F.transform(last(found), lambda d: F.named_struct(F.lit("y"), -d["y"], F.lit("c"), d["col_no"])))["c"])
    return F.get(best, 0)


def table_values(cells: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, statement, metric, seq, value): what each table row offers for a metric's record, in reading order.

    A row's value is the one at the year-end column, else the first above a bound (1 in English, 10000 in Chinese income
    and balance tables, none for ratios). Rows of tables that tables_for leaves out give nothing. As in observations, cells
    are gathered by table once; the rules are those of row_values and tables_for.
    """
    plain = lambda cell: F.replace(cell, F.lit("\n"), F.lit(""))
    tables = _profiled(_gathered(cells, documents, "lang")).withColumn("all", F.collect_set("statement").over(Window.partitionBy("doc_id"))).where(f"not is_segment and {PLACED}")
    served = F.filter(F.array(*map(F.lit, vocab.FIELDS)), lambda of: _tier(F.col("statement"), of) == F.array_min(F.transform("all", lambda s: _tier(s, of))))
    tables = tables.select(*TABLE, "lang", served.alias("served"), F.when(F.col("lang") == "en", _year_end("rows")).alias("year_end_col"), F.explode("rows").alias("r")).select(*TABLE, "lang", "served", "year_end_col", "r.*").where("size(row) > 1")
    rows = tables.withColumn("row_label", F.array_max(F.transform(F.filter("row", lambda c: c["col_no"] == 0), lambda c: plain(c["cell"]))))
    named = _row_metrics(cells, documents, plain("cell")).withColumnRenamed("statement", "of")
    rows = rows.join(named, ["lang", "row_label"]).where("array_contains(served, of)").withColumn("values", F.transform("row", lambda c: F.when(c["col_no"] > 0, parse_number(plain(c["cell"])))))
    least = F.when(F.col("of") == vocab.METRICS, -1.0).when((F.col("lang") == "zh") & F.col("of").isin(vocab.INCOME, vocab.BALANCE), 10000.0).otherwise(1.0)
    value = F.coalesce(value_near(F.col("values"), F.col("year_end_col")), first_above(F.col("values"), least))
    v = rows.withColumn("value", value).where("value is not null")
    v = v.where((F.col("of") != vocab.CASH) | (F.abs("value") > 1))
    seq = F.row_number().over(Window.partitionBy("doc_id", "of", "metric").orderBy("page", "table_index", "row_no"))
    return v.select("doc_id", F.col("of").alias("statement"), "metric", seq.alias("seq"), "value", "lang")


def table_pass(records: DataFrame, offered: DataFrame) -> DataFrame:
    """records (doc_id, one column for each metric) after the tables: income keeps the greatest size, later rows winning ties; the balance sheet replaces what is missing or too small; the rest fills what is missing."""
    largest = F.max_by("value", F.struct(F.abs("value").alias("a"), "seq"))
    first = F.min_by("value", "seq")
    per = offered.groupBy("doc_id", "metric").agg(largest.alias("largest"), first.alias("first"), F.max("lang").alias("lang"))
    wide = per.groupBy("doc_id").agg(F.max("lang").alias("_lang"), *(F.max(F.when(F.col("metric") == m, F.col("largest" if s == vocab.INCOME else "first"))).alias(f"_{m}") for s, ms in vocab.FIELDS.items() for m in ms))
    joined = records.join(wide, "doc_id", "left")
    small = F.when(F.col("_lang") == "zh", 10000.0).otherwise(1.0)
    out = {}
    for s, ms in vocab.FIELDS.items():
        for m in ms:
            old, new = F.col(m), F.col(f"_{m}")
            if s == vocab.INCOME:
                out[m] = F.when(new.isNotNull() & (old.isNull() | (F.abs(new) >= F.abs(old))), new).otherwise(old)
            elif s == vocab.BALANCE:
                out[m] = F.when(new.isNotNull() & (old.isNull() | (F.abs(old) < small)), new).otherwise(old)
            else:
                out[m] = F.coalesce(old, new)
    return joined.withColumns(out).select(*records.columns)


def related_parties(cells: DataFrame, words: list[str], least: float = 100.0) -> DataFrame:
    """(doc_id, page, table_index, row_no, party_name, amounts): rows of tables whose first row has one of the words, with their numbers above a size."""
    heads = cells.where("row_no = 0 and cell is not null").groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "cell"))), lambda x: x["cell"]), " ").alias("h")).where(contains_any(F.col("h"), words))
    rows = cells.where("row_no > 0").join(heads.select(*TABLE), TABLE, "left_semi")
    number = F.when((F.col("col_no") > 0) & (F.abs(parse_number(F.col("cell"))) > least), F.struct("col_no", parse_number(F.col("cell")).alias("v")))
    out = rows.groupBy(*TABLE, "row_no").agg(F.max(F.when(F.col("col_no") == 0, stripped(F.replace("cell", F.lit("\n"), F.lit(""))))).alias("party_name"), F.transform(F.array_sort(F.collect_list(number)), lambda x: x["v"]).alias("amounts"))
    return out.where("coalesce(party_name, '') <> '' and size(amounts) > 0")
