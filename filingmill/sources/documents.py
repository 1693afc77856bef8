"""Parsed documents: page text and table cells, read per document, and what is asked of them."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.arrays import page_ranges, split_pages

PARSED = "source string, file_hash string, success boolean, error string, num_pages int, pages array<struct<page_no:int,text:string>>, cells array<struct<page:int,table_index:int,row_no:int,col_no:int,cell:string>>"
Parser = Callable[[bytes], tuple[list[str], list[list[list[list[str]]]]]]


def plain_parser(content: bytes) -> tuple[list[str], list[list[list[list[str]]]]]:
    """A parser for plain text: pages end with form feeds, and there are no tables."""
    return content.decode("utf-8").split("\f"), []


def pdf_parser(content: bytes) -> tuple[list[str], list[list[list[list[str]]]]]:
    """Pages and tables by page of a PDF; needs the optional package pdfplumber."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [p.extract_text() or "" for p in pdf.pages], [p.extract_tables() or [] for p in pdf.pages]


def parsed_files(spark: SparkSession, path: str, parser: Parser = pdf_parser, pattern: str = "*.pdf") -> DataFrame:
    """One row for each file: the hash of its bytes, its pages and cells, or the error that it gave. A bad file never ends the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.sha2("content", 256).alias("file_hash"), "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, name, content in zip(batch["path"], batch["file_hash"], batch["content"], strict=True):
                try:
                    pages, tables = parser(content)
                    cells = [
                        {"page": p, "table_index": t, "row_no": r, "col_no": c, "cell": cell}
                        for p, on_page in enumerate(tables, 1)
                        for t, table in enumerate(on_page, 1)
                        for r, row in enumerate(table)
                        for c, cell in enumerate(row or [])
                    ]
                    rows.append((source, name, True, None, len(pages), [{"page_no": k, "text": t} for k, t in enumerate(pages, 1)], cells))
                except Exception as e:  # whatever a parser says of a broken file is that file's result
                    rows.append((source, name, False, f"{type(e).__name__}: {e}", None, None, None))
            yield pd.DataFrame(rows, columns=["source", "file_hash", "success", "error", "num_pages", "pages", "cells"])

    return files.mapInPandas(parse, PARSED)


def documents_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, file_hash, source, file_name) of the files that could be read: a document is named by its bytes, so it keeps its name where it is moved; of several places the smallest counts."""
    one = parsed.where("success").groupBy("file_hash").agg(F.min("source").alias("source"))
    return one.select(F.col("file_hash").alias("doc_id"), "file_hash", "source", F.substring_index("source", "/", -1).alias("file_name"))


def pages_and_cells(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of schemas.PAGES and schemas.CELLS of the files that could be read, each document once."""
    good = parsed.join(documents_of(parsed).select("doc_id", "source", "file_name"), "source")
    pages = good.select("doc_id", "file_name", F.explode("pages").alias("p")).select("doc_id", "file_name", "p.page_no", "p.text")
    cells = good.select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.*")
    return pages, cells


def read_documents(parsed: DataFrame, spec: str | None = None, full_text: bool = False, metadata: bool = True) -> DataFrame:
    """For each source: success, error, num_pages, page_texts and missing of the pages asked for, full_text where asked and no pages are."""
    out = parsed.select("source", "success", "error", *([F.col("num_pages")] if metadata else []), F.array_sort("pages").alias("_p"), F.size("pages").alias("_n"))
    if spec is None:
        return out.withColumn("full_text", F.when(F.lit(full_text), F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n"))).drop("_p", "_n")
    wished = page_ranges(F.lit(spec))
    parts = split_pages(wished, F.col("_n"))
    texts = F.filter("_p", lambda p: F.array_contains(wished, p["page_no"]))
    error = F.when(wished.isNull(), "bad page range").otherwise(F.col("error"))
    return out.withColumns({"page_texts": texts, "missing": F.when(F.col("success"), parts["missing"]), "error": error, "success": F.col("success") & wished.isNotNull()}).drop("_p", "_n")


def full_texts(pages: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, file_name, text): the pages that aren't empty, in order."""
    some = pages.where(F.coalesce("text", F.lit("")) != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), separator)
    return some.groupBy("doc_id", "file_name").agg(joined.alias("text"))


def table_sizes(cells: DataFrame) -> DataFrame:
    """(doc_id, page, table_index, n_rows, n_cols): columns are those of the first row."""
    return cells.groupBy("doc_id", "page", "table_index").agg((F.max("row_no") + 1).alias("n_rows"), F.count_if(F.col("row_no") == 0).alias("n_cols"))


def listed_files(spark: SparkSession, path: str, stock_code: str | None = None) -> DataFrame:
    """(path, modified, size) of the PDFs under a folder, newest first; of one stock's folder if asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    if stock_code:
        files = files.where(F.col("path").contains(f"/{stock_code}/"))
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "path")


def empty_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.PAGES)
