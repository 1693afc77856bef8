"""Documents as a Spark data source: one row a page, of which only those asked for are parsed.

    spark.dataSource.register(PagedDocuments)
    spark.read.format("paged_documents").option("parser", "filingmill.sources.paged:PlainText").load(folder).where("page_no in (1, 3)")

Files are dealt to partitions by size, each with a cost of its own. Many small documents go into few files by packed(), and are read
from there with the option `packed`. Filters on page_no go down to the parser (where the session has
spark.sql.python.filterPushdown.enabled). A parser is a class that takes a file's bytes, has a length and gives `page(k)`, from 1 on;
what it raises is that file's row, with an error and no page.
"""

from __future__ import annotations

import fnmatch
import hashlib
import importlib
import io
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, file_hash string, num_pages int, page_no int, text string, error string"
#: Bytes of files in a partition, unless one file has more.
PARTITION_BYTES = 64 << 20
#: Bytes that opening a file counts as, so that thousands of small ones don't go to one task.
OPEN_BYTES = 256 << 10
#: Packed documents that are held at once, and rows and characters that leave a worker together.
PACKED_ROWS, BATCH_ROWS, BATCH_CHARS = 64, 256, 4 << 20


class PlainText:
    """Plain text whose pages end with form feeds."""

    def __init__(self, content: bytes):
        self.pages = content.decode("utf-8").split("\f")

    def __len__(self) -> int:
        return len(self.pages)

    def page(self, number: int) -> str:
        return self.pages[number - 1]


class Pdf:
    """The text of a PDF's pages, each laid out only when it is asked for; needs the optional package pdfplumber."""

    def __init__(self, content: bytes):
        import pdfplumber

        self.pdf = pdfplumber.open(io.BytesIO(content))

    def __len__(self) -> int:
        return len(self.pdf.pages)

    def page(self, number: int) -> str:
        return self.pdf.pages[number - 1].extract_text() or ""


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Pages:
    """Page numbers that all the filters on page_no allow."""

    def __init__(self) -> None:
        self.low, self.high, self.only = 1, None, None

    def take(self, f: Filter) -> bool:
        """Takes a filter in, if it is one on page_no that this can hold."""
        if getattr(f, "attribute", None) != ("page_no",):
            return False
        if isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.only = values if self.only is None else self.only & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            most = f.value - isinstance(f, LessThan)
            self.high = most if self.high is None else min(self.high, most)
        else:
            return False
        return True

    def of(self, n: int) -> Iterable[int]:
        """Those of a document with n pages, in order; without looking at all n where few are asked for."""
        low, high = self.low, n if self.high is None else min(n, self.high)
        return range(low, high + 1) if self.only is None else sorted(k for k in self.only if k is not None and low <= k <= high)


def _loaded(name: str):
    module, _, of = name.partition(":")
    return getattr(importlib.import_module(module), of)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.parser, self.bytes, self.pages, self.pruned = options.get("parser", "filingmill.sources.paged:Pdf"), int(options.get("partitionBytes", PARTITION_BYTES)), Pages(), False
        self.packed = options.get("packed") == "true"

    def partitions(self) -> list[Files]:
        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = store.get_file_info(at)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        out, size = [[]], 0
        for f in sorted((f for f in found if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path):
            cost = f.size + OPEN_BYTES
            if out[-1] and size + cost > self.bytes:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += cost
        return [Files(tuple(paths)) for paths in out if paths]

    def _documents(self, store: fs.FileSystem, path: str) -> Iterator[tuple[str, Callable[[], bytes]]]:
        """The documents of a file, each with what reads it: the file itself, or those packed in it. A pack that can't be read fails the job, as its documents aren't known."""
        if not self.packed:

            def content() -> bytes:
                with store.open_input_stream(path) as f:
                    return f.read()

            yield path, content
            return
        with store.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(PACKED_ROWS, columns=["source", "content"]):
                for source, content in zip(batch["source"], batch["content"], strict=True):
                    yield source.as_py(), content.as_py

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        parser = _loaded(self.parser)
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        schema = pa.schema([("source", pa.string()), ("file_hash", pa.string()), ("num_pages", pa.int32()), ("page_no", pa.int32()), ("text", pa.string()), ("error", pa.string())])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        held, chars = [], 0
        for source, read in (x for path in partition.paths for x in self._documents(store, path)):
            rows, name = [], None
            try:
                content = read()
                name = hashlib.sha256(content).hexdigest()
                document = parser(content)
                n = len(document)
                rows = [(source, name, n, k, document.page(k), None) for k in self.pages.of(n)]
            except Exception as e:  # whatever a parser says of a broken file is that file's result
                # a filter that was taken in holds for this row too: it has no page
                rows = [] if self.pruned else [(source, name, None, None, None, f"{type(e).__name__}: {e}")]
            for row in rows:
                held.append(row)
                chars += len(row[4] or "")
                if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch(held)
                    held, chars = [], 0
        if held:
            yield batch(held)


class PruningReader(PagedReader):
    """Parses only the pages that filters ask for. Spark refuses it where the session doesn't push filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.pages.take(f):
                self.pruned = True
            else:
                yield f


class PagedDocuments(DataSource):
    """Options: path (a folder or a file, local to all executors or a URI that pyarrow knows), pattern, parser (module:class), partitionBytes, packed (true where the files are those of packed()), pushdown (true where the session pushes filters down to Python)."""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return (PruningReader if self.options.get("pushdown") == "true" else PagedReader)(self.options)


_NAMES: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def _registered(spark: SparkSession) -> str:
    """The source's name in this session. Sessions of an application don't see each other's sources, but no two may share a name."""
    if spark not in _NAMES:
        name = f"paged_documents_{uuid.uuid4().hex}" if _NAMES else PagedDocuments.name()
        spark.dataSource.register(type("Named", (PagedDocuments,), {"name": classmethod(lambda cls: name)}))
        _NAMES[spark] = name
    return _NAMES[spark]


def paged_documents(spark: SparkSession, path: str, parser: str = "filingmill.sources.paged:Pdf", pattern: str = "*", partition_bytes: int = PARTITION_BYTES, is_packed: bool = False) -> DataFrame:
    """The pages of the files at a path, or of the documents packed in them: (source, file_hash, num_pages, page_no, text, error)."""
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(_registered(spark)).option("parser", parser).option("pattern", pattern).option("partitionBytes", partition_bytes).option("packed", str(is_packed).lower()).option("pushdown", pushdown).load(path)


def packed(documents: DataFrame, path: str) -> None:
    """Writes documents (source, content) to a folder, a file for each of their partitions: a file for each document costs its creation and its commit, one after the other in the driver."""
    documents.selectExpr("cast(source as string) as source", "cast(content as binary) as content").write.parquet(path)


def checked_requests(requests: DataFrame) -> DataFrame:
    """requests (path, url, pages) with `problem`: a source has a path or a url, not both, and pages, if given, are digits, commas and hyphens that name at least one page."""
    from pyspark.sql import functions as F

    from ..functions.arrays import page_ranges

    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    spec = F.regexp_replace("pages", r"\s", "")
    bad = F.col("pages").isNotNull() & (~F.coalesce(spec.rlike("^[0-9,-]+$"), F.lit(False)) | page_ranges(F.col("pages")).isNull())
    return requests.withColumn("problem", F.when(given("path") == given("url"), "path_or_url").when(bad, "pages"))
