"""The library's front: a ledger of filings over a session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from .operators import candidates, facts, periods, registry, tables
from .sources import documents as docs
from .staging import staged


@dataclass(frozen=True)
class Settings:
    """Bounds of requests and clean-ups."""

    search_limit: int = 20
    most_results: int = 100
    keep_days: int = 90
    cache_days: int = 30
    extractor_version: str = "1"


@dataclass(frozen=True)
class Extraction:
    """What one run over parsed documents gives; each is a DataFrame keyed by doc_id."""

    documents: DataFrame
    periods: DataFrame
    records: DataFrame
    facts: DataFrame
    evidence: DataFrame
    quality: DataFrame

    def confident(self, least: float) -> Extraction:
        kept, q = facts.confident(self.facts, self.quality, least)
        return Extraction(self.documents, self.periods, self.records, kept, self.evidence, q)

    def v1(self) -> DataFrame:
        """The records alone, as the first schema had them."""
        return self.documents.select("doc_id", "stock_code", "report_type", "fiscal_year").join(self.records.drop("derived"), "doc_id")


class Ledger:
    """Search and extraction over tables of filings."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def search(self, table: DataFrame, **wanted) -> DataFrame:
        limit = min(wanted.pop("limit", self.settings.search_limit), self.settings.most_results)
        return registry.search(table, limit=limit, **wanted)

    def extract(self, pages: DataFrame, cells: DataFrame, paths: DataFrame | None = None, parity: bool = False) -> Extraction:
        """Parsed pages and cells (schemas.PAGES, schemas.CELLS) to facts. paths: (doc_id, path), where known."""
        texts = docs.full_texts(pages)
        texts = texts.join(paths, "doc_id", "left") if paths is not None else texts.withColumn("path", texts["file_name"])
        identified = staged(periods.identified(texts))
        known = identified.select("doc_id", "lang", "fiscal_year", "currency", "amount_unit", "kind", "stock_code", "report_type")
        spans = staged(periods.periods(known))
        best = candidates.best(identified)
        records = self.records(identified, best)
        records = staged(facts.derive(tables.table_pass(records, tables.table_values(cells, known))))
        seen = staged(tables.observations(cells, known))
        ledger, evidence = facts.build_facts(records, spans, seen, known, parity)
        segments = tables.table_profiles(cells, known).where("is_segment")
        ledger, evidence = staged(ledger), staged(evidence)
        quality = facts.quality(known, facts.issues(ledger, spans, segments))
        return Extraction(identified.drop("text"), spans, records, ledger, evidence, quality)

    @staticmethod
    def records(documents: DataFrame, best: DataFrame) -> DataFrame:
        """One wide row for each document, by its best text candidates."""
        from pyspark.sql import functions as F

        from .vocab import FIELDS

        wide = best.groupBy("doc_id").agg(*(F.max(F.when(F.col("field") == m, F.col("value"))).alias(m) for ms in FIELDS.values() for m in ms))
        return documents.select("doc_id").join(wide, "doc_id", "left")
