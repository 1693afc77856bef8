"""The training-data pipeline over documents: score, cut repeated lines, drop near-duplicates, decontaminate, pack.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents,
but for the last, which returns the packed pieces. run() writes each stage's result to the shared folder and reads it
again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingmill.llm.common import table
from filingmill.llm.decontaminate import contamination
from filingmill.llm.line_dedup import line_dedup
from filingmill.llm.minhash_dedup import near_duplicates
from filingmill.llm.packing import best_fit_packing
from filingmill.llm.quality import quality_scores
from filingmill.llm.queries import public_vocabulary
from filingmill.staging import shared_folder

#: The similarity of near copies, on shingles of five words.
NEAR = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the ordinal classifier accepts."""
    return quality_scores(docs, table(spark, sf_dir, "labels")).where("accepted").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated blocks of lines from later documents; one of which nothing is left goes. Near copies of one document stay whole for the next stage, which drops them."""
    cut = line_dedup(docs, near_copies=NEAR)
    left = cut.where((F.col("n_cut_lines") == 0) | (F.col("n_left_words") > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_cut_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates."""
    gone = near_duplicates(docs, percent=round(100 * NEAR)).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    bad = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return best_fit_packing(docs, **public_vocabulary())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("packing", packed)]

#: No SQL: the classifier, the sketches and the packing aren't expressible; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
