"""The corpus operators as queries over the shared tables, each over its whole table; ORACLE_SQL has what SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .centroids import centroid_clusters
from .chat import chat_digests, probe
from .common import table
from .decontaminate import contamination
from .divergence import source_divergence
from .html_text import main_texts
from .licenses import license_scan
from .line_dedup import line_dedup
from .minhash_dedup import near_duplicates
from .packing import best_fit_packing
from .quality import quality_scores
from .secrets import secret_scan
from .suffix_dedup import suffix_dedup
from .topk import top_products


def public_vocabulary() -> dict[str, str]:
    """Where the public byte-level vocabulary lies, as arguments for packing."""
    import public_tokenizers

    return {"tokenizer": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "end_id": 2}


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), **public_vocabulary())


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=80)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["template"].cast("string"), x["start"].cast("string"), x["end"].cast("string")))
    return license_scan(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(said, ","))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(rows.unionByName(probe(spark)))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "expected_grade", "p_above_0", "p_above_1", "accepted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_cut_lines", "n_cut_words", "n_left_words", "earlier")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False)


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_exact_topk": op2_exact_topk,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

#: HTML trees, packing, the classifier and patience diff have no SQL; tests/llm compares them with brute force.
ORACLE_SQL = {
    "op2_exact_topk": oracles.TOPK,
    "op4_secret_scan": oracles.SECRETS,
    "op5_minhash_dedup": oracles.NEAR_DUPLICATES,
    "op6_license_scan": oracles.LICENSES,
    "op7_chat_formatting": oracles.CHAT,
    "op9_decontamination": oracles.CONTAMINATION,
    "op11_source_divergence": oracles.DIVERGENCE,
}
