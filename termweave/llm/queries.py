"""The operN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import bpe, fingerprints, jaccard, lines, mixing, pii, quality, suffixes, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("doc_id", "votes", "p_junk", "p_abuse", "score", "keep")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode_documents(docs, with_ids=False, columns=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_counts(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents", "doc_id", "text"), columns=["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_bpe, op3_url_filters, op4_fingerprints, op5_exact_top_k, op6_line_dedup, op7_mixing, op8_pii, op9_suffix_dedup, op10_ngram_jaccard)}
