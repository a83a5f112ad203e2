"""The queries of the training-data operators, over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, kneserney, manifest, media, mixing, periodic, pii, positive, records, rules, simhash, suffixes, tries
from .shared import scratch, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.token_counts(_table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_private(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_private")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.score_documents(_table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "digest", "shard", "offset", "length")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positive.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, some with looping tails (periodic.with_loops), and the digest of what is left. Null and empty texts have no runs; repeated rows stay; an empty table gives no rows."""
    docs = periodic.with_loops(_table(spark, sf_dir, "documents"))
    return written(periodic.run_columns(periodic.collapse_runs(docs)), scratch(spark, "periodic") + "/documents")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, proof and what follows from a row that may be tampered with. Nulls are told from empty values; repeated rows are leaves of their own; an empty table gives no rows."""
    return manifest.check_manifest(_table(spark, sf_dir, "documents"))


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text as records in shards, read back. Null and empty texts are the end id alone; repeated rows are records of their own; an empty table gives no rows."""
    return records.token_records(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_simhash, op3_token_counts, op4_pii_surrogates, op5_kneser_ney, op6_media_columns, op7_quality_rules, op8_source_mix, op9_quality_classifier, op10_byte_bpe, op11_periodic_runs, op12_merkle_manifest, op13_token_records)}
ORACLE = {"op12_merkle_manifest": manifest.SQL}
