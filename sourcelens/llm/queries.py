"""The training-data queries: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, line_dedup, merkle, merkle_manifest, minhash, packing, periodic, pii, quality_classifier, quality_rules, simhash, warc
from .common import shared_path, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def remainder(of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`: the contracts' folds."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % of


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(remainder(5) != 0))
    out = quality_classifier.score(docs, model, ["doc_id"])
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.train_and_identify(docs, remainder(4) != 2)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), shared_path(spark, "warc")
    warc.write_archive(pages, path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ids=False)


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic.with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic.collapse_documents(planted, collapsed=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.document_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_best_fit_packing, op4_quality_classifier, op5_merkle_fingerprints, op6_pii, op7_simhash, op8_language_id, op9_warc, op10_byte_bpe, op11_hyperminhash, op12_periodic_runs, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_quality_rules": quality_rules.SQL, "op5_merkle_fingerprints": merkle.SQL, "op9_warc": warc.SQL, "op11_hyperminhash": minhash.SQL, "op13_merkle_manifest": merkle_manifest.SQL}
