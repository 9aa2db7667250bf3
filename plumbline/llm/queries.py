"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, divergence, fingerprints, htmltext, licenses, linededup, merkle, minhash, oracles, toxicity, transducer, vectordup, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of ``documents`` on 4-word shingles."""
    return minhash.near_duplicates(spark, _read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` inside occurrences of 10-word windows of ``benchmark``."""
    found = decontaminate.contamination(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every text of ``documents`` by byte-level BPE."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(spark, _read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).drop("ok")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to indexed WARC archives and read back."""
    return warc.round_trip(spark, _read(spark, sf_dir, "pages"), least=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text of ``documents``."""
    return transducer.token_counts(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections in every text of ``documents``."""
    found = licenses.scan(_read(spark, sf_dir, "documents"))
    word = F.transform("places", lambda p: p.word)
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that occur on five or more sources, but for the first document with each."""
    out = linededup.dedup_lines(spark, _read(spark, sf_dir, "documents"), sites=5)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text of ``documents`` by a model of the rows that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    scores = toxicity.score(spark, docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of ``embeddings`` at a cosine of 0.93 within a label."""
    return vectordup.near_duplicates(spark, _read(spark, sf_dir, "embeddings"), least=0.93)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of ``documents`` by their distance within a language, and the terms that mark each."""
    return divergence.audit(spark, _read(spark, sf_dir, "documents"), least=30, top=50)


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of ``documents`` and their edited texts, and how like they are to those and to the next document's."""
    return fingerprints.fingerprints(spark, _read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of ``documents``, and what a tampered row's proof gives."""
    return merkle.manifest(spark, _read(spark, sf_dir, "documents"), merkle.lowered())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_warc": op4_warc,
        "op5_token_counts": op5_token_counts,
        "op6_license_scan": op6_license_scan,
        "op7_line_dedup": op7_line_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_main_text": op10_main_text,
        "op11_source_divergence": op11_source_divergence,
        "op12_document_fingerprints": op12_document_fingerprints,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": oracles.MINHASH,
        "op2_decontamination": oracles.DECONTAMINATION,
        "op4_warc": warc.ORACLE_SQL,
        "op7_line_dedup": linededup.ORACLE_SQL,
        "op9_embedding_near_dedup": oracles.VECTORS,
        "op11_source_divergence": divergence.ORACLE_SQL,
        "op13_merkle_manifest": merkle.ORACLE_SQL,
    }
