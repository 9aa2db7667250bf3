"""Document pipeline: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run() writes each stage's rows as
Parquet in the shared folder and rereads them. All stages but the last return the columns of ``documents``; other
columns, whatever their names, are not read.

In every stage a null text is an empty one, an empty table gives an empty table, and rows are judged one by one: a
null or repeated doc_id neither shields a row nor condemns another.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, linededup, minhash, toxicity
from plumbline.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, by a model of the labelled rows that are not held out."""
    model = toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return toxicity.with_scores(spark, docs.select(*COLUMNS), model).where("score < 0.3").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur on five or more sources, but for the first document with each; those of
    which nothing is left, all their lines being in earlier documents, go."""
    out = linededup.dedup_lines(spark, docs.select(*COLUMNS), sites=5)
    emptied = (F.col("n_removed") > 0) & (F.btrim("text", F.lit(" \t\r\n")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~emptied).withColumn("n_chars", n_chars).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class (five words a shingle, similarity 0.8): that with the smallest doc_id, the
    first of equal ones; null ids come last. Rows without words are in no class and stay."""
    scratch = Scratch(spark, "classes")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    classes = minhash.near_duplicates(spark, rows.select(F.col("row").alias("doc_id"), "text"), shingle=5, percent=80)
    classes = scratch.save(classes.where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id"), "classes")
    shared = classes.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = scratch.save(classes.join(scratch.save(shared, "shared"), "component_id"), "members")
    named = rows.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("rank")).join(members, "row")
    keepers = named.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    gone = members.select("row").join(keepers, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.uncontaminated(spark, docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"), width=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the bytes decoded from them, of each document."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_digests(spark, docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and reread."""
    scratch = Scratch(spark, "pipeline")
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, before = scratch.save(stage(spark, docs, sf_dir), name), docs
        scratch.drop(before)
    return docs


#: The learned score and the similarity classes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
