"""The corpus pipeline: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each
result as Parquet in the shared folder and reads it back as the next one's docs.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finscope.llm import bpe, decontamination, language_id, line_dedup, queries, simhash
from finscope.scratch import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go; the others keep their columns as they are."""
    out = language_id.predicted(docs, language_id.fit(docs))
    return out.where(~F.col("lang_rejected")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows are cut from the texts; n_chars follows, and a text left empty goes."""
    out = line_dedup.deduped(docs)
    out = out.where((F.col("n_lines_removed") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more; candidates with a recall of 0.97 there."""
    return simhash.deduped(docs, width=5, recall=0.97, min_similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a check that they decode to its text."""
    out = bpe.encoded(docs.select("doc_id", "lang", "text"), queries.tokenizer(spark, keep=32 << 20), decode=True)
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return out.select("doc_id", "lang", "n_tokens", "ids", whole.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("benchmark_decontamination", decontaminate),
    ("byte_level_bpe", encode),
]

#: SQL can't express the classifier, the fingerprints, the alignment or the encoder; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
