"""The training-data pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import chunks, minhash, mixing, packing, queries, rules
from almanac.llm.common import drop, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without chunks that an earlier document has; n_chars follows the text.
    Documents that lose every word go."""
    out = chunks.dedup_substrings(docs)
    spans = F.col(chunks.added_columns(docs)[0])
    left = out.where((F.size(spans) == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)[1]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = packing.Pack()
    return packing.pack(docs, queries.tokenizer(p.tokenizer), p)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's files go once the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            drop(docs)
        docs = done
    return docs


#: Fingerprints, chunks and token ids have no SQL form here; tests hold run() against a plain model.
ORACLE_SQL = None
