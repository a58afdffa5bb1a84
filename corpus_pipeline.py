"""From raw documents to shards: the corpus operators in a row.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every stage but
the last returns the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontam, langid, mixing, neardup, sharding
from ledgerlens.llm.common import saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, or undecided, go."""
    return langid.in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8)."""
    return neardup.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard) of every document of the mix, eight shards of near-equal bytes."""
    size = sharding.text_bytes(F.col("text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    facts = docs.select("doc_id", "source", "lang", size.alias("bytes"), crc.alias("text_crc32"))
    placed = sharding.kd_shards(facts, F.col("bytes"), sharding.metadata(F.col("bytes")), F.xxhash64("doc_id", "text_crc32"), leaves=8)
    return placed.select("doc_id", "size", "text_crc32", "shard")


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mix), ("sharding", shards),
]

#: The language model's sums of logarithms are not the same to the last digit in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
