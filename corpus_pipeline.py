"""From raw documents to sharded training data: five stages, each written and read again.

quality          documents that the quality classifier rejects go
near_duplicates  of each component of linked documents the smallest doc_id stays
decontamination  documents that leak a benchmark item go
mixing           the remaining rows, all of them, written in the order of the Pfair schedule
sharding         stretches of that order with near-equal bytes: texts, shard and slot

Shards follow the order in which the mixing stage wrote its rows, so reading shard by shard and slot
by slot is reading the mix: each shard of its mixed part holds the sources in their target shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framescope.llm import decontamination, jaccard_join, mixing, quality, sharding
from framescope.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those the classifier, fitted on docs and labels, rejects. Null or empty text is
    judged by the model's bias; without labels of both kinds every score is 0.5 and nothing stays;
    repeated rows share their fate; no rows in, none out."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component. Null, empty and blank texts link with nothing and stay, as do
    rows of null doc_id; rows that repeat a doc_id share its fate; no rows in, none out."""
    return jaccard_join.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that leak an item. Null or empty texts and items leak nothing; an empty
    benchmark takes nothing away; no rows in, none out."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, sorted by the mix; null source is a source. Rows past the first source's end
    follow the mix; no rows in, none out."""
    return mixing.in_order(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs with size, text_crc32, law, shard, slot, grown_shard, in docs' reading order
    (by a hash of the text where docs does not come from files). Null text has no bytes; no rows in,
    none out."""
    return sharding.shard(docs, order=sharding.reading_order(docs), keep=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None  # the classifier is trained; tests compare run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
