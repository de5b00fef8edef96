"""Documents made ready for training, stage by stage; each stage works on all that the one before it kept.

Every stage takes an empty table, null and empty texts, null ids, repeated rows and further columns; what each makes of them is
said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import decontam, mixing, sharding, simhash, toxicity
from siftline.llm.common import discard, materialise, read, workspace


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score 0.5 or more. Null and empty texts score 0 and stay; repeated rows share their fate."""
    return toxicity.keep_civil(docs, read(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that of the smallest id, a null id before all.

    All null and empty texts are one group. Rows of one id with unrelated texts are documents of their own; of rows that repeat
    id and text one stays.
    """
    return simhash.keep_first(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages. Null and empty texts hold none and stay; repeated rows share their fate."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat the documents of small sources up to the repetition limit. No row is lost; a null source is one of its own."""
    return mixing.mix(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the rows into eight shards of near equal bytes: all columns, and shard and slot. Equal texts share a shard, null with empty."""
    return sharding.shard(docs)


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("mix", _mix), ("shard", _shard)]
#: The toxicity model and XXH64 fingerprints have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. What a stage has written besides goes when it ends."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with workspace(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, outlives=True)
        if before is not None:
            discard(before)
        before = docs
    return docs
