"""The registered queries of this package: thin calls of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import alignment, ann, codes, decontam, mixing, pii, sharding, simhash, substring, suffix, toxicity, urlfilter, vafile
from siftline.llm.common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.repeated_urls(pages))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(read(spark, sf_dir, "embeddings"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_url_filter, op4_substring, op5_toxicity, op6_pii, op7_simhash, op8_nearest, op9_suffix_array, op10_decontamination, op11_alignment, op12_vector_codes, op13_exact_topk)}
#: SQL for those that SQL expresses at a bearable cost; the others are tested against brute force.
ORACLES = {"op1_mixing": mixing.ORACLE_SQL, "op3_url_filter": urlfilter.ORACLE_SQL, "op4_substring": substring.ORACLE_SQL, "op8_nearest": ann.ORACLE_SQL, "op9_suffix_array": suffix.ORACLE_SQL, "op10_decontamination": decontam.ORACLE_SQL, "op12_vector_codes": codes.ORACLE_SQL, "op13_exact_topk": vafile.ORACLE_SQL}
