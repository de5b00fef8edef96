"""Registration of queries with their SQL, and pieces of SQL made from the vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its own name; without SQL it is checked by tests alone."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(text: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in terms) + ")" if terms else "false"


def sql_says(text: str, term: str) -> str:
    from siftline import vocab

    return sql_any(f"lower({text})", vocab.variants(term))


def sql_matches(text: str, terms: Sequence[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {sql_says(text, t)} THEN {quoted(t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"
