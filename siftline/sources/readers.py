"""Sources: input items from files of several formats, one normal schema; connectors behind one interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import html as H

ITEM = "item_id string, text string, title string, source_uri string, content_type string, metadata map<string,string>"
# --- Fixed values: columns looked for, in order of preference
ID_COLUMNS = ("item_id", "id", "domain", "key", "name", "slug")
TEXT_COLUMNS = ("text", "research", "content", "body", "description", "summary", "input")


def _pick(columns: list[str], preferred: tuple[str, ...], given: str | None) -> str | None:
    if given:
        if given not in columns:
            raise ValueError(f"no column {given!r} in {columns}")
        return given
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[p] for p in preferred if p in low), None)


def resolved(table: DataFrame, *, id_column: str | None = None, text_column: str | None = None, title_column: str | None = None, uri_column: str | None = None, content_type: str = "text/plain") -> DataFrame:
    """Items of any table: id and text by the preferred names, else the first column and the first other one; the rest is metadata."""
    columns = table.columns
    key = _pick(columns, ID_COLUMNS, id_column) or columns[0]
    text = _pick([c for c in columns if c != key], TEXT_COLUMNS, text_column) or next((c for c in columns if c != key), key)
    title, uri = _pick(columns, ("title",), title_column), _pick(columns, ("source_uri", "url"), uri_column)
    rest = [c for c in columns if c not in (key, text, title, uri)]
    extra = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(f"`{c}`").cast("string") for c in rest])) if rest else F.create_map().cast("map<string,string>")
    text_of = lambda c: F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")
    return table.select(
        F.regexp_replace(F.trim(text_of(key)), "[ /:]", "_").alias("item_id"), text_of(text).alias("text"), text_of(title).alias("title"), text_of(uri).alias("source_uri"),
        F.lit(content_type).alias("content_type"), F.map_filter(extra, lambda _, v: v.isNotNull()).alias("metadata"),
    )


def _whole(spark: SparkSession, path: str, content_type: str, text: Callable[[Column], Column]) -> DataFrame:
    own = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    name = F.regexp_replace(F.regexp_extract("file", "([^/]+)$", 1), "[^A-Za-z0-9_.-]", "_")
    none = F.lit(None).cast("string")
    return own.select(name.alias("item_id"), text(F.col("value")).alias("text"), none.alias("title"), F.col("file").alias("source_uri"), F.lit(content_type).alias("content_type"), F.create_map().cast("map<string,string>").alias("metadata"))


def items(spark: SparkSession, path: str, **columns) -> DataFrame:
    """Items of a file or folder by its suffix: .csv, .jsonl, .json (an array, or an object with items), .txt, .md, .html, .parquet."""
    kind = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return resolved(spark.read.csv(path, header=True, multiLine=True, escape='"'), **columns)
    if kind == "jsonl":
        return resolved(spark.read.json(path, mode="FAILFAST"), **columns)
    if kind == "json":
        table = spark.read.json(path, multiLine=True, mode="FAILFAST")
        return resolved(table.select(F.explode("items").alias("i")).select("i.*") if table.columns == ["items"] else table, **columns)
    if kind == "parquet":
        return resolved(spark.read.parquet(path), **columns)
    if kind in ("html", "htm"):
        return _whole(spark, path, "text/html", H.stripped)
    if kind in ("txt", "md"):
        return _whole(spark, path, "text/markdown" if kind == "md" else "text/plain", lambda c: c)
    raise ValueError(f"no reader for {kind!r}")


#: name -> function of (spark, options) that gives item rows. Live backends need a network; a table stands for any of them.
CONNECTORS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {}


def connector(name: str):
    def register(function: Callable[[SparkSession, dict], DataFrame]):
        CONNECTORS[name] = function
        return function

    return register


@connector("table")
def _table(spark: SparkSession, options: dict) -> DataFrame:
    return resolved(spark.read.parquet(options["path"]), **{k: v for k, v in options.items() if k != "path"})


def discover(spark: SparkSession, backend: str, **options) -> DataFrame:
    return CONNECTORS[backend](spark, options)


def write_csv(records: DataFrame, path: str) -> None:
    """One CSV column for each field, nested ones as JSON."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in records.schema.fields]
    records.select(*flat).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_rungs(rows: DataFrame, path: str) -> None:
    """Attempts are partitions: writing one again replaces it alone, so a retried node leaves one copy."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dag_id", "node_id", "run_seq").parquet(path)
