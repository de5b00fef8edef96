"""Files that leave the engine: dossiers, rung tables, packets with their digest, frozen inputs; and id lists that enter it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.sources.readers import ID_COLUMNS

DOSSIER_COLUMNS = ("item_id", "text", "source_uri", "source_count", "source_categories", "source_backends", "source_uris")
RUNG_COLUMNS = ("item_id", "candidate", "rung", "evidence", "outcome", "earned", "because", "score", "tier")


def cell(table: DataFrame, name: str) -> Column:
    """A column as a CSV cell: words as they are, null as nothing, nested values as JSON."""
    nested = isinstance(table.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
    own = F.col(f"`{name}`")
    return F.coalesce(F.to_json(own) if nested else own.cast("string"), F.lit("")).alias(name)


def _csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_dossiers(dossiers: DataFrame, path: str) -> None:
    """dossiers of any of DOSSIER_COLUMNS: these in their order, lists joined (addresses by blanks, others by commas), a missing count as 1."""
    made = []
    for name in DOSSIER_COLUMNS:
        if name not in dossiers.columns:
            made.append(F.lit("1" if name == "source_count" else "").alias(name))
        elif isinstance(dossiers.schema[name].dataType, T.ArrayType):
            made.append(F.array_join(name, " " if name == "source_uris" else ",").alias(name))
        else:
            made.append(F.coalesce(F.col(name).cast("string"), F.lit("1" if name == "source_count" else "")).alias(name))
    _csv(dossiers.select(*made), path)


def write_rung_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = RUNG_COLUMNS) -> None:
    """The usual columns that there are first, in their order, then all others."""
    names = [*[c for c in columns if c in rows.columns], *[c for c in rows.columns if c not in columns]]
    _csv(rows.select(*[cell(rows, n) for n in names]), path)


def digest(records: DataFrame) -> DataFrame:
    """(n, digest): how many rows, and a digest of them that no order changes; equal tables have equal ones."""
    line = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(records.columns)]), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(line, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31, 46)]
    sums = records.select(*[h.alias(f"h{i}") for i, h in enumerate(halves)]).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"s{i}" for i in range(4)]), 256).alias("digest"))


def write_packet(records: DataFrame, path: str, *, run_id: str, task: dict, receipts: DataFrame | None = None) -> None:
    """A packet: ``records`` as JSON lines, and a ``header`` of one line with the task, the totals and the records' digest.

    receipts (cost, tokens) may lack costs; those are left out of the sum.
    """
    records.write.mode("overwrite").json(f"{path}/records")
    n, found = digest(read_records(records.sparkSession, path)).first()
    cost, tokens = receipts.agg(F.sum("cost"), F.sum("tokens")).first() if receipts is not None else (None, None)
    header = {"run_id": run_id, "task": task, "total_records": n, "digest": found, "total_cost": cost or 0.0, "total_tokens": tokens or 0}
    records.sparkSession.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/records")


def read_packet(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """Header and records of a packet; raises if the records are not those that were written, or if item ids repeat."""
    header, records = json.loads(spark.read.text(f"{path}/header").first()["value"]), read_records(spark, path)
    n, found = digest(records).first()
    if (n, found) != (header["total_records"], header["digest"]):
        raise ValueError(f"{n} records with digest {found}, the header says {header['total_records']} with {header['digest']}")
    if "item_id" in records.columns and records.groupBy("item_id").count().where("count > 1").limit(1).count():
        raise ValueError("item ids repeat")
    return header, records


def freeze(inputs: dict[str, DataFrame], path: str, *, run_id: str, sampled: list[str]) -> dict:
    """Copies of a run's inputs, and a manifest of their digests and of the ids that were sampled."""
    manifest: dict = {"run_id": run_id, "sampled": sampled, "inputs": {}}
    for name, table in inputs.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        n, found = digest(table.sparkSession.read.parquet(f"{path}/{name}")).first()
        manifest["inputs"][name] = {"rows": n, "digest": found}
        table.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_read_out(rows: DataFrame, path: str) -> None:
    """The read-out of evidence as JSON, a line for each entity."""
    rows.write.mode("overwrite").json(path)


def ids(spark: SparkSession, given: str | list[str] | set[str]) -> DataFrame:
    """(item_id): a list of ids, from a collection, a text parted by commas, semicolons or lines, or a .csv, .json, .jsonl or .txt file."""
    if not isinstance(given, str):
        listed = spark.createDataFrame([(str(g),) for g in given], "item_id string")
    elif (kind := given.rstrip("/").rsplit(".", 1)[-1].lower()) in ("csv", "json", "jsonl", "txt") and not any(c in given for c in ",;\n"):
        if kind == "txt":
            listed = spark.read.text(given).select(F.col("value").alias("item_id"))
        else:
            table = spark.read.csv(given, header=True) if kind == "csv" else spark.read.json(given, multiLine=kind == "json")
            if table.columns == ["records"]:
                table = table.select(F.explode("records").alias("r")).select("r.*")
            name = next((c for c in ID_COLUMNS if c in table.columns), table.columns[0])
            listed = table.select(F.col(f"`{name}`").cast("string").alias("item_id"))
    else:
        listed = spark.createDataFrame([(given,)], "t string").select(F.explode(F.split("t", "[,;\n]")).alias("item_id"))
    return listed.select(F.trim("item_id").alias("item_id")).where("item_id <> ''").distinct()
