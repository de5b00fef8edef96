"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java class of ASCII white space, as the words of this package are split by it.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Stands for a null document id inside joins and orders; it sorts first.
NULL_ID = -(2**63)
#: Tables written and not yet deleted; the last list is that of the innermost workspace.
_written: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset a local session gets a folder of its own; a cluster has none that executors share, so there it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str, *, outlives: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors.

    The table lasts until the workspace around the call ends (with ``outlives``, that around this one); without one, until the
    driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftline-{name}-{uuid.uuid4().hex}"
    _written[max(-len(_written), -2) if outlives else -1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables at once: for those that nothing reads any more, as what came of them is written too."""
    for df in tables:
        _delete(df.sparkSession, [df._written_to])
        for level in _written:
            if df._written_to in level:
                level.remove(df._written_to)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were materialised inside it; what is still needed must have been written elsewhere."""
    _written.append([])
    try:
        yield
    finally:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clear() -> None:
    spark = SparkSession.getActiveSession()
    with suppress(Exception):  # the session may have been stopped, or its gateway be gone
        if spark is not None:
            _delete(spark, [p for level in _written for p in level])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Join key of a document: its id, never null, and a hash of its text. Repeated rows share both."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)), F.xxhash64(text)


def single(own: DataFrame) -> DataFrame:
    """(id, tkey, text) with each repeated row once. Keys alone are shuffled, and the texts of repeated rows."""
    again = materialise(own.groupBy("id", "tkey").agg(F.count("*").alias("n")).where("n > 1").select("id", "tkey"), "repeated-rows")
    if again.isEmpty():
        return own
    return own.join(again, ["id", "tkey"], "left_anti").unionByName(own.join(again, ["id", "tkey"], "left_semi").dropDuplicates(["id", "tkey"]))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, whatever it holds."""
    known, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in known:
        name = f"_{name}"
    return name


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle has in this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
