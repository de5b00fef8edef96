"""A lane as a chain of named DataFrame steps over candidates; each step's table is written, so a run resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import vocab
from siftline.operators import gates

Step = tuple[str, Callable[[DataFrame], DataFrame]]


def run(spark: SparkSession, candidates: DataFrame, steps: Sequence[Step], path: str, *, resume: bool = True) -> DataFrame:
    """Apply the steps in order; a step whose table is complete under ``path`` is read instead of run again."""
    names = [n for n, _ in steps]
    if len(set(names)) != len(names):
        raise ValueError("step names repeat")
    fs = spark._jvm.org.apache.hadoop.fs
    now = candidates
    for name, step in steps:
        target = f"{path.rstrip('/')}/{name}"
        done = fs.Path(f"{target}/_SUCCESS")
        if not (resume and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)):
            step(now).write.mode("overwrite").parquet(target)
        now = spark.read.parquet(target)
    return now


def lane(profile: gates.Profile, ladder=vocab.LADDER) -> list[Step]:
    """A step for each rung: gate what still stands on the gates that rung can settle; the eliminated stay in the table."""

    def rung(name: str, grade: str, settles: tuple[str, ...]) -> Step:
        asked = gates.Profile(
            profile.allows if "kind" in settles else "any", profile.size_min if "size" in settles else 0, profile.size_max if "size" in settles else 0,
            profile.locations if "location" in settles else (), profile.verticals if "vertical" in settles else (),
        )

        def step(rows: DataFrame) -> DataFrame:
            standing = rows.drop("open", "fetched", "results", "verdict", "because", "earned", "advances").withColumn("evidence", F.lit(grade))
            return gates.rung_rows(standing.where("NOT eliminated"), asked).withColumn("rung", F.lit(name)).withColumn("eliminated", F.col("verdict") == "eliminated")

        return name, step

    return [rung(*r) for r in ladder]
