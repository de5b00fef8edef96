"""Why a lane falls short of its quota: numbers that partition what surfaced, and findings with their levers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What holds a lane back, and what moves it.
LEVERS = {
    "funnel": "widen the evidence, or check the gate that eliminates most against the lane's own words",
    "bar": "lower the least score, or gather the evidence that the checklist pays for",
    "search": "add terms to the lane's queries, or search more of them in a round",
}
#: A funnel is narrow where so many surface for one that stands; a bar is near where the best below it reaches this share of it.
NARROW, CLOSE = 4, 0.85


def shortfall(events: DataFrame, *, least_score: float, worst: int = 3) -> DataFrame:
    """events (lane, entity, event_id, rung, outcome, score) -> (lane, surfaced, stood, eliminated, scored, below, best_below, eliminated_at, findings, stage, lever).

    surfaced = stood + eliminated: an entity counts once in its lane, as eliminated at the first rung that did so, or else as standing.
    eliminated_at has the ``worst`` rungs with their numbers (``rung: n``), the largest first. An entity's score is its last that isn't
    zero or less. findings are funnel, bar, or search if neither holds; stage is the first, lever what it takes. A null lane is one
    of its own.
    """
    out, scored = F.when(F.col("outcome") == "eliminated", F.col("event_id")), F.when(F.col("score") > 0, F.col("event_id"))
    entities = events.groupBy("lane", "entity").agg(F.min_by("rung", out).alias("fell"), F.min(out).isNotNull().alias("gone"), F.max_by("score", scored).alias("score"))
    low = F.col("score") < least_score
    rungs = entities.groupBy("lane", "fell", "gone").agg(
        F.count("*").alias("n"), F.count("score").alias("scored"), F.count_if(F.coalesce(low, F.lit(False))).alias("below"), F.max(F.when(low, F.col("score"))).alias("best_below")
    )
    # A row for each rung of a lane is left; the rungs of a lane are few.
    fallen = F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct((-F.col("n")).alias("n"), F.coalesce("fell", F.lit("")).alias("rung")))))
    lanes = rungs.groupBy("lane").agg(
        F.sum("n").alias("surfaced"), F.sum(F.when(F.col("gone"), 0).otherwise(F.col("n"))).alias("stood"), F.sum("scored").alias("scored"), F.sum("below").alias("below"), F.max("best_below").alias("best_below"),
        F.transform(F.slice(fallen, 1, worst), lambda r: F.concat(r["rung"], F.lit(": "), (-r["n"]).cast("string"))).alias("eliminated_at"),
    )
    narrow = (F.col("stood") > 0) & (F.col("surfaced") >= NARROW * F.col("stood"))
    close = F.coalesce(F.col("best_below") >= CLOSE * least_score, F.lit(False))
    found = F.array_compact(F.array(F.when(narrow, F.lit("funnel")), F.when(close, F.lit("bar")), F.when(~narrow & ~close, F.lit("search"))))
    stage = F.get("findings", F.lit(0))
    lever = F.element_at(F.create_map(*(F.lit(x) for pair in LEVERS.items() for x in pair)), stage)
    out = lanes.withColumn("findings", found).withColumns({"eliminated": F.col("surfaced") - F.col("stood"), "stage": stage, "lever": lever})
    return out.select("lane", "surfaced", "stood", "eliminated", "scored", "below", "best_below", "eliminated_at", "findings", "stage", "lever")
