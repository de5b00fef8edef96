"""The ledger: append-only events of entities, folded into one row per entity.

The fold is a set of conditional maxima by arrival, so it aggregates partially, has no sequential UDF, and may be recomputed
or streamed at will. An elimination is sticky: only a later elimination replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import vocab
from siftline.operators.items import same, stretches


def _last(value: str | Column, when: Column) -> Column:
    return F.max_by(value, F.when(when, F.col("event_id")))


def verdict(outcome: Column) -> Column:
    """Outcomes that judge; the others are mechanics of a run."""
    return ~F.coalesce(outcome, F.lit("")).isin(*vocab.MECHANICAL)


def fold(events: DataFrame) -> DataFrame:
    """events (event_id, entity, seen_at, lane, rung, outcome, because, pages, score, tier, run_id) -> one row per entity.

    Arrival is the order of event_id. outcome and because: of the last elimination, else of the last verdict, else empty.
    score: the last that is not zero; tier and run_id: the last not empty. An entity's first event may set a score of zero.
    """
    judged, out = verdict(F.col("outcome")), F.col("outcome") == "eliminated"
    return events.groupBy("entity").agg(
        F.coalesce(_last("outcome", out), _last("outcome", judged), F.lit("")).alias("outcome"),
        F.coalesce(_last("because", out), _last("because", judged), F.lit("")).alias("because"),
        F.coalesce(_last("score", F.col("score") != 0), F.lit(0.0)).alias("score"),
        F.coalesce(_last("tier", F.coalesce(F.col("tier"), F.lit("")) != ""), F.lit("")).alias("tier"),
        F.coalesce(_last("run_id", F.coalesce(F.col("run_id"), F.lit("")) != ""), F.lit("")).alias("run_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("lane") != "", F.col("lane")))), ",").alias("lanes"),
        F.sum("pages").alias("pages_seen"), F.count("*").alias("sightings"),
        F.min_by("seen_at", "event_id").alias("first_seen"), F.max_by("seen_at", "event_id").alias("last_seen"), F.max_by("rung", "event_id").alias("last_rung"),
    )


def first_elimination(events: DataFrame) -> DataFrame:
    """Where and why each eliminated entity first went."""
    out = F.when(F.col("outcome") == "eliminated", F.col("event_id"))
    return events.groupBy("entity").agg(F.min(out).alias("event_id"), F.min_by("rung", out).alias("rung"), F.min_by("because", out).alias("because")).where("event_id IS NOT NULL")


def trajectory(scores: DataFrame) -> DataFrame:
    """scores (entity, seen_at, event_id, score): each with its change against the entity's one before."""
    before = F.lag("score").over(Window.partitionBy("entity").orderBy("seen_at", "event_id"))
    return scores.withColumn("delta", F.round(F.col("score") - before, 6))


def merged(logs: dict[str, DataFrame], *, values: tuple[str, ...], span: int = 100_000) -> DataFrame:
    """Unlike logs (entity, at, seq and some of ``values`` each) as one, in the order of at, log and seq; each row shows, of every value, the last that is known.

    ``at`` is a number. Rows lie in stretches of it; inside a stretch values are carried on by a window of one entity, and between
    stretches by its last known values, of which there is a row for each stretch: no task holds all rows of an entity that fills the
    logs. A value that was never known is null; a null entity is one of its own.
    """
    every = None
    for name, log in logs.items():
        own = log.select("entity", F.col("at"), F.lit(name).alias("log"), "seq", *(F.col(v) if v in log.columns else F.lit(None).alias(v) for v in values))
        every = own if every is None else every.unionByName(own)
    every = every.withColumn("__part", stretches(every, "at", span))
    inside = Window.partitionBy("entity", "__part").orderBy("at", "log", "seq").rowsBetween(Window.unboundedPreceding, 0)
    filled = every.select("entity", "at", "log", "seq", "__part", *(F.last(v, ignorenulls=True).over(inside).alias(v) for v in values))
    place = F.struct("at", "log", "seq")
    known = every.groupBy("entity", "__part").agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), place)).alias(v) for v in values))
    earlier = Window.partitionBy("entity").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.select("entity", "__part", *(F.last(v, ignorenulls=True).over(earlier).alias(f"__{v}") for v in values))
    return same(filled, carried, ["entity", "__part"]).select("entity", "at", "log", "seq", *(F.coalesce(v, f"__{v}").alias(v) for v in values))


def movers(scores: DataFrame, *, least: float = 0.0) -> DataFrame:
    """Entities whose last two scores differ by more than ``least``."""
    newest = Window.partitionBy("entity").orderBy(F.desc("seen_at"), F.desc("event_id"))
    ranked = scores.withColumn("place", F.row_number().over(newest)).where("place <= 2")
    both = ranked.groupBy("entity").agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("now"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("before"))
    return both.where("before IS NOT NULL").withColumn("delta", F.round(F.col("now") - F.col("before"), 6)).where(F.abs("delta") > least)


def prune(events: DataFrame, *, keep: int) -> DataFrame:
    """The newest ``keep`` events of each entity."""
    newest = Window.partitionBy("entity").orderBy(F.desc("seen_at"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= keep).drop("place")


def prune_attempts(rungs: DataFrame, *, keep: int) -> DataFrame:
    """Rows of the newest ``keep`` attempts of each (dag_id, node_id); attempts are never overwritten, only dropped whole."""
    newest = Window.partitionBy("dag_id", "node_id").orderBy(F.desc("run_seq"))
    attempts = rungs.select("dag_id", "node_id", "run_seq").distinct().withColumn("place", F.row_number().over(newest)).where(F.col("place") <= keep)
    return rungs.join(attempts.drop("place"), ["dag_id", "node_id", "run_seq"], "left_semi")
