"""Scores: evidence strengths by source weight and age, checklist points, tiers, and consistency of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import vocab
from siftline.operators.evidence import qualifies


def source_weight(uri: Column, weights: tuple[tuple[str, float], ...], default: float) -> Column:
    """The weight of the longest matching pattern, the first of equals; the default without a match or a URI."""
    ordered = sorted(weights, key=lambda w: -len(w[0]))
    return F.coalesce(*[F.when(F.contains(F.lower(uri), F.lit(m.lower())), F.lit(w)) for m, w in ordered], F.lit(default))


def recency(captured_at: Column, scored_at: Column, half_life_days: float) -> Column:
    """Halves with every half-life of age; 1 where the time is missing or lies ahead."""
    days = (F.unix_micros(scored_at.cast("timestamp")) - F.unix_micros(captured_at.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / F.lit(half_life_days)), F.lit(1.0))


def strengths(quotes: DataFrame, *, items: tuple[str, ...], weights: tuple[tuple[str, float], ...], default: float, half_lives: dict[str, float]) -> DataFrame:
    """quotes (record, item, category, uri, captured_at, scored_at) -> (record, item, strength): the best quote that qualifies."""
    allowed, decay = F.lit(False), F.lit(1.0)
    for item in items:
        allowed = F.when(F.col("item") == item, qualifies(item, F.col("category"))).otherwise(allowed)
        if item in half_lives:
            decay = F.when(F.col("item") == item, recency(F.col("captured_at"), F.col("scored_at"), half_lives[item])).otherwise(decay)
    worth = F.when(allowed, source_weight(F.col("uri"), weights, default) * decay).otherwise(F.lit(0.0))
    return quotes.where(F.col("item").isin(*items)).groupBy("record", "item").agg(F.round(F.max(worth), 6).alias("strength"))


def checklist_score(points: Column, strength: Column) -> Column:
    """Aggregate: points times strength, halves up, at most 100."""
    return F.least(F.lit(100), F.floor(F.round(F.sum(points * strength), 6) + 0.5)).cast("int")


def tier(score: Column) -> Column:
    out = F.lit("unfit")
    for name, floor in reversed(vocab.TIER_BANDS):
        out = F.when(score >= floor, F.lit(name)).otherwise(out)
    return out


def violations(score: Column, derived: Column, said_tier: Column, passed: Column, pass_score: int) -> Column:
    """What a record claims against what its checklist gives."""
    return F.array_compact(F.array(
        F.when(score != derived, F.lit("score")), F.when(said_tier != tier(derived), F.lit("tier")), F.when(passed != (derived >= pass_score), F.lit("passed")),
        F.when(~score.between(0, 100), F.lit("range")),
    ))
