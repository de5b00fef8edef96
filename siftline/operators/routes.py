"""Worker routes: time-decayed statistics of attempts, scores shrunk to a prior, policy, ranking, cooldown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import vocab


def decayed(created_at: Column, now: str, half_life_hours: float = vocab.ROUTE_HALF_LIFE_HOURS) -> Column:
    """Weight of an attempt: halves every half-life; ``now`` is a parameter, never the clock. A missing time weighs 1."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))) / F.lit(3_600_000_000.0)
    return F.coalesce(F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(half_life_hours)), F.lit(1.0))


def stats(attempts: DataFrame, *, now: str, by: tuple[str, ...] = ("route_id",), half_life_hours: float = vocab.ROUTE_HALF_LIFE_HOURS) -> DataFrame:
    """attempts (route_id, outcome, duration_seconds, cost, created_at, ...) -> decayed counts, latency and cost per ``by``."""
    return _weighed(attempts, now, half_life_hours).groupBy(*by).agg(*_sums())


def stats_pair(attempts: DataFrame, *, now: str, task: str = "task_name", half_life_hours: float = vocab.ROUTE_HALF_LIFE_HOURS) -> DataFrame:
    """As ``stats``, of each route and task and of each route over all tasks (``task`` null), from one scan."""
    weighed = _weighed(attempts, now, half_life_hours)
    return weighed.groupingSets([["route_id"], ["route_id", task]], "route_id", task).agg(*_sums())


def _weighed(attempts: DataFrame, now: str, half_life_hours: float) -> DataFrame:
    return attempts.withColumn("w", decayed(F.col("created_at"), now, half_life_hours))


def _sums() -> list[Column]:
    share = lambda kind: F.round(F.sum(F.when(F.col("outcome") == kind, F.col("w")).otherwise(0.0)), 6)
    timed = F.when(F.col("duration_seconds").isNotNull(), F.col("w"))
    return [
        F.round(F.sum("w"), 6).alias("total"), share("verified").alias("completed"), share("grounding_failed").alias("grounding_failures"),
        share("schema_failed").alias("schema_violations"), share("rate_limited").alias("rate_limits"),
        F.round(F.sum(F.col("duration_seconds") * F.col("w")) / F.sum(timed), 6).alias("avg_duration"), F.round(F.sum("cost"), 6).alias("total_cost"), F.count("*").alias("attempts"),
    ]


def base_score() -> Column:
    """Smoothed success, less penalties per attempt and for latency, between .01 and 1; null without attempts."""
    n, w = F.col("total"), vocab.ROUTE_WEIGHTS
    raw = (
        (F.col("completed") + 1) / (n + 2) - w["grounding"] * F.col("grounding_failures") / n - w["schema"] * F.col("schema_violations") / n
        - w["rate_limit"] * F.col("rate_limits") / n - w["latency"] * F.least(F.lit(30.0), F.coalesce("avg_duration", F.lit(0.0))) / 30.0
    )
    return F.when(n > 1e-9, F.round(F.greatest(F.lit(0.01), F.least(F.lit(1.0), raw)), 4))


def shrunk(score: Column, n: Column, prior: Column | float = vocab.ROUTE_PRIOR, k: float = vocab.ROUTE_SHRINKAGE) -> Column:
    """A score drawn to the prior by the weight n / (n + k)."""
    share = n / (n + F.lit(k))
    return F.round(share * F.coalesce(score, F.lit(0.0)) + (1 - share) * (prior if isinstance(prior, Column) else F.lit(prior)), 4)


def final(routes: DataFrame, scores: DataFrame, evaluations: DataFrame, cooldowns: DataFrame, *, now: str, share: float = vocab.EVAL_SHARE) -> DataFrame:
    """routes (route_id) -> (route_id, score): history, blended with the latest evaluation where there is one.

    scores (route_id, base_score), evaluations (route_id, composite, created_at), cooldowns (route_id, until). A route without
    history has the prior; a cooled-down one scores 0; all others lie between .01 and 1.
    """
    latest = evaluations.groupBy("route_id").agg(F.max_by("composite", F.struct("created_at", "composite")).alias("composite"))
    cold = cooldowns.where(F.col("until") > F.lit(now).cast("timestamp_ntz")).select("route_id", F.lit(True).alias("cold")).distinct()
    both = routes.join(scores.select("route_id", "base_score"), "route_id", "left").join(latest, "route_id", "left").join(cold, "route_id", "left")
    base = F.coalesce("base_score", F.lit(vocab.ROUTE_PRIOR))
    blended = F.coalesce(share * F.col("composite") + (1 - share) * base, base)
    return both.select("route_id", F.when(F.col("cold"), 0.0).otherwise(F.round(F.greatest(F.lit(vocab.SCORE_FLOOR), F.least(F.lit(1.0), blended)), 4)).alias("score"))


def ranked(scores: DataFrame, *, score: str = "score", seed: str = "0") -> DataFrame:
    """Routes by score, ties by a digest of seed and route. One row a route, so the global order is small."""
    tie = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("route_id")).cast("binary"), 256), 1, 6), 16, 10).cast("long")
    return scores.withColumn("route_rank", F.row_number().over(Window.orderBy(F.desc(score), tie.desc(), "route_id")))


def allowed(*, free_only: bool = False, providers: tuple[str, ...] = (), most_cost: float | None = None) -> Column:
    """Policy: enabled routes of the providers; an unknown price fails closed, a price observed as zero is free."""
    price = F.when(F.col("price_state") == "price_observed_zero", 0.0).when(F.col("price_state") == "known", F.col("cost_per_1k"))
    ok = F.col("enabled")
    if free_only:
        ok &= F.coalesce(price == 0, F.lit(False))
    if providers:
        ok &= F.col("provider").isin(*providers)
    if most_cost is not None:
        ok &= F.coalesce(price <= most_cost, F.lit(False))
    return ok


def consecutive_limits(attempts: DataFrame, *, newest: int = 20) -> DataFrame:
    """Per route: rate limits among its newest attempts since the last verified one; other outcomes are passed over."""
    order = Window.partitionBy("route_id").orderBy(F.desc("created_at"), F.desc("attempt_id"))
    recent = attempts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= newest)
    until = F.coalesce(F.min(F.when(F.col("outcome") == "verified", F.col("place"))).over(Window.partitionBy("route_id")), F.lit(newest + 1))
    return recent.withColumn("until", until).groupBy("route_id").agg(F.count_if((F.col("outcome") == "rate_limited") & (F.col("place") < F.col("until"))).alias("consecutive"))


def backoff(consecutive: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in vocab.BACKOFF_SECONDS]), F.least(F.greatest(consecutive, F.lit(1)), F.lit(len(vocab.BACKOFF_SECONDS))).cast("int"))


def composite(accuracy: Column, verified: Column, grounded: Column, latency: Column, limits: Column, n: Column) -> Column:
    """Score of an evaluation: accuracy, schema and grounding rates and speed, cut for rate limits; without accuracy other weights."""
    speed = F.greatest(F.lit(0.0), 1 - latency / 30.0)
    known = 0.35 * accuracy + 0.35 * verified + 0.20 * grounded + 0.10 * speed
    blind = 0.45 * verified + 0.45 * grounded + 0.10 * speed
    return F.round(F.coalesce(known, blind) * F.greatest(F.lit(0.2), 1 - 0.5 * limits / n), 3)
