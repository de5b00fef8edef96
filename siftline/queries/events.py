"""Queries over events: as worker attempts of routes, and as the ledger of entities."""

from __future__ import annotations

import atexit
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators import ledger, quota, routes
from siftline.queries.base import Tables, query

NOW = "2024-01-31 00:00:00"
_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'verified' WHEN 'view' THEN 'schema_failed' WHEN 'click' THEN 'grounding_failed' ELSE 'rate_limited' END"
_ATTEMPTS = f"""a AS (SELECT event_id AS attempt_id, 'route_' || (user_id % 12) AS route_id, 'prov_' || (user_id % 4) AS provider, 'task_' || (event_id % 3) AS task_name,
  {_OUTCOME} AS outcome, value / 10 AS duration_seconds, value / 1000 AS cost, ts AS created_at,
  pow(0.5::DOUBLE, greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3600000000.0::DOUBLE, 0.0::DOUBLE) / 72.0::DOUBLE) AS w FROM events)"""


def _stats(by: str) -> str:
    kind = lambda k, n: f"round(sum(CASE WHEN outcome = '{k}' THEN w ELSE 0.0::DOUBLE END), 6) AS {n}"
    return f"""s AS (SELECT {by}, round(sum(w), 6) AS total, {kind("verified", "completed")}, {kind("grounding_failed", "grounding_failures")}, {kind("schema_failed", "schema_violations")},
  {kind("rate_limited", "rate_limits")}, round(sum(duration_seconds * w) / sum(CASE WHEN duration_seconds IS NOT NULL THEN w END), 6) AS avg_duration, round(sum(cost), 6) AS total_cost, count(*)::BIGINT AS attempts FROM a GROUP BY {by})"""


_BASE = """round(greatest(0.01, least(1.0, (completed + 1) / (total + 2) - 0.30::DOUBLE * grounding_failures / total - 0.25::DOUBLE * schema_violations / total
  - 0.20::DOUBLE * rate_limits / total - 0.15::DOUBLE * least(30.0::DOUBLE, avg_duration) / 30.0::DOUBLE)), 4)::DOUBLE"""


def attempts(t: Tables) -> DataFrame:
    outcome = F.expr(_OUTCOME)
    return t.events.select(
        F.col("event_id").alias("attempt_id"), F.concat(F.lit("route_"), F.col("user_id") % 12).alias("route_id"), F.concat(F.lit("prov_"), F.col("user_id") % 4).alias("provider"),
        F.concat(F.lit("task_"), F.col("event_id") % 3).alias("task_name"), outcome.alias("outcome"), (F.col("value") / 10).alias("duration_seconds"), (F.col("value") / 1000).alias("cost"),
        F.col("ts").alias("created_at"),
    )


def _scored(t: Tables) -> DataFrame:
    return routes.stats(attempts(t), now=NOW).withColumn("base_score", routes.base_score())


_TIE = "('0x' || substr(sha256('0:' || route_id), 1, 6))::BIGINT"


@query(f"""WITH {_ATTEMPTS}, {_stats("route_id")}, b AS (SELECT *, {_BASE} AS base_score FROM s)
SELECT *, row_number() OVER (ORDER BY base_score DESC, {_TIE} DESC, route_id)::INT AS route_rank FROM b""")
def route_stats(t: Tables) -> DataFrame:
    """The flagship: decayed statistics, base score and rank of every route."""
    return routes.ranked(_scored(t), score="base_score")


@query(f"WITH {_ATTEMPTS}, {_stats('route_id, task_name')} SELECT * FROM s")
def route_stats_pair(t: Tables) -> DataFrame:
    return routes.stats(attempts(t), now=NOW, by=("route_id", "task_name"))


@query(f"WITH {_ATTEMPTS}, {_stats('route_id')} SELECT route_id, {_BASE} AS base_score FROM s")
def route_base_score(t: Tables) -> DataFrame:
    return _scored(t).select("route_id", "base_score")


_SHRUNK = "round(total / (total + 10.0::DOUBLE) * {0} + (1 - total / (total + 10.0::DOUBLE)) * {1}, 4)::DOUBLE"


@query(f"""WITH {_ATTEMPTS}, {_stats("route_id, task_name")}, p AS (SELECT *, {_BASE} AS pair_score FROM s),
g AS (SELECT route_id AS r, {_BASE.replace("completed", "c").replace("grounding_failures", "g").replace("schema_violations", "m").replace("rate_limits", "l").replace("avg_duration", "d").replace("total", "n")} AS route_score FROM (
  SELECT route_id, round(sum(w), 6) AS n, round(sum(CASE WHEN outcome = 'verified' THEN w ELSE 0.0::DOUBLE END), 6) AS c, round(sum(CASE WHEN outcome = 'grounding_failed' THEN w ELSE 0.0::DOUBLE END), 6) AS g,
  round(sum(CASE WHEN outcome = 'schema_failed' THEN w ELSE 0.0::DOUBLE END), 6) AS m, round(sum(CASE WHEN outcome = 'rate_limited' THEN w ELSE 0.0::DOUBLE END), 6) AS l, round(sum(duration_seconds * w) / sum(w), 6) AS d FROM a GROUP BY 1))
SELECT route_id, task_name, {_SHRUNK.format("pair_score", "route_score")} AS score FROM p JOIN g ON p.route_id = g.r""")
def route_shrinkage(t: Tables) -> DataFrame:
    """A pair's score drawn to its route's; both come from one scan."""
    both = routes.stats_pair(attempts(t), now=NOW).withColumn("own", routes.base_score())
    route = F.max(F.when(F.col("task_name").isNull(), F.col("own"))).over(Window.partitionBy("route_id"))
    scored = both.withColumn("route_score", route).where("task_name IS NOT NULL")
    return scored.select("route_id", "task_name", routes.shrunk(F.col("own"), F.col("total"), F.col("route_score")).alias("score"))


@query(f"""WITH {_ATTEMPTS}, {_stats("route_id")}, b AS (SELECT route_id, {_BASE} AS base FROM s), v AS (SELECT 'route_' || (user_id % 12) AS route_id, round(value / 100, 4) AS composite, ts FROM events WHERE user_id % 12 < 9 AND event_id % 50 = 0),
l AS (SELECT route_id, arg_max(composite, (ts, composite)) AS composite FROM v GROUP BY 1), c AS (SELECT DISTINCT 'route_' || (user_id % 12) AS route_id FROM events WHERE event_id % 100 = 7 AND user_id % 12 < 4 AND ts + INTERVAL 300 HOUR > TIMESTAMP '{NOW}'),
r AS (SELECT 'route_' || i.i AS route_id FROM (SELECT unnest(range(0, 14))) AS i(i))
SELECT r.route_id, CASE WHEN c.route_id IS NOT NULL THEN 0.0::DOUBLE ELSE round(greatest(0.01::DOUBLE, least(1.0::DOUBLE, coalesce(0.6::DOUBLE * composite + 0.4::DOUBLE * coalesce(base, 0.55::DOUBLE), base, 0.55::DOUBLE))), 4) END AS score
FROM r LEFT JOIN b ON r.route_id = b.route_id LEFT JOIN l ON r.route_id = l.route_id LEFT JOIN c ON r.route_id = c.route_id""")
def route_final_score(t: Tables) -> DataFrame:
    """History blended with the latest evaluation; no score while cooled down; two routes have no history at all."""
    route = F.concat(F.lit("route_"), F.col("user_id") % 12)
    evaluations = t.events.where("user_id % 12 < 9 AND event_id % 50 = 0").select(route.alias("route_id"), F.round(F.col("value") / 100, 4).alias("composite"), F.col("ts").alias("created_at"))
    cooldowns = t.events.where("event_id % 100 = 7 AND user_id % 12 < 4").select(route.alias("route_id"), (F.col("ts") + F.expr("INTERVAL 300 HOURS")).alias("until"))
    every = t.spark.range(14).select(F.concat(F.lit("route_"), "id").alias("route_id"))
    return routes.final(every, _scored(t), evaluations, cooldowns, now=NOW)


@query(f"""WITH {_ATTEMPTS}, {_stats("route_id")}, b AS (SELECT route_id, {_SHRUNK.format(_BASE, "0.55::DOUBLE")} AS score FROM s)
SELECT route_id, score, row_number() OVER (ORDER BY score DESC, {_TIE} DESC, route_id)::INT AS route_rank FROM b""")
def route_rank(t: Tables) -> DataFrame:
    scores = _scored(t).select("route_id", routes.shrunk(F.col("base_score"), F.col("total")).alias("score"))
    return routes.ranked(scores)


_POLICY = """r AS (SELECT route_id, min(provider) AS provider, (count(*) % 5) <> 0 AS enabled,
  CASE (count(*) % 3) WHEN 0 THEN 'unknown' WHEN 1 THEN 'price_observed_zero' ELSE 'known' END AS price_state, round(avg(cost), 6) AS cost_per_1k FROM a GROUP BY 1)"""


@query(f"WITH {_ATTEMPTS}, {_POLICY} SELECT route_id, provider, price_state FROM r WHERE enabled AND provider IN ('prov_0', 'prov_1', 'prov_2') AND coalesce(CASE price_state WHEN 'price_observed_zero' THEN 0.0 WHEN 'known' THEN cost_per_1k END <= 0.05, false)")
def route_policy_filter(t: Tables) -> DataFrame:
    n = F.count("*")
    known = attempts(t).groupBy("route_id").agg(
        F.min("provider").alias("provider"), (n % 5 != 0).alias("enabled"),
        F.when(n % 3 == 0, "unknown").when(n % 3 == 1, "price_observed_zero").otherwise("known").alias("price_state"), F.round(F.avg("cost"), 6).alias("cost_per_1k"),
    )
    return known.where(routes.allowed(providers=("prov_0", "prov_1", "prov_2"), most_cost=0.05)).select("route_id", "provider", "price_state")


@query(f"WITH {_ATTEMPTS} SELECT route_id, task_name, outcome, created_at FROM a QUALIFY row_number() OVER (PARTITION BY task_name, route_id ORDER BY created_at DESC, attempt_id DESC) = 1")
def route_eval_latest(t: Tables) -> DataFrame:
    seen_at = F.struct("created_at", "attempt_id")
    return attempts(t).groupBy("route_id", "task_name").agg(F.max_by("outcome", seen_at).alias("outcome"), F.max("created_at").alias("created_at"))


_LIMITS = f"""{_ATTEMPTS}, n AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY created_at DESC, attempt_id DESC) AS place FROM a QUALIFY place <= 20),
u AS (SELECT *, coalesce(min(CASE WHEN outcome = 'verified' THEN place END) OVER (PARTITION BY route_id), 21) AS until FROM n),
l AS (SELECT route_id, count(*) FILTER (outcome = 'rate_limited' AND place < until)::BIGINT AS consecutive FROM u GROUP BY 1)"""


@query(f"WITH {_LIMITS} SELECT * FROM l")
def consecutive_failures(t: Tables) -> DataFrame:
    return routes.consecutive_limits(attempts(t))


@query(f"WITH {_LIMITS} SELECT route_id, consecutive, ([30, 60, 180, 600])[least(greatest(consecutive, 1), 4)]::INT AS delay FROM l")
def backoff_delay(t: Tables) -> DataFrame:
    return routes.consecutive_limits(attempts(t)).withColumn("delay", routes.backoff(F.col("consecutive")))


@query(f"""WITH {_ATTEMPTS}, c AS (SELECT route_id, max(created_at) FILTER (outcome = 'rate_limited') + INTERVAL 8 HOUR AS until FROM a GROUP BY 1)
SELECT route_id, until FROM c WHERE until > TIMESTAMP '{NOW}'""")
def cooldown_active(t: Tables) -> DataFrame:
    """Routes still cooling down eight hours after their last rate limit."""
    until = F.max(F.when(F.col("outcome") == "rate_limited", F.col("created_at"))) + F.expr("INTERVAL 8 HOURS")
    return attempts(t).groupBy("route_id").agg(until.alias("until")).where(F.col("until") > F.lit(NOW).cast("timestamp_ntz"))


@query(f"""WITH {_ATTEMPTS} SELECT task_name, count(*)::BIGINT AS batches, count(*) FILTER (outcome = 'verified')::BIGINT AS verified, count(*) FILTER (outcome = 'rate_limited')::BIGINT AS pending,
  round(sum(cost), 6) AS cost, CASE WHEN count(*) FILTER (outcome = 'rate_limited') > 0 THEN 'running' WHEN count(*) FILTER (outcome = 'verified') = count(*) THEN 'complete' ELSE 'partial' END AS status FROM a GROUP BY 1""")
def run_status(t: Tables) -> DataFrame:
    done, open_ = F.count_if(F.col("outcome") == "verified"), F.count_if(F.col("outcome") == "rate_limited")
    return attempts(t).groupBy("task_name").agg(
        F.count("*").alias("batches"), done.alias("verified"), open_.alias("pending"), F.round(F.sum("cost"), 6).alias("cost"),
        F.when(open_ > 0, "running").when(done == F.count("*"), "complete").otherwise("partial").alias("status"),
    )


@query(f"""WITH {_ATTEMPTS}, h AS (SELECT attempt_id // 3 AS prompt, attempt_id, route_id, outcome, duration_seconds FROM a)
SELECT prompt, arg_min(route_id, (duration_seconds, attempt_id)) AS winner, round(min(duration_seconds), 6) AS seconds FROM h WHERE outcome = 'verified' GROUP BY 1""")
def hedge_winner(t: Tables) -> DataFrame:
    """Of up to three routes asked at once, the first verified answer."""
    own = attempts(t).where("outcome = 'verified'").withColumn("prompt", F.floor(F.col("attempt_id") / 3).cast("long"))
    return own.groupBy("prompt").agg(F.min_by("route_id", F.struct("duration_seconds", "attempt_id")).alias("winner"), F.round(F.min("duration_seconds"), 6).alias("seconds"))


@query(f"""WITH {_ATTEMPTS}, c AS (SELECT provider, date_trunc('day', created_at) AS day, sum(cost) AS cost FROM a GROUP BY 1, 2),
r AS (SELECT provider, day, round(sum(cost) OVER (PARTITION BY provider ORDER BY day), 6) AS spent FROM c) SELECT provider, min(day) AS tripped, min(spent) AS spent FROM r WHERE spent > 10 GROUP BY 1""")
def cost_breaker(t: Tables) -> DataFrame:
    """The day on which a provider's running cost passes ten: daily sums first, so the running window is short."""
    daily = attempts(t).groupBy("provider", F.date_trunc("day", "created_at").alias("day")).agg(F.sum("cost").alias("cost"))
    spent = daily.withColumn("spent", F.round(F.sum("cost").over(Window.partitionBy("provider").orderBy("day")), 6))
    return spent.where("spent > 10").groupBy("provider").agg(F.min(F.col("day").cast("timestamp_ntz")).alias("tripped"), F.min("spent").alias("spent"))


@query(f"""WITH {_ATTEMPTS}, m AS (SELECT avg(cost) AS every FROM a) SELECT route_id, count(*)::BIGINT AS n, round(avg(cost) - (SELECT every FROM m), 6) AS bias FROM a GROUP BY 1""")
def route_bias(t: Tables) -> DataFrame:
    """How far a route's mean lies from that of all attempts: one aggregate over route sums."""
    sums = attempts(t).groupBy("route_id").agg(F.sum("cost").alias("s"), F.count("*").alias("n"))
    every = Window.partitionBy()
    return sums.select("route_id", "n", F.round(F.col("s") / F.col("n") - F.sum("s").over(every) / F.sum("n").over(every), 6).alias("bias"))


_EVAL = """e AS (SELECT route_id, count(*)::DOUBLE AS n, avg((outcome = 'verified')::INT) AS verified, 1 - avg((outcome = 'grounding_failed')::INT) AS grounded, avg(duration_seconds) AS latency,
  count(*) FILTER (outcome = 'rate_limited')::DOUBLE AS limits FROM a GROUP BY 1)"""


@query(f"""WITH {_ATTEMPTS}, {_EVAL} SELECT route_id, round((0.45::DOUBLE * verified + 0.45::DOUBLE * grounded + 0.10::DOUBLE * greatest(0.0::DOUBLE, 1 - latency / 30.0::DOUBLE)) * greatest(0.2::DOUBLE, 1 - 0.5::DOUBLE * limits / n), 3)::DOUBLE AS composite FROM e""")
def route_eval_composite(t: Tables) -> DataFrame:
    rate = lambda kind: F.avg((F.col("outcome") == kind).cast("int"))
    own = attempts(t).groupBy("route_id").agg(
        F.count("*").alias("n"), rate("verified").alias("verified"), (1 - rate("grounding_failed")).alias("grounded"), F.avg("duration_seconds").alias("latency"),
        F.count_if(F.col("outcome") == "rate_limited").alias("limits"),
    )
    score = routes.composite(F.lit(None).cast("double"), F.col("verified"), F.col("grounded"), F.col("latency"), F.col("limits"), F.col("n"))
    return own.select("route_id", score.alias("composite"))


# --- ledger ---------------------------------------------------------------------------------------
_LEDGER_SPARK = {
    "entity": "concat('firm_', user_id)", "lane": "concat('lane_', event_id % 3)", "rung": "CASE event_id % 3 WHEN 0 THEN 'result' WHEN 1 THEN 'surface' ELSE 'stories' END",
    "outcome": "CASE WHEN event_type = 'error' AND value > 90 THEN 'eliminated' WHEN event_type = 'purchase' THEN 'qualified' WHEN event_type = 'signup' THEN 'lead' WHEN event_type = 'view' THEN 'read' ELSE '' END",
    "because": "concat(event_type, ' ', event_id)", "pages": "event_id % 4", "score": "CASE WHEN event_type = 'purchase' THEN value ELSE 0.0D END",
    "tier": "CASE WHEN event_type = 'purchase' AND value >= 85 THEN 'tier_1' WHEN event_type = 'purchase' THEN 'unfit' ELSE '' END", "run_id": "concat('run_', event_id % 7)",
}
_LEDGER = "l AS (SELECT event_id, ts AS seen_at, " + ", ".join(f"{v.replace('0.0D', '0.0::DOUBLE')} AS {k}" for k, v in _LEDGER_SPARK.items()) + " FROM events)"


def ledger_events(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("ts").alias("seen_at"), *[F.expr(v).alias(k) for k, v in _LEDGER_SPARK.items()])


_JUDGED = "outcome NOT IN ('', 'read', 'nothing', 'complete', 'resolved')"
LEDGER_STATE_SQL = f"""WITH {_LEDGER} SELECT entity,
  coalesce(arg_max(outcome, event_id) FILTER (outcome = 'eliminated'), arg_max(outcome, event_id) FILTER ({_JUDGED}), '') AS outcome,
  coalesce(arg_max(because, event_id) FILTER (outcome = 'eliminated'), arg_max(because, event_id) FILTER ({_JUDGED}), '') AS because,
  coalesce(arg_max(score, event_id) FILTER (score <> 0), 0.0::DOUBLE) AS score, coalesce(arg_max(tier, event_id) FILTER (tier <> ''), '') AS tier,
  coalesce(arg_max(run_id, event_id) FILTER (run_id <> ''), '') AS run_id, array_to_string(list_sort(list(DISTINCT lane)), ',') AS lanes,
  sum(pages)::BIGINT AS pages_seen, count(*)::BIGINT AS sightings, arg_min(seen_at, event_id) AS first_seen, arg_max(seen_at, event_id) AS last_seen, arg_max(rung, event_id) AS last_rung FROM l GROUP BY 1"""


@query(LEDGER_STATE_SQL)
def ledger_state(t: Tables) -> DataFrame:
    return ledger.fold(ledger_events(t))


@query(f"WITH {_LEDGER} SELECT entity, outcome, count(*)::BIGINT AS n, min(event_id) AS first_event FROM l WHERE {_JUDGED} GROUP BY 1, 2")
def ledger_verdicts(t: Tables) -> DataFrame:
    return ledger_events(t).where(ledger.verdict(F.col("outcome"))).groupBy("entity", "outcome").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"WITH {_LEDGER} SELECT entity, seen_at, event_id, rung, outcome FROM l WHERE entity IN ('firm_1', 'firm_2', 'firm_3')")
def ledger_history(t: Tables) -> DataFrame:
    """Events of entities asked for; the filter reaches the scan."""
    return ledger_events(t).where(F.col("entity").isin("firm_1", "firm_2", "firm_3")).select("entity", "seen_at", "event_id", "rung", "outcome")


@query(f"WITH {_LEDGER} SELECT entity, min(event_id) AS event_id, arg_min(rung, event_id) AS rung, arg_min(because, event_id) AS because FROM l WHERE outcome = 'eliminated' GROUP BY 1")
def first_elimination(t: Tables) -> DataFrame:
    return ledger.first_elimination(ledger_events(t))


@query(f"WITH {_LEDGER} SELECT entity, seen_at, event_id, score, round(score - lag(score) OVER (PARTITION BY entity ORDER BY seen_at, event_id), 6) AS delta FROM l WHERE score > 0")
def score_trajectory(t: Tables) -> DataFrame:
    return ledger.trajectory(ledger_events(t).where("score > 0").select("entity", "seen_at", "event_id", "score"))


_FILLED = ", ".join(f"last_value({v} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY \"at\", log, seq ROWS UNBOUNDED PRECEDING) AS {v}" for v in ("score", "rung", "because"))


@query(f"""WITH {_LEDGER}, u AS (SELECT entity, epoch_us(seen_at) AS "at", 'scores' AS log, event_id AS seq, score, rung, NULL::VARCHAR AS because FROM l WHERE score > 0
  UNION ALL SELECT entity, epoch_us(seen_at), 'verdicts', event_id, NULL, NULL, because FROM l WHERE outcome = 'eliminated')
SELECT entity, "at", log, seq, {_FILLED} FROM u""")
def merged_trajectory(t: Tables) -> DataFrame:
    """Scores and eliminations as one log, in which each row shows the entity's last score, rung and reason."""
    own = ledger_events(t).withColumns({"at": F.unix_micros(F.col("seen_at").cast("timestamp")), "seq": F.col("event_id")})
    logs = {"scores": own.where("score > 0").select("entity", "at", "seq", "score", "rung"), "verdicts": own.where("outcome = 'eliminated'").select("entity", "at", "seq", "because")}
    return ledger.merged(logs, values=("score", "rung", "because"), span=2_000)


@query(f"""WITH {_LEDGER}, r AS (SELECT entity, score, row_number() OVER (PARTITION BY entity ORDER BY seen_at DESC, event_id DESC) AS place FROM l WHERE score > 0),
b AS (SELECT entity, max(score) FILTER (place = 1) AS now, max(score) FILTER (place = 2) AS before FROM r WHERE place <= 2 GROUP BY 1)
SELECT entity, now, before, round(now - before, 6) AS delta FROM b WHERE before IS NOT NULL AND abs(round(now - before, 6)) > 5""")
def movers(t: Tables) -> DataFrame:
    return ledger.movers(ledger_events(t).where("score > 0"), least=5.0)


@query(f"WITH {_LEDGER} SELECT entity, event_id, seen_at FROM l QUALIFY row_number() OVER (PARTITION BY entity ORDER BY seen_at DESC, event_id DESC) <= 3")
def prune_keep_n(t: Tables) -> DataFrame:
    return ledger.prune(ledger_events(t), keep=3).select("entity", "event_id", "seen_at")


_RUNGS = "r AS (SELECT 'dag' AS dag_id, rung AS node_id, (event_id // 1000)::INT AS run_seq, event_id AS seq, entity AS item_id, outcome FROM l)"


def _rungs(t: Tables) -> DataFrame:
    own = ledger_events(t)
    return own.select(F.lit("dag").alias("dag_id"), F.col("rung").alias("node_id"), F.floor(F.col("event_id") / 1000).cast("int").alias("run_seq"), F.col("event_id").alias("seq"), F.col("entity").alias("item_id"), "outcome")


@query(f"WITH {_LEDGER}, {_RUNGS} SELECT * FROM r QUALIFY dense_rank() OVER (PARTITION BY dag_id, node_id ORDER BY run_seq DESC) <= 2")
def prune_attempts(t: Tables) -> DataFrame:
    return ledger.prune_attempts(_rungs(t), keep=2)


@query(f"""WITH s AS ({LEDGER_STATE_SQL}) SELECT entity, score, last_seen, outcome FROM s WHERE outcome <> 'eliminated' ORDER BY score DESC, last_seen DESC, entity LIMIT 50""")
def running_list(t: Tables) -> DataFrame:
    """The fifty best standing entities."""
    standing = ledger.fold(ledger_events(t)).where("outcome <> 'eliminated'").select("entity", "score", "last_seen", "outcome")
    return standing.orderBy(F.desc("score"), F.desc("last_seen"), "entity").limit(50)


@query(f"WITH s AS ({LEDGER_STATE_SQL}) SELECT outcome, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score FROM s GROUP BY 1")
def state_counts(t: Tables) -> DataFrame:
    return ledger.fold(ledger_events(t)).groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH {_LEDGER}, {_RUNGS} SELECT item_id FROM r GROUP BY 1 HAVING NOT bool_or(outcome = 'eliminated')")
def population_alive(t: Tables) -> DataFrame:
    """Items no rung ever eliminated."""
    return _rungs(t).groupBy("item_id").agg(F.bool_or(F.col("outcome") == "eliminated").alias("out")).where("NOT out").select("item_id")


@query(f"""WITH {_LEDGER}, {_RUNGS} SELECT node_id, count(*)::BIGINT AS rows, count(DISTINCT item_id)::BIGINT AS items, count(*) FILTER (outcome = 'eliminated')::BIGINT AS eliminated,
  CASE WHEN count(*) FILTER ({_JUDGED}) = 0 THEN 'EMPTY' WHEN count(*) FILTER (outcome IN ('qualified', 'lead')) > 0 THEN 'VALUE' ELSE 'UNUSED' END AS verdict FROM r GROUP BY 1""")
def rung_quality(t: Tables) -> DataFrame:
    judged = F.count_if(ledger.verdict(F.col("outcome")))
    good = F.count_if(F.col("outcome").isin("qualified", "lead"))
    return _rungs(t).groupBy("node_id").agg(
        F.count("*").alias("rows"), F.count_distinct("item_id").alias("items"), F.count_if(F.col("outcome") == "eliminated").alias("eliminated"),
        F.when(judged == 0, "EMPTY").when(good > 0, "VALUE").otherwise("UNUSED").alias("verdict"),
    )


@query(f"""WITH {_LEDGER} SELECT lane, rung, count(*)::BIGINT AS n, count(*) FILTER (outcome = 'eliminated')::BIGINT AS eliminated, count(*) FILTER (score > 0)::BIGINT AS scored,
  round(avg(score) FILTER (score > 0), 6) AS mean_score, sum(pages)::BIGINT AS pages FROM l GROUP BY 1, 2""")
def db_audit(t: Tables) -> DataFrame:
    return ledger_events(t).groupBy("lane", "rung").agg(
        F.count("*").alias("n"), F.count_if(F.col("outcome") == "eliminated").alias("eliminated"), F.count_if(F.col("score") > 0).alias("scored"),
        F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 6).alias("mean_score"), F.sum("pages").alias("pages"),
    )


@query(f"""WITH {_LEDGER}, a AS (SELECT lane, count(*)::BIGINT AS n FROM l WHERE run_id IN ('run_0', 'run_1', 'run_2') GROUP BY 1), b AS (SELECT lane, count(*)::BIGINT AS n FROM l WHERE run_id IN ('run_4', 'run_5') GROUP BY 1)
SELECT coalesce(a.lane, b.lane) AS lane, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b ON a.lane = b.lane""")
def db_compare(t: Tables) -> DataFrame:
    """Two runs side by side in one pass: conditional counts instead of a full outer join."""
    own = ledger_events(t)
    old, new = F.count_if(F.col("run_id").isin("run_0", "run_1", "run_2")), F.count_if(F.col("run_id").isin("run_4", "run_5"))
    return own.groupBy("lane").agg(old.alias("old_n"), new.alias("new_n"), (new - old).alias("change")).where("old_n + new_n > 0")


@query(f"""WITH {_LEDGER}, s AS (SELECT lane, sum(pages)::BIGINT AS captured, count(*) FILTER (outcome = '')::BIGINT AS skipped, count(*)::BIGINT AS attempted FROM l GROUP BY 1)
SELECT *, round(captured / (captured + skipped)::DOUBLE, 4) AS share FROM s""")
def lane_yield(t: Tables) -> DataFrame:
    own = ledger_events(t).groupBy("lane").agg(F.sum("pages").alias("captured"), F.count_if(F.col("outcome") == "").alias("skipped"), F.count("*").alias("attempted"))
    return own.withColumn("share", F.round(F.col("captured") / (F.col("captured") + F.col("skipped")), 4))


@query(f"WITH {_ATTEMPTS} SELECT task_name, round(sum(cost), 6) AS cost, count(DISTINCT route_id)::BIGINT AS routes, round(sum(duration_seconds), 6) AS seconds, count(*) FILTER (outcome <> 'verified')::BIGINT AS failed FROM a GROUP BY 1")
def lane_cost(t: Tables) -> DataFrame:
    return attempts(t).groupBy("task_name").agg(
        F.round(F.sum("cost"), 6).alias("cost"), F.count_distinct("route_id").alias("routes"), F.round(F.sum("duration_seconds"), 6).alias("seconds"), F.count_if(F.col("outcome") != "verified").alias("failed")
    )


@query(f"""WITH {_LEDGER}, x AS (SELECT DISTINCT entity FROM l WHERE outcome = 'qualified'), y AS (SELECT DISTINCT entity FROM l WHERE outcome = 'eliminated')
SELECT 'both' AS part, entity FROM x WHERE entity IN (SELECT entity FROM y) UNION ALL SELECT 'either', entity FROM (SELECT entity FROM x UNION SELECT entity FROM y) UNION ALL SELECT 'alive', entity FROM x WHERE entity NOT IN (SELECT entity FROM y)""")
def id_sets(t: Tables) -> DataFrame:
    """Intersection, union and difference of two sets of ids from one aggregate pass."""
    flags = ledger_events(t).groupBy("entity").agg(F.bool_or(F.col("outcome") == "qualified").alias("x"), F.bool_or(F.col("outcome") == "eliminated").alias("y"))
    parts = F.array_compact(F.array(F.when(F.col("x") & F.col("y"), F.lit("both")), F.when(F.col("x") | F.col("y"), F.lit("either")), F.when(F.col("x") & ~F.col("y"), F.lit("alive"))))
    return flags.select(F.explode(parts).alias("part"), "entity")




_LANE = "CAST(regexp_extract(entity, '([0-9]+)$', 1) AS INT) % 5"


@query(f"""WITH {_LEDGER}, e AS (SELECT {_LANE} AS lane, entity, arg_min(rung, event_id) FILTER (outcome = 'eliminated') AS fell, count(*) FILTER (outcome = 'eliminated') > 0 AS gone, arg_max(score, event_id) FILTER (score > 0) AS score FROM l GROUP BY 1, 2),
n AS (SELECT lane, count(*)::BIGINT AS surfaced, count(*) FILTER (NOT gone)::BIGINT AS stood, count(score)::BIGINT AS scored, count(*) FILTER (score < 199)::BIGINT AS below, max(score) FILTER (score < 199) AS best_below FROM e GROUP BY 1),
r AS (SELECT lane, fell, count(*) AS n FROM e WHERE gone GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lane ORDER BY count(*) DESC, fell) <= 3),
w AS (SELECT lane, string_agg(fell || ': ' || n, ', ' ORDER BY n DESC, fell) AS eliminated_at FROM r GROUP BY 1),
f AS (SELECT *, stood > 0 AND surfaced >= 4 * stood AS narrow, coalesce(best_below >= 0.85 * 199, false) AS close FROM n LEFT JOIN w USING (lane))
SELECT lane, surfaced, stood, surfaced - stood AS eliminated, scored, below, best_below, coalesce(eliminated_at, '') AS eliminated_at,
  CASE WHEN narrow AND close THEN 'funnel, bar' WHEN narrow THEN 'funnel' WHEN close THEN 'bar' ELSE 'search' END AS findings, CASE WHEN narrow THEN 'funnel' WHEN close THEN 'bar' ELSE 'search' END AS stage FROM f""")
def quota_shortfall(t: Tables) -> DataFrame:
    """Lanes of the ledger: what surfaced, stood and was eliminated, and what holds each back."""
    found = quota.shortfall(ledger_events(t).withColumn("lane", F.expr(_LANE)), least_score=199)
    return found.withColumns({"eliminated_at": F.array_join("eliminated_at", ", "), "findings": F.array_join("findings", ", ")}).drop("lever")


def _stream_path(spark) -> str:
    """A new folder for a stream's files, which goes with the driver's process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def delete() -> None:
        with suppress(Exception):  # the session may have been stopped, or its gateway be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    atexit.register(delete)
    return path


@query("SELECT event_id, event_type, user_id FROM events")
def stream_insert_ignore(t: Tables) -> DataFrame:
    """Each event once, from two runs of a stream: the second finds files that hold half of the first's events again, with other contents, which are ignored."""
    from siftline.streaming.once import first_of_each, write_once

    path = _stream_path(t.spark)
    own = t.events.select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type", "user_id")
    middle = F.col("event_id") % 10
    for first, last, again in ((0, 5, -1), (3, 9, 5)):
        late = middle.between(first, again)
        own.where(middle.between(first, last)).withColumn("event_type", F.when(late, "again").otherwise(F.col("event_type"))).write.mode("append").parquet(f"{path}/in")
        stream = t.spark.readStream.schema(own.schema).parquet(f"{path}/in")
        write_once(first_of_each(stream, keys=["event_id"], at="at", within="3650 days"), f"{path}/out", f"{path}/state")
    return t.spark.read.parquet(f"{path}/out").select("event_id", "event_type", "user_id")


@query("""SELECT entity, outcome, score, sightings FROM (""" + LEDGER_STATE_SQL + """)""")
def stream_ledger_state(t: Tables) -> DataFrame:
    """The ledger folded by a stream over the files of events; the last state of each entity."""
    from siftline.streaming.ledger import stream_state

    spark = t.spark
    path = _stream_path(spark)
    events = spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*")
    own = events.select("event_id", *[F.expr(_LEDGER_SPARK[k]).alias(k) for k in ("entity", "outcome", "score")])
    out = stream_state(own)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{number:06d}")

    writer = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True)
    writer.start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out/*")
    return rows.groupBy("entity").agg(F.max_by("outcome", "sightings").alias("outcome"), F.max_by("score", "sightings").alias("score"), F.max("sightings").alias("sightings"))
