"""Queries over runs: orders stand for batches of runs, their lines for results, customers for runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import runs
from siftline.queries.base import Tables, query
from siftline.queries.scores import _C, _TIER, claims, scores

_STATUS = "CASE WHEN o_orderkey % 50 = 7 AND o_custkey % 40 % 5 = 1 THEN 'pending' WHEN o_orderkey % 40 = 3 AND o_custkey % 40 % 5 = 2 THEN 'leased' WHEN o_orderkey % 30 = 5 AND o_custkey % 40 % 5 = 3 THEN 'failed' ELSE 'verified' END"
_BATCHES = f"b AS (SELECT o_custkey % 40 AS run_id, o_orderkey AS batch_id, {_STATUS} AS status FROM orders)"
_RUNS = "r AS (SELECT o_custkey % 40 AS run_id, count(*)::BIGINT AS attempts_used, min(o_orderdate) AS created_at, (o_custkey % 40) * 9 + 200 AS max_attempts FROM orders GROUP BY o_custkey % 40)"


def batches(t: Tables) -> DataFrame:
    return t.orders.select((F.col("o_custkey") % 40).alias("run_id"), F.col("o_orderkey").alias("batch_id"), F.expr(_STATUS).alias("status"))


def all_runs(t: Tables) -> DataFrame:
    own = t.orders.groupBy((F.col("o_custkey") % 40).alias("run_id")).agg(F.count("*").alias("attempts_used"), F.min("o_orderdate").alias("created_at"))
    return own.withColumn("max_attempts", F.col("run_id") * 9 + 200)


@query(f"""WITH {_BATCHES}, {_RUNS}, s AS (SELECT run_id, bool_or(status IN ('pending', 'leased')) AS open, bool_or(status = 'failed') AS failed FROM b GROUP BY 1)
SELECT r.run_id, CASE WHEN open THEN CASE WHEN attempts_used >= max_attempts THEN 'budget_exhausted' ELSE 'completed_with_failures' END WHEN failed THEN 'completed_with_failures' ELSE 'completed' END AS status FROM r LEFT JOIN s ON r.run_id = s.run_id""")
def run_finalize(t: Tables) -> DataFrame:
    return runs.finalise(all_runs(t), batches(t))


_RESULTS = "e AS (SELECT l_orderkey AS batch_id, l_orderkey * 10 + l_linenumber AS result_id, l_orderkey * 10 + l_linenumber AS receipt_id, min(l_shipdate) AS made, round(min(l_extendedprice), 2) AS cost FROM lineitem WHERE l_orderkey % 3 <> 1 GROUP BY 1, 2, 3)"


@query(f"""WITH {_BATCHES}, {_RESULTS}, c AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY made DESC, result_id DESC) = 1)
SELECT b.run_id, b.batch_id, b.status, c.result_id, c.receipt_id, CASE WHEN c.receipt_id % 4 <> 0 THEN c.cost END AS cost FROM b LEFT JOIN c ON b.batch_id = c.batch_id""")
def run_snapshot(t: Tables) -> DataFrame:
    """Batches with their latest result and its receipt; some have neither, some results no receipt."""
    own = t.lineitem.where("l_orderkey % 3 <> 1").groupBy(F.col("l_orderkey").alias("batch_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("result_id"))
    lines = own.agg(F.min("l_shipdate").alias("at"), F.round(F.min("l_extendedprice"), 2).alias("cost"))
    results = lines.select("batch_id", "result_id", F.col("result_id").alias("receipt_id"), "at")
    receipts = lines.where("result_id % 4 <> 0").select(F.col("result_id").alias("receipt_id"), "cost")
    return runs.snapshot(batches(t), results, receipts)


@query(f"WITH {_RUNS} SELECT run_id, attempts_used, created_at FROM r ORDER BY created_at DESC, run_id DESC LIMIT 25")
def list_runs(t: Tables) -> DataFrame:
    return runs.newest(all_runs(t)).select("run_id", "attempts_used", "created_at")


@query(f"WITH {_RUNS} SELECT run_id FROM r ORDER BY created_at DESC, run_id DESC LIMIT 1")
def latest_run(t: Tables) -> DataFrame:
    return runs.newest(all_runs(t), 1).select("run_id")


@query("""SELECT 'task_' || (o_custkey % 3) AS task_name, 'route_' || (o_custkey % 12) AS route_id, o_orderkey AS eval_id, o_orderdate AS created_at FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey % 3, o_custkey % 12 ORDER BY o_orderdate DESC, o_orderkey DESC) <= 100""")
def eval_retention(t: Tables) -> DataFrame:
    """The hundred latest evaluations of each task and route."""
    own = t.orders.select(F.concat(F.lit("task_"), F.col("o_custkey") % 3).alias("task_name"), F.concat(F.lit("route_"), F.col("o_custkey") % 12).alias("route_id"), F.col("o_orderkey").alias("eval_id"), F.col("o_orderdate").alias("created_at"))
    return runs.keep_newest(own, ["task_name", "route_id"], [F.desc("created_at"), F.desc("eval_id")])


@query("SELECT min(CASE WHEN ts + INTERVAL 2 HOUR > TIMESTAMP '2024-01-15 00:00:00' THEN ts + INTERVAL 2 HOUR END) AS until FROM events WHERE event_type = 'error' OR event_type = 'logout' OR user_id % 5 = 0")
def earliest_cooldown(t: Tables) -> DataFrame:
    """When the first of the cooldowns that still run ends."""
    own = t.events.where("event_type = 'error' OR event_type = 'logout' OR user_id % 5 = 0").select((F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("until"))
    return runs.earliest_expiry(own, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


_RUNGS = "g AS (SELECT 'dag_' || (l_suppkey % 5) AS dag_id, 'node_' || (l_partkey % 4) AS node_id, (l_orderkey % 9 + 1)::INT AS run_seq FROM lineitem)"


def rung_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(F.concat(F.lit("dag_"), F.col("l_suppkey") % 5).alias("dag_id"), F.concat(F.lit("node_"), F.col("l_partkey") % 4).alias("node_id"), (F.col("l_orderkey") % 9 + 1).cast("int").alias("run_seq"))


@query(f"WITH {_RUNGS} SELECT dag_id, node_id, array_to_string(list_sort(list(DISTINCT run_seq)), ',') AS attempts, max(run_seq) + 1 AS next_seq FROM g GROUP BY 1, 2")
def rung_attempts(t: Tables) -> DataFrame:
    return runs.attempts(rung_rows(t)).withColumn("attempts", F.array_join(F.transform("attempts", lambda x: x.cast("string")), ","))


@query(f"""WITH {_RUNGS} SELECT 'rows' AS name, count(*)::BIGINT AS n FROM g UNION ALL SELECT 'texts', count(*)::BIGINT FROM documents UNION ALL SELECT 'items', count(*)::BIGINT FROM orders
UNION ALL SELECT 'attempts', count(*)::BIGINT FROM (SELECT DISTINCT dag_id, node_id, run_seq FROM g)""")
def store_stats(t: Tables) -> DataFrame:
    return runs.stats({"rows": rung_rows(t), "texts": t.documents, "items": t.orders})


@query("""WITH n AS (SELECT user_id % 30 AS run_id, 'lane_' || (event_id % 4) AS lane, count(*) AS n FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2)
SELECT run_id, lane FROM n QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, lane) = 1""")
def lane_of_run(t: Tables) -> DataFrame:
    lane = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("lane_"), F.col("event_id") % 4))
    return runs.main_lane(t.events.select((F.col("user_id") % 30).alias("run_id"), lane.alias("lane")))


@query("""WITH o AS (SELECT s_suppkey AS id, 'old' AS state, s_acctbal AS price FROM supplier WHERE s_suppkey % 3 <> 0), n AS (SELECT s_suppkey AS id, 'new' AS state, s_acctbal * 2 AS price FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.state, o.state) AS state, round(coalesce(n.price, o.price), 2) AS price FROM o FULL JOIN n ON o.id = n.id""")
def route_upsert(t: Tables) -> DataFrame:
    """Routes known before and routes listed now: the new state of those that are in both."""
    of = lambda df, state, times: df.select(F.col("s_suppkey").alias("id"), F.lit(state).alias("state"), F.round(F.col("s_acctbal") * times, 2).alias("price"))
    return runs.upsert(of(t.supplier.where("s_suppkey % 3 <> 0"), "old", 1), of(t.supplier.where("s_suppkey % 2 = 0"), "new", 2), ["id"])


# --- records ----------------------------------------------------------------------------------------
_NUMBER = "CASE WHEN o_orderkey % 4 = 1 THEN (o_custkey % 100)::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"""WITH k AS (SELECT o_orderkey AS item_id, {_NUMBER} AS score, o_orderkey % 7 <> 0 AS noted, o_custkey FROM orders)
SELECT item_id, CASE WHEN item_id % 5 = 0 THEN item_id::VARCHAR ELSE 'firm_' || o_custkey END AS candidate, 'score' AS rung, CASE WHEN noted THEN 'n' WHEN score = 0 THEN '0.0: no checklist claims verified with cited quotes' ELSE '' END AS because, score,
  CASE WHEN score >= 50 THEN 'tier_3' ELSE '' END AS tier, (5 + noted::INT)::INT AS facts, false AS advances FROM k""")
def score_rows(t: Tables) -> DataFrame:
    """Rows of the rung table from claims in which the score is now a number, now a word, a boolean or null."""
    c = F.col("claims")
    kept = F.map_filter(c, lambda k, _: k.isin("status", "urgent"))
    added = {"score": c["mixed"], "stack": c["priority"], "answers": F.lit('{"q1": true}')}
    own = claims(t).select("record", "firm", F.map_concat(kept, F.create_map(*[x for k, v in added.items() for x in (F.lit(k), v)]), F.map_filter(F.create_map(F.lit("reason"), c["note"]), lambda _, v: v.isNotNull())).alias("claims"))
    records = own.select(F.col("record").alias("item_id"), F.when(F.col("record") % 5 == 0, "").otherwise(F.concat(F.lit("firm_"), "firm")).alias("candidate"), "claims", F.lit(None).cast("string").alias("tier"))
    rows = runs.score_rows(records)
    return rows.select("item_id", "candidate", "rung", "because", "score", F.when(F.col("score") >= 50, "tier_3").otherwise("").alias("tier"), F.size("facts").alias("facts"), "advances")


@query(f"WITH {_BATCHES}, i AS (SELECT b.run_id, l_orderkey AS batch_id, l_linenumber AS item, l_quantity >= 10 AS ok FROM b JOIN lineitem ON b.batch_id = l_orderkey WHERE status = 'verified') SELECT run_id, batch_id, item FROM i WHERE ok")
def verified_records(t: Tables) -> DataFrame:
    """The items of verified batches that pass their checks again."""
    return runs.verified(_filled(t), F.col("quantity") >= 10)[0].select("run_id", "batch_id", "item")


@query(f"WITH {_BATCHES} SELECT b.run_id, count(*) FILTER (l_quantity < 10)::BIGINT AS rejected FROM b JOIN lineitem ON b.batch_id = l_orderkey WHERE status = 'verified' GROUP BY 1")
def rejected_records(t: Tables) -> DataFrame:
    return runs.verified(_filled(t), F.col("quantity") >= 10)[1]


def _filled(t: Tables) -> DataFrame:
    """Batches with their items; an order's lines are few."""
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("batch_id")).agg(F.collect_list(F.struct(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("item"), F.col("l_quantity").alias("quantity"))).alias("items"))
    return batches(t).join(items, "batch_id").select("run_id", "status", "items")


@query(f"""WITH {_C} SELECT record, score, CASE WHEN record % 4 = 0 THEN 'tier_2' ELSE {_TIER} END AS tier, CASE WHEN record % 6 = 0 THEN false ELSE score >= 60 END AS passed FROM c""")
def derived_claims(t: Tables) -> DataFrame:
    """Score, tier and passed of records, some of which say a tier or a pass of their own."""
    own = scores(t).select("record", F.col("score").alias("derived"), F.when(F.col("record") % 4 == 0, "tier_2").alias("said_tier"), F.when(F.col("record") % 6 == 0, False).alias("said_passed"))
    return runs.derived(own, pass_score=60)


@query("SELECT o_custkey % 40 AS run_id, o_orderkey AS item_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey::VARCHAR ELSE 'firm_' || o_custkey END AS entity, (o_custkey % 100)::DOUBLE AS score FROM orders WHERE o_orderkey % 4 = 1")
def score_history(t: Tables) -> DataFrame:
    """Only numbers enter the history of scores: no booleans, words or nulls."""
    own = claims(t).select((F.col("firm") % 40).alias("run_id"), F.col("record").alias("item_id"), F.when(F.col("record") % 5 == 0, "").otherwise(F.concat(F.lit("firm_"), "firm")).alias("entity"), F.create_map(F.lit("score"), F.col("claims")["mixed"]).alias("claims"))
    return runs.history(own)


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 1 THEN 'reported_zero' ELSE 'billed' END AS state, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def receipt_cost_state(t: Tables) -> DataFrame:
    cost = F.when(F.col("o_orderkey") % 3 == 1, 0.0).when(F.col("o_orderkey") % 3 == 2, F.col("o_totalprice"))
    return t.orders.groupBy(runs.cost_state(cost).alias("state")).agg(F.count("*").alias("n"))


_WHY = "CASE p_partkey % 6 WHEN 0 THEN 'the ladder does not name it' WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'No sitemap there' WHEN 3 THEN 'timed out' WHEN 4 THEN 'connection refused' ELSE 'empty page' END"


@query("SELECT CASE WHEN p_partkey % 6 = 0 THEN 'not named' WHEN p_partkey % 6 < 5 THEN 'dead path' ELSE 'nothing there' END AS kind, count(*)::BIGINT AS n FROM part GROUP BY 1")
def skip_kinds(t: Tables) -> DataFrame:
    return t.part.groupBy(runs.skip_kind(F.expr(_WHY)).alias("kind")).agg(F.count("*").alias("n"))


_ROUTE = "CASE p_partkey % 6 WHEN 0 THEN concat('prov/', p_brand, '/x:1') WHEN 1 THEN concat(' prov:', p_brand, ' ') WHEN 2 THEN 'alone' WHEN 3 THEN '/half' WHEN 4 THEN '  ' ELSE 'half:' END"


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'prov' WHEN 1 THEN 'prov' WHEN 2 THEN 'alone' END AS provider, CASE p_partkey % 6 WHEN 0 THEN concat(p_brand, '/x:1') WHEN 1 THEN p_brand END AS model FROM part""")
def route_ids(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), runs.route_parts(F.expr(_ROUTE)).alias("r")).select("id", "r.provider", "r.model")


_MODEL = """CASE p_partkey % 7 WHEN 0 THEN '{"id":"a","pricing":{"prompt":"0","completion":"0"}}' WHEN 1 THEN '{"id":"b","pricing":{"prompt":"0","completion":"0.2"}}' WHEN 2 THEN '{"id":"c:free"}' WHEN 3 THEN '{"id":"d","cost":{"input":0,"output":0},"architecture":{"output_modalities":["text"]}}'
  WHEN 4 THEN '{"id":"e","pricing":{"prompt":"0"},"architecture":{"output_modalities":["text","image"]}}' WHEN 5 THEN '{"id":"f","pricing":{"prompt":"x","completion":"0"},"architecture":{"output_modalities":[]}}' ELSE '{"id":"g is free of charge"}' END"""


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 IN (0, 3) THEN 'price_observed_zero' WHEN p_partkey % 7 IN (2, 6) THEN 'candidate' ELSE 'unknown' END AS price_state, p_partkey % 7 <> 4 AS writes_text FROM part""")
def model_classes(t: Tables) -> DataFrame:
    """Price evidence and usability of listed models, from their JSON."""
    return t.part.select(F.col("p_partkey").alias("id"), runs.price_state(F.expr(_MODEL)).alias("price_state"), runs.writes_text(F.expr(_MODEL)).alias("writes_text"))


@query("""SELECT o_orderkey AS record, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'a · yes' END WHEN 1 THEN (o_custkey % 100)::VARCHAR WHEN 2 THEN o_orderpriority ELSE 'yes' END AS label FROM orders""")
def facet_labels(t: Tables) -> DataFrame:
    value = F.when(F.col("record") % 8 == 0, F.lit('["a", "", true]')).otherwise(F.col("claims")["mixed"])
    return claims(t).select("record", runs.facet_label(value).alias("label"))
