"""Queries over claims: scoring, filters, sorts, ranks, facets, deliverables, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import calibrate, export, scoring
from siftline.operators.export import Clause, Filter
from siftline.operators.items import numbered
from siftline.queries.base import Tables, query

SCORED_AT = "1998-12-31 00:00:00"
WEIGHTS = (("firm.com", 0.5), ("firm.com/blog", 0.8), ("registry", 1.0), ("boards", 0.9))
ITEMS = {"q1_delivery_proof": 40, "q2_certification": 30, "q3_delivery_hiring": 20, "q4_growth_signal": 10}
HALF_LIVES = {"q1_delivery_proof": 365.0, "q3_delivery_hiring": 90.0}

#: A line of an order is a quote of the order's record in support of a checklist item.
_QUOTE = {
    "record": "l_orderkey", "item": "CASE l_linenumber % 4 WHEN 0 THEN 'q1_delivery_proof' WHEN 1 THEN 'q2_certification' WHEN 2 THEN 'q3_delivery_hiring' ELSE 'q4_growth_signal' END",
    "category": "CASE l_suppkey % 6 WHEN 0 THEN 'VENDOR_REGISTRY' WHEN 1 THEN 'B2B_DIRECTORY_AUDIT' WHEN 2 THEN 'FIRST_PARTY_CASE_STUDY' WHEN 3 THEN 'FIRST_PARTY_PRACTICE' WHEN 4 THEN 'ATS_REQUISITIONS' ELSE '' END",
    "uri": "CASE l_partkey % 5 WHEN 0 THEN 'https://firm.com/blog/x' WHEN 1 THEN 'https://firm.com/' WHEN 2 THEN 'https://boards.io/1' WHEN 3 THEN 'https://registry.org/p' ELSE 'https://else.net' END",
    "captured_at": "l_shipdate",
}
_Q = "q AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _QUOTE.items()) + f", TIMESTAMP '{SCORED_AT}' AS scored_at FROM lineitem)"


def quotes(t: Tables) -> DataFrame:
    return t.lineitem.select(*[F.expr(v).alias(k) for k, v in _QUOTE.items()], F.lit(SCORED_AT).cast("timestamp_ntz").alias("scored_at"))


def strengths(t: Tables) -> DataFrame:
    return scoring.strengths(quotes(t), items=tuple(ITEMS), weights=WEIGHTS, default=0.3, half_lives=HALF_LIVES)


_WEIGHT = "CASE WHEN contains(uri, 'firm.com/blog') THEN 0.8::DOUBLE WHEN contains(uri, 'firm.com') THEN 0.5::DOUBLE WHEN contains(uri, 'registry') THEN 1.0::DOUBLE WHEN contains(uri, 'boards') THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END"
_AGE = "greatest((epoch_us(scored_at) - epoch_us(captured_at)) / 86400000000.0::DOUBLE, 0.0::DOUBLE)"
_DECAY = f"CASE item WHEN 'q1_delivery_proof' THEN pow(0.5::DOUBLE, {_AGE} / 365.0::DOUBLE) WHEN 'q3_delivery_hiring' THEN pow(0.5::DOUBLE, {_AGE} / 90.0::DOUBLE) ELSE 1.0::DOUBLE END"
_OK = """CASE item WHEN 'q1_delivery_proof' THEN category IN ('VENDOR_REGISTRY', 'B2B_DIRECTORY_AUDIT', 'FIRST_PARTY_CASE_STUDY', '')
  WHEN 'q2_certification' THEN category IN ('VENDOR_REGISTRY', 'B2B_DIRECTORY_AUDIT', 'FIRST_PARTY_PRACTICE', '') WHEN 'q3_delivery_hiring' THEN category = 'ATS_REQUISITIONS' ELSE true END"""
_S = f"{_Q}, s AS (SELECT record, item, round(max(CASE WHEN {_OK} THEN {_WEIGHT} * {_DECAY} ELSE 0.0::DOUBLE END), 6) AS strength FROM q GROUP BY 1, 2)"
_POINTS = "CASE item WHEN 'q1_delivery_proof' THEN 40 WHEN 'q2_certification' THEN 30 WHEN 'q3_delivery_hiring' THEN 20 ELSE 10 END"
_C = f"{_S}, c AS (SELECT record, least(100, floor(round(sum({_POINTS} * strength), 6) + 0.5))::INT AS score FROM s GROUP BY 1)"
_TIER = "CASE WHEN score >= 85 THEN 'tier_1' WHEN score >= 70 THEN 'tier_2' WHEN score >= 50 THEN 'tier_3' ELSE 'unfit' END"


@query(f"WITH {_Q} SELECT uri, {_WEIGHT} AS weight, count(*)::BIGINT AS n FROM q GROUP BY 1, 2")
def source_weight_longest(t: Tables) -> DataFrame:
    return quotes(t).groupBy("uri", scoring.source_weight(F.col("uri"), WEIGHTS, 0.3).alias("weight")).agg(F.count("*").alias("n"))


@query(f"WITH {_Q} SELECT record, round(sum(pow(0.5::DOUBLE, {_AGE} / 365.0::DOUBLE)), 6) AS freshness FROM q GROUP BY 1")
def recency_decay(t: Tables) -> DataFrame:
    return quotes(t).groupBy("record").agg(F.round(F.sum(scoring.recency(F.col("captured_at"), F.col("scored_at"), 365.0)), 6).alias("freshness"))


@query(f"WITH {_S} SELECT * FROM s")
def support_strengths(t: Tables) -> DataFrame:
    return strengths(t)


def scores(t: Tables) -> DataFrame:
    points = F.element_at(F.create_map(*[F.lit(x) for pair in ITEMS.items() for x in pair]), F.col("item"))
    return strengths(t).groupBy("record").agg(scoring.checklist_score(points, F.col("strength")).alias("score"))


@query(f"WITH {_C} SELECT * FROM c")
def checklist_score(t: Tables) -> DataFrame:
    return scores(t)


@query(f"WITH {_C} SELECT record, score, {_TIER} AS tier, score >= 60 AS passed FROM c")
def fit_tier(t: Tables) -> DataFrame:
    return scores(t).select("record", "score", scoring.tier(F.col("score")).alias("tier"), (F.col("score") >= 60).alias("passed"))


@query(f"""WITH {_C}, k AS (SELECT c.record, c.score AS derived, (o.o_totalprice / 1000)::INT AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'tier_3' ELSE 'unfit' END AS said, o_orderkey % 5 = 0 AS passed FROM c JOIN orders o ON c.record = o.o_orderkey)
SELECT record, array_to_string(list_filter([CASE WHEN score <> derived THEN 'score' END, CASE WHEN said <> {_TIER.replace("score", "derived")} THEN 'tier' END, CASE WHEN passed <> (derived >= 60) THEN 'passed' END,
  CASE WHEN NOT (score BETWEEN 0 AND 100) THEN 'range' END], lambda x: x IS NOT NULL), ',') AS violations FROM k""")
def claims_consistency(t: Tables) -> DataFrame:
    said = t.orders.select(
        F.col("o_orderkey").alias("record"), F.round(F.col("o_totalprice") / 1000).cast("int").alias("score"), F.when(F.col("o_orderkey") % 2 == 0, "tier_3").otherwise("unfit").alias("said"), (F.col("o_orderkey") % 5 == 0).alias("passed"),
    )
    both = scores(t).withColumnRenamed("score", "derived").join(said, "record")
    return both.select("record", F.array_join(scoring.violations(F.col("score"), F.col("derived"), F.col("said"), F.col("passed"), 60), ",").alias("violations"))


# --- claims of orders: a map of JSON values ---------------------------------------------------------
def claims(t: Tables) -> DataFrame:
    text = F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))
    pairs = {
        "priority": text, "status": F.concat(F.lit('"'), "o_orderstatus", F.lit('"')), "score": F.col("o_totalprice").cast("string"), "urgent": (F.col("o_orderkey") % 3 == 0).cast("string"),
        "mixed": F.when(F.col("o_orderkey") % 4 == 0, F.lit("null")).when(F.col("o_orderkey") % 4 == 1, (F.col("o_custkey") % 100).cast("string")).when(F.col("o_orderkey") % 4 == 2, text).otherwise(F.lit("true")),
        "note": F.when(F.col("o_orderkey") % 7 != 0, F.lit('"n"')),
    }
    every = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return t.orders.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("firm"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("claims"))


@query("SELECT o_orderkey AS record FROM orders WHERE o_totalprice >= 30000 AND lower(o_orderstatus) = 'o' AND o_orderkey % 3 = 0")
def claim_filter_and(t: Tables) -> DataFrame:
    wanted = Filter(all=(Clause("score", ">=", 30_000), Clause("status", "==", "O"), Clause("urgent", "==", True)))
    return claims(t).where(export.holds(wanted, F.col("claims"))).select("record")


@query("SELECT o_orderkey AS record FROM orders WHERE o_orderkey % 3 <> 0 AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR (o_totalprice < 20000 AND o_orderstatus <> 'F'))")
def claim_filter_or_nested(t: Tables) -> DataFrame:
    wanted = Filter(all=(Clause("urgent", "!=", True),), any=(Filter(all=(Clause("priority", "in", ("1-urgent", "2-HIGH")),)), Filter(all=(Clause("score", "<", 20_000), Clause("status", "not_in", ("F",))))))
    return claims(t).where(export.holds(wanted, F.col("claims"))).select("record")


@query("SELECT o_orderkey AS record FROM orders WHERE o_orderkey % 7 = 0 AND NOT (o_orderkey % 4 = 1 AND o_custkey % 100 > 50) AND o_orderkey % 4 <> 3")
def claim_filter_missing_keys(t: Tables) -> DataFrame:
    """Missing claims satisfy != alone; booleans count as numbers for comparison but never equal one."""
    small = Filter(any=(Filter(all=(Clause("mixed", "<=", 50), Clause("mixed", "!=", True))), Filter(all=(Clause("mixed", "==", None),)), Filter(all=(Clause("mixed", "in", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),))))
    own = claims(t).where(export.holds(Filter(all=(Clause("note", "!=", "n"),)), F.col("claims")))
    return own.where(export.holds(small, F.col("claims"))).select("record")


_MIXED = "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN {n} WHEN 2 THEN {s} ELSE {n} END"
_NUM = "CASE o_orderkey % 4 WHEN 1 THEN (o_custkey % 100)::DOUBLE WHEN 3 THEN 1.0::DOUBLE END"


@query(f"SELECT o_orderkey AS record, row_number() OVER (ORDER BY {_MIXED.format(n=1, s=2)}, {_NUM} NULLS FIRST, CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority END NULLS FIRST, o_orderkey)::INT AS rank FROM orders")
def typed_sort_asc(t: Tables) -> DataFrame:
    return export.ranked(claims(t).select("record", F.col("claims")["mixed"].alias("mixed")), export.typed(F.col("mixed")), "record").select("record", "rank")


@query(f"SELECT o_orderkey AS record, row_number() OVER (ORDER BY {_MIXED.format(n=2, s=1)} DESC, {_NUM} DESC NULLS LAST, CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority END DESC NULLS LAST, o_orderkey)::INT AS rank FROM orders")
def typed_sort_desc(t: Tables) -> DataFrame:
    own = claims(t).select("record", F.col("claims")["mixed"].alias("mixed"))
    return export.ranked(own, export.typed(F.col("mixed"), descending=True), "record", descending=True).select("record", "rank")


@query("SELECT o_orderkey AS record, o_totalprice AS score, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders QUALIFY rank <= 100")
def topk_rank(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_orderkey").alias("record"), F.col("o_totalprice").alias("score"))
    return export.top(own, [F.desc("score"), F.asc("record")], 100)


@query(f"""WITH {_C}, b AS (SELECT record, greatest(0.0::DOUBLE, least(100.0::DOUBLE, score - (record % 10)::DOUBLE)) AS adjusted FROM c)
SELECT record, adjusted, row_number() OVER (ORDER BY adjusted DESC, record)::INT AS rank FROM b QUALIFY rank <= 100""")
def bias_adjusted_rank(t: Tables) -> DataFrame:
    own = scores(t).select("record", export.bias_adjusted(F.col("score").cast("double"), (F.col("record") % 10).cast("double")).alias("adjusted"))
    return export.top(own, [F.desc("adjusted"), F.asc("record")], 100)


@query("""SELECT 'priority' AS facet, o_orderpriority AS value, count(*)::BIGINT AS n FROM orders GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*)::BIGINT FROM orders GROUP BY 2
UNION ALL SELECT 'urgent', CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END, count(*)::BIGINT FROM orders GROUP BY 2""")
def facet_counts(t: Tables) -> DataFrame:
    """All facets in one pass over the claims."""
    pairs = F.explode(F.map_entries(F.map_filter("claims", lambda k, _: k.isin("priority", "status", "urgent"))))
    return claims(t).select(pairs.alias("e")).groupBy(F.col("e.key").alias("facet"), F.trim("e.value", F.lit('"')).alias("value")).agg(F.count("*").alias("n"))


@query(f"WITH {_C} SELECT {_TIER} AS tier, count(*)::BIGINT AS n, round(avg(score), 4) AS mean, max(score) AS best, min(score) AS worst FROM c GROUP BY 1")
def board_stats(t: Tables) -> DataFrame:
    own = scores(t).withColumn("tier", scoring.tier(F.col("score")))
    return own.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.max("score").alias("best"), F.min("score").alias("worst"))


@query("SELECT o_orderkey AS record, concat_ws(', ', CASE WHEN o_orderkey % 7 <> 0 THEN 'n' END, o_orderpriority, o_orderstatus) AS highlights FROM orders")
def highlights(t: Tables) -> DataFrame:
    """The first of a fixed list of claims that are there, at most four."""
    picked = F.array_compact(F.array(*[F.trim(F.try_element_at("claims", F.lit(k)), F.lit('"')) for k in ("note", "priority", "status")]))
    return claims(t).select("record", F.array_join(F.slice(picked, 1, 4), ", ").alias("highlights"))


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS records, round(sum(o_totalprice), 2) AS cost, count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED')::BIGINT AS unknown_cost, count(DISTINCT o_custkey)::BIGINT AS firms FROM orders GROUP BY 1")
def packet_audit(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("records"), F.round(F.sum("o_totalprice"), 2).alias("cost"), F.count_if(F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("unknown_cost"), F.count_distinct("o_custkey").alias("firms")
    )


@query(f"WITH {_C} SELECT record AS entity, score, {_TIER} AS tier FROM c WHERE score >= 40 ORDER BY score DESC, record LIMIT 60")
def deliverable(t: Tables) -> DataFrame:
    """The sixty best at or above the bar."""
    own = scores(t).where("score >= 40").orderBy(F.desc("score"), "record").limit(60)
    return own.select(F.col("record").alias("entity"), "score", scoring.tier(F.col("score")).alias("tier"))


@query(f"""WITH {_C}, f AS (SELECT o.o_custkey % 20 AS lane, c.score FROM c JOIN orders o ON c.record = o.o_orderkey) SELECT lane, count(*) FILTER (score >= 40)::BIGINT AS delivered, least(50, count(*) FILTER (score >= 40))::BIGINT AS counted,
  CASE WHEN count(*) FILTER (score >= 40) >= 50 THEN 'met' WHEN count(*) < 50 THEN 'too few candidates' ELSE 'bar too high' END AS diagnosis FROM f GROUP BY 1""")
def quota_diagnosis(t: Tables) -> DataFrame:
    """Each lane against its quota of fifty, and why it falls short."""
    own = scores(t).join(t.orders.select(F.col("o_orderkey").alias("record"), (F.col("o_custkey") % 20).alias("lane")), "record")
    good = F.count_if(F.col("score") >= 40)
    return own.groupBy("lane").agg(good.alias("delivered"), F.least(F.lit(50), good).cast("long").alias("counted"), F.when(good >= 50, "met").when(F.count("*") < 50, "too few candidates").otherwise("bar too high").alias("diagnosis"))



@query(f"WITH {_C}, n AS (SELECT record, score, o_totalprice / 600 AS expected, record % 5 = 0 AS held FROM c JOIN orders ON record = o_orderkey) SELECT held, count(*)::BIGINT AS n, round(avg(pow(score - expected, 2)), 4) AS mse, round(avg(abs(score - expected)), 4) AS mae FROM n GROUP BY 1")
def calibration_errors(t: Tables) -> DataFrame:
    """Errors of derived scores, apart for the fifth held out. Observations are told apart by their id, not by a global row number."""
    own = scores(t).join(t.orders.select(F.col("o_orderkey").alias("record"), (F.col("o_totalprice") / 600).alias("expected")), "record")
    e = F.col("score") - F.col("expected")
    return own.groupBy((F.col("record") % 5 == 0).alias("held")).agg(F.count("*").alias("n"), F.round(F.avg(e * e), 4).alias("mse"), F.round(F.avg(F.abs(e)), 4).alias("mae"))


@query(f"WITH {_C}, n AS (SELECT record, score, o_totalprice / 600 AS expected, (row_number() OVER (ORDER BY record) - 1) % 5 = 0 AS held FROM c JOIN orders ON record = o_orderkey) SELECT held, count(*)::BIGINT AS n, round(avg(pow(score - expected, 2)), 4) AS mse, round(avg(abs(score - expected)), 4) AS mae FROM n GROUP BY 1")
def calibration_stride(t: Tables) -> DataFrame:
    """Errors of derived scores, apart for each fifth observation by its place, counted in stretches of ids."""
    own = scores(t).join(t.orders.select(F.col("o_orderkey").alias("record"), (F.col("o_totalprice") / 600).alias("expected")), "record").withColumn("all", F.lit(0))
    e = F.col("score") - F.col("expected")
    placed = numbered(own, by="all", order="record", span=1_000)
    return placed.groupBy((F.col("place") % 5 == 0).alias("held")).agg(F.count("*").alias("n"), F.round(F.avg(e * e), 4).alias("mse"), F.round(F.avg(F.abs(e)), 4).alias("mae"))


@query()
def calibration_fit(t: Tables) -> DataFrame:
    """Checklist points fitted to expected scores of each priority's records, from sums that Spark aggregates."""
    wide = strengths(t).groupBy("record").agg(*[F.coalesce(F.max(F.when(F.col("item") == i, F.col("strength"))), F.lit(0.0)).alias(i) for i in ITEMS])
    own = wide.join(t.orders.select(F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("task"), (F.col("o_totalprice") / 600).alias("expected")), "record")
    return calibrate.fit(own, by="task", items=list(ITEMS), expected="expected")


def observations(t: Tables) -> DataFrame:
    """Expected scores of the records; each fifth by its place is held out."""
    own = t.orders.select(F.col("o_orderkey").alias("record"), (F.col("o_totalprice") / 600).alias("expected"), F.lit(0).alias("all"))
    own = own.join(quotes(t).select("record").distinct(), "record", "left_semi")
    return numbered(own, by="all", order="record", span=1_000).select("record", "expected", (F.col("place") % 5 == 0).alias("held"))


START = calibrate.Calibration({k: float(v) for k, v in ITEMS.items()}, dict(WEIGHTS), 0.3, HALF_LIVES)


@query()
def calibration_tables(t: Tables) -> DataFrame:
    """Points, source weights and half-lives fitted together to expected scores, with the errors of the fitted tables and of those held out."""
    found, errors = calibrate.fit_tables(quotes(t), observations(t), START, sweeps=4)
    values = [("points", k, v) for k, v in found.points.items()] + [("weights", k, v) for k, v in found.weights.items()] + [("weights", "", found.default)] + [("halves", k, v) for k, v in found.half_lives.items()]
    rows = [(kind, name, round(value, 6), round(errors["train"][0], 4), round(errors["held"][0], 4)) for kind, name, value in values]
    return t.spark.createDataFrame(rows, "kind string, name string, value double, mse double, held_mse double")
