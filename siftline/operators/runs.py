"""Runs and their records: statuses, snapshots, retention, and rows for the board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import urls as U
from siftline.operators import scoring

OPEN = ("pending", "leased")


def finalise(runs: DataFrame, batches: DataFrame) -> DataFrame:
    """runs (run_id, max_attempts, attempts_used) and batches (run_id, status) -> (run_id, status) when a run ends.

    Open batches make it exhausted if the attempts are used up, else completed with failures; so do failed ones. A run without batches is complete.
    """
    tally = batches.groupBy("run_id").agg(F.bool_or(F.col("status").isin(*OPEN)).alias("open"), F.bool_or(F.col("status") == "failed").alias("failed"))
    both = runs.join(tally, "run_id", "left")
    spent = F.when(F.col("attempts_used") >= F.col("max_attempts"), "budget_exhausted").otherwise("completed_with_failures")
    return both.select("run_id", F.when(F.col("open"), spent).when(F.col("failed"), "completed_with_failures").otherwise("completed").alias("status"))


def snapshot(batches: DataFrame, results: DataFrame, receipts: DataFrame) -> DataFrame:
    """Every batch of a run with its current result and that result's receipt; batches without one stay.

    batches (run_id, batch_id, status), results (batch_id, result_id, receipt_id, at), receipts (receipt_id, cost). The latest result of a batch is current.
    """
    latest = results.groupBy("batch_id").agg(F.max_by(F.struct("result_id", "receipt_id"), F.struct("at", "result_id")).alias("r")).select("batch_id", "r.*")
    return batches.join(latest, "batch_id", "left").join(receipts, "receipt_id", "left").select(*batches.columns, "result_id", "receipt_id", "cost")


def newest(runs: DataFrame, most: int = 25) -> DataFrame:
    """The latest runs first; of equal times the larger id."""
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(most)


def keep_newest(rows: DataFrame, keys: list[str], order: list[Column], most: int = vocab.EVALS_KEPT) -> DataFrame:
    """At most ``most`` rows of each key, the first by ``order``."""
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= most).drop("__place")


def earliest_expiry(cooldowns: DataFrame, now: Column) -> DataFrame:
    """(until): when the first of the cooldowns still running ends; null if none runs."""
    return cooldowns.agg(F.min(F.when(F.col("until") > now, F.col("until"))).alias("until"))


def attempts(rows: DataFrame) -> DataFrame:
    """(dag_id, node_id, attempts, next_seq): the attempts of each node that have rows, and the number of the next."""
    return rows.groupBy("dag_id", "node_id").agg(F.array_sort(F.collect_set("run_seq")).alias("attempts"), (F.max("run_seq") + 1).alias("next_seq"))


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): how many rows each table has, and how many attempts the rung table ``rows``."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    tries = tables["rows"].select("dag_id", "node_id", "run_seq").distinct().agg(F.count("*").alias("n")).select(F.lit("attempts").alias("name"), "n")
    return out.unionByName(tries)


def main_lane(events: DataFrame) -> DataFrame:
    """(run_id, lane): the lane that most of a run's events name; the first by name of equals. Events that name none don't count."""
    each = events.where("lane <> ''").groupBy("run_id", "lane").agg(F.count("*").alias("n"))
    return each.groupBy("run_id").agg(F.min_by("lane", F.struct(-F.col("n"), F.col("lane"))).alias("lane"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same keys, and the others of ``new`` besides: one aggregate."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__new").alias("r"))
    return picked.select(*keys, "r.*").select(*old.columns)


# --- records ----------------------------------------------------------------------------------------
def first_number(claims: Column, names: tuple[str, ...]) -> Column:
    """The first of the named claims (a map of JSON texts) that is a number; 0 if none is. Booleans and quoted numerals are none."""
    each = [F.when(F.try_element_at(claims, F.lit(n)).rlike(r"^-?[0-9]"), F.try_element_at(claims, F.lit(n)).try_cast("double")) for n in names]
    return F.coalesce(*each, F.lit(0.0))


def first_text(claims: Column, names: tuple[str, ...]) -> Column:
    """The first of the named claims that says something."""
    each = [F.nullif(F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(claims, F.lit(n)), F.lit("}")), "$.v"), F.lit("")) for n in names]
    return F.coalesce(*each)


SCORE_FIELDS = ("score", "fit_score", "priority")
REASON_FIELDS = ("reasoning", "reason", "identified_gap", "fit_hypothesis", "revenue_hypothesis")
NO_CLAIMS = "0.0: no checklist claims verified with cited quotes"


def score_rows(records: DataFrame) -> DataFrame:
    """records (item_id, candidate, claims, tier) -> one row of the rung table for each scored firm: score, why, tier, and the facts as sorted lines.

    The facts are the claims and, in place of the claim ``answers``, its own entries.
    """
    claims, score = F.col("claims"), first_number(F.col("claims"), SCORE_FIELDS)
    because = F.coalesce(first_text(claims, REASON_FIELDS), F.when(score == 0, NO_CLAIMS), F.lit(""))
    answers = F.coalesce(F.from_json(F.try_element_at(claims, F.lit("answers")), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    every = F.map_concat(F.map_filter(claims, lambda k, _: (k != "answers") & ~F.map_contains_key(answers, k)), answers)
    facts = F.array_sort(F.transform(F.map_entries(every), lambda e: F.concat(e.key, F.lit("="), e.value)))
    tier = F.coalesce(F.nullif("tier", F.lit("")), first_text(claims, ("fit_tier",)), F.lit(""))
    return records.select(
        "item_id", F.coalesce(F.nullif("candidate", F.lit("")), F.col("item_id").cast("string")).alias("candidate"), F.lit("score").alias("rung"), F.lit("fetched").alias("evidence"), F.lit("").alias("outcome"),
        F.substring(because, 1, 400).alias("because"), score.alias("score"), tier.alias("tier"), facts.alias("facts"), F.lit(False).alias("advances"),
    )


def verified(batches: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """batches (run_id, status, items array<struct>) -> the good items of verified batches, and (run_id, rejected): how many of theirs ``valid`` refuses."""
    each = batches.where("status = 'verified'").select("run_id", F.explode("items").alias("i")).select("run_id", "i.*").withColumn("__ok", F.coalesce(valid, F.lit(False)))
    return each.where("__ok").drop("__ok"), each.groupBy("run_id").agg(F.count_if(~F.col("__ok")).alias("rejected"))


def derived(record: DataFrame, *, pass_score: int) -> DataFrame:
    """record (record, derived, said_tier, said_passed): the checklist's score goes before any said; tier and passed are derived only where they are not said."""
    return record.select("record", F.col("derived").alias("score"), F.coalesce("said_tier", scoring.tier(F.col("derived"))).alias("tier"), F.coalesce("said_passed", F.col("derived") >= pass_score).alias("passed"))


def history(records: DataFrame) -> DataFrame:
    """records (run_id, item_id, entity, claims) -> (run_id, item_id, entity, score): scores that are numbers, under the entity or else the item."""
    score = F.try_element_at(F.col("claims"), F.lit("score"))
    return records.where(score.rlike(r"^-?[0-9]")).select("run_id", "item_id", F.coalesce(F.nullif("entity", F.lit("")), F.col("item_id").cast("string")).alias("entity"), score.try_cast("double").alias("score"))


def cost_state(cost: Column) -> Column:
    """unknown, reported_zero or billed."""
    return F.when(cost.isNull(), "unknown").when(cost == 0, "reported_zero").otherwise("billed")


# --- small readings ---------------------------------------------------------------------------------
def skip_kind(reason: Column) -> Column:
    """Why a surface was passed over: not named by the ladder, a dead path, or nothing there."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    dead = F.contains(low, F.lit("http ")) | F.contains(low, F.lit("no sitemap")) | F.contains(low, F.lit("timed out")) | F.contains(low, F.lit("refused"))
    return F.when(F.contains(low, F.lit("ladder does not name")), "not named").when(dead, "dead path").otherwise("nothing there")


def route_parts(route: Column) -> Column:
    """(provider, model) of a route id: parted at its first slash, or else colon; a name alone has no model; null where a part is empty."""
    own = F.trim(route)
    pattern = F.when(F.contains(own, F.lit("/")), "(?s)^([^/]*)/(.*)$").when(F.contains(own, F.lit(":")), "(?s)^([^:]*):(.*)$")
    head, rest = (F.call_function("regexp_extract", own, pattern, F.lit(i)) for i in (1, 2))
    both = F.struct(F.coalesce(head, own).alias("provider"), rest.alias("model"))
    return F.when((own != "") & (pattern.isNull() | ((head != "") & (rest != ""))), both)


def price_state(model: Column) -> Column:
    """model is JSON text: prices that are all given and all zero are observed zeros; a free name alone is a candidate; all else is unknown."""
    pricing = F.coalesce(F.get_json_object(model, "$.pricing"), F.get_json_object(model, "$.cost"))
    given = lambda a, b: F.coalesce(F.get_json_object(pricing, f"$.{a}"), F.get_json_object(pricing, f"$.{b}"))
    prices = F.from_json(pricing, "map<string,string>")
    every = F.forall(F.map_values(prices), lambda v: v.isNull() | (v.try_cast("double") == 0.0))
    number = F.forall(F.map_values(prices), lambda v: v.isNull() | v.try_cast("double").isNotNull())
    observed = pricing.isNotNull() & given("prompt", "input").isNotNull() & given("completion", "output").isNotNull() & number
    free = F.lower(model).rlike(r"\bfree\b|:free|-free|_free")
    return F.when(F.coalesce(observed, F.lit(False)), F.when(every, "price_observed_zero").otherwise("unknown")).when(free, "candidate").otherwise("unknown")


def writes_text(model: Column) -> Column:
    """Whether a model (JSON text) writes text alone; one that doesn't say does."""
    out = F.from_json(F.get_json_object(model, "$.architecture.output_modalities"), "array<string>")
    return F.coalesce(F.when(F.size(out) > 0, F.forall(out, lambda m: m == "text")), F.lit(True))


def facet_label(value: Column) -> Column:
    """A claim (JSON text) as a reader sees it: yes and no, words without quotes, lists joined by dots; null where there is nothing."""
    items = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    plain = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    listed = F.transform(items, lambda x: F.when(x == "true", "yes").when(x == "false", "no").otherwise(x))
    return (
        F.when(value.isNull() | value.isin("null", '""', "[]", "{}"), F.lit(None)).when(value == "true", "yes").when(value == "false", "no")
        .when(F.startswith(value, F.lit("[")), F.nullif(F.array_join(listed, " · "), F.lit(""))).otherwise(plain)
    )


def backed(quotes: DataFrame) -> DataFrame:
    """quotes (record, supports array) -> (record, backed): the items that any quote of a record supports, sorted; records that back none are left out."""
    return quotes.select("record", F.explode("supports").alias("item")).groupBy("record").agg(F.array_sort(F.collect_set("item")).alias("backed"))


def record_text(text: Column, quotes: Column) -> Column:
    """A record's own text, or its quotes (an array) in a row where it has none."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", text).otherwise(F.trim(F.array_join(quotes, " ")))


def candidate_name(metadata: Column, uri: Column, text: Column, item_id: Column) -> Column:
    """What a record is called: the entity or domain it names, the entity of its address, its id."""
    named = [F.nullif(F.trim(F.try_element_at(metadata, F.lit(k))), F.lit("")) for k in ("entity", "domain")]
    placed = F.when(F.trim(F.coalesce(uri, F.lit(""))) != "", F.nullif(U.attributed_entity(uri, text, F.lit("")), F.lit("")))
    return F.coalesce(*named, placed, item_id)


def item_entity(metadata: Column, uri: Column, text: Column, item_id: Column) -> Column:
    """The entity a captured item is filed under, if that is a plain id; items without an address are filed under themselves, others nowhere."""
    explicit = F.coalesce(*[F.nullif(F.trim(F.try_element_at(metadata, F.lit(k))), F.lit("")) for k in ("entity", "website", "hiring_domain", "hiring_organization")])
    plain = lambda c: c.rlike("^[A-Za-z0-9_.-]{1,128}$") & (c != "unknown_entity")
    said, derived = U.attributed_entity(uri, text, explicit), U.attributed_entity(uri, text, F.lit(""))
    return F.when(plain(said), said).when(plain(derived), derived).when(F.coalesce(uri, F.lit("")) != "", F.lit("")).otherwise(item_id)


def truth(quotes: DataFrame) -> DataFrame:
    """quotes (entity, quote, exact, addressed, page, asked) -> counts by exact, addressed and live: confirmed on the page, missing, unreachable (no page), not_checked."""
    live = F.when(~F.col("asked"), "not_checked").when(F.coalesce("page", F.lit("")) == "", "unreachable").when(F.contains("page", F.col("quote")), "confirmed").otherwise("missing")
    return quotes.withColumn("live", live).groupBy("exact", "addressed", "live").agg(F.count("*").alias("quotes"), F.count_distinct("entity").alias("entities"))


def lacking_required(coverage: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(entity, missing): entities whose flags lack a required kind."""
    gaps = F.array_compact(F.array(*[F.when(~F.col(k), F.lit(k)) for k in required]))
    return coverage.select("entity", gaps.alias("missing")).where(F.size("missing") > 0)
