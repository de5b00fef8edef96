"""Mixing sources to target weights by temperature, with DataFrame operations alone.

Token shares p are raised to an exponent and normalised. The exponent is bisected to the smallest one whose
weights meet a repetition limit, or to the one whose weights meet a target entropy. The budget is the least that reads every
source in full once; a source's stream is its documents in a new permutation for each epoch, cut at its share of the budget,
and laid evenly over blocks of a fixed number of tokens, which are permuted in themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import NULL_ID, WORD, fresh, materialise

STEPS = 40
#: Where the search for a target entropy ends; exponents above 1 favour large sources.
SHARPEST = 16.0


def tokens(text: Column) -> Column:
    """Words and an end mark; 1 for null and empty texts."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def _source(source: Column) -> Column:
    """A join key that is never null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def exponent(shares: DataFrame, *, max_repeats: float | None, target_entropy: float | None) -> float:
    """Bisect the exponent over (p): repetitions and entropy (bits) both fall as it grows. Each step is one aggregate row."""

    def bisect(holds, high: float) -> float:
        low = 0.0
        if holds(low):
            return low
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if holds(middle) else (middle, high)
        return high

    found = [0.0] if max_repeats or target_entropy is not None else [1.0]
    if max_repeats:
        least, most = shares.agg(F.min("p"), F.max("p")).first()
        found.append(bisect(lambda a: (most / least) ** (1 - a) <= max_repeats, 1.0) if least else 1.0)
    if target_entropy is not None:
        p = F.col("p")

        def low_enough(a: float) -> bool:
            power = F.pow(p, F.lit(a))
            z, s = shares.agg(F.sum(power), F.sum(power * F.log2(power))).first()
            return z is None or math.log2(z) - s / z <= target_entropy  # bits of the normalised powers

        found.append(bisect(low_enough, SHARPEST))
    return max(found)


def weights(own: DataFrame, *, max_repeats: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """(src, total, weight, share): each source's tokens, its weight, and its tokens in the budget (at least total)."""
    totals = materialise(own.groupBy("src").agg(F.sum("tokens").alias("total")), "sources")
    every = totals.agg(F.sum("total")).first()[0] or 1
    shares = totals.select("src", "total", (F.col("total") / F.lit(float(every))).alias("p"))
    a = exponent(shares, max_repeats=max_repeats, target_entropy=target_entropy)
    powers = shares.withColumn("power", F.pow("p", F.lit(a)))
    z, most = powers.agg(F.sum("power"), F.max(F.col("total") / F.col("power"))).first()
    return powers.select("src", "total", (F.col("power") / F.lit(z or 1.0)).alias("weight"), F.greatest(F.col("power") * F.lit(most or 1.0), F.col("total").cast("double")).alias("share"))


def order(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = 1 << 20, seed: int = 7, rows_in_task: int = 4096) -> DataFrame:
    """One row per document and epoch: doc_id, key (hash of the text), source, tokens, weight, epoch, block, slot.

    Every row of ``docs`` comes in epoch 0; the rows of small sources come again in later epochs. A null source is a source
    of its own. Null and empty texts count one token. Repeated rows come each for itself. An empty table gives none.
    """
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("key"), F.col(source).cast("string").alias("source"),
        _source(F.col(source)).alias("src"), tokens(F.col(text)).alias("tokens"),
    )
    own = materialise(own, "tokens")
    rated = materialise(weights(own, max_repeats=max_repeats, target_entropy=target_entropy), "weights")
    rows, budget = own.count(), rated.agg(F.sum("share")).first()[0] or 0.0
    blocks = max(1, -int(-budget // block_tokens))
    buckets = rows // rows_in_task + 1
    # The number of sources isn't bounded, so the join is left to the planner.
    epochs = own.join(rated, "src").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("share") / F.col("total") - 1e-9) - 1).cast("int"))))
    drawn = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("epoch").cast("string"), F.lit(str(seed))).cast("binary"))
    epochs = epochs.withColumn("drawn", drawn).withColumn("bucket", F.floor(F.conv(F.substring("drawn", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    heaps = epochs.groupBy("src", "epoch", "bucket").agg(F.sum("tokens").alias("heap"))
    heaps = heaps.select("src", "epoch", "bucket", (F.sum("heap").over(Window.partitionBy("src", "epoch").orderBy("bucket")) - F.col("heap")).alias("base"))
    inside = Window.partitionBy("src", "epoch", "bucket").orderBy("drawn", "key").rowsBetween(Window.unboundedPreceding, 0)
    laid = epochs.withColumn("upto", F.sum("tokens").over(inside)).join(heaps, ["src", "epoch", "bucket"])
    laid = laid.withColumn("pos", F.col("epoch") * F.col("total") + F.col("base") + F.col("upto") - F.col("tokens"))
    laid = laid.where((F.col("epoch") == 0) | (F.col("pos") < F.col("share")))
    laid = laid.withColumn("block", F.least(F.floor(F.col("pos") / F.col("share") * blocks), F.lit(blocks - 1)).cast("int"))
    again = F.md5(F.concat(F.col("drawn"), F.lit("block")).cast("binary"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy(again, "key")) - 1
    return laid.select("doc_id", "key", "source", "tokens", F.round("weight", 9).alias("weight"), "epoch", "block", slot.alias("slot"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """The order without the text hashes."""
    return order(docs, **options).drop("key")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with its rows as often as the mix takes them, at least once; all columns stay.

    Rows that repeat id and text are drawn one by one: together they come as often as the mix takes them.
    """
    names = {stem: fresh(docs, stem) for stem in ("id", "key", "times", "copies", "row", "n")}
    id_, key, times_, copies_, row, n = names.values()
    keys = [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias(id_), F.coalesce(F.xxhash64(F.col(text)), F.lit(0)).alias(key)]
    taken = order(docs, doc_id=doc_id, text=text, **options).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(id_), F.coalesce("key", F.lit(0)).alias(key), "epoch")
    # A repeated row is in epoch 0 as often as in docs.
    times = materialise(taken.groupBy(id_, key).agg(F.count("*").alias(times_), F.count_if(F.col("epoch") == 0).alias(copies_)), "times")
    often = docs.select("*", *keys).join(times, [id_, key])
    alone = often.where(F.col(copies_) == 1).withColumn(row, F.lit(1))
    copies = often.where(F.col(copies_) > 1).withColumn(row, F.row_number().over(Window.partitionBy(id_, key).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))))
    own = F.floor(F.col(times_) / F.col(copies_)) + (F.col(row) <= F.col(times_) % F.col(copies_)).cast("int")
    every = alone.unionByName(copies).withColumn(n, F.explode(F.sequence(F.lit(1), own.cast("int"))))
    return every.drop(*names.values())


ORACLE_SQL = rf"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS src, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS tokens FROM documents),
totals AS (SELECT src, sum(tokens)::BIGINT AS total FROM own GROUP BY src),
shares AS (SELECT src, total, total::DOUBLE / (SELECT sum(total) FROM totals)::DOUBLE AS p FROM totals),
ends AS (SELECT min(p) AS least, max(p) AS most FROM shares),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, CASE WHEN most / least <= 2.0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS high FROM ends
  UNION ALL
  SELECT step + 1, CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2.0 THEN low ELSE (low + high) / 2 END,
    CASE WHEN pow(most / least, 1 - (low + high) / 2) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM bisect, ends WHERE step < {STEPS}),
powers AS (SELECT src, total, pow(p, (SELECT high FROM bisect WHERE step = {STEPS})) AS power FROM shares),
rated AS (
  SELECT src, total, power / (SELECT sum(power) FROM powers) AS weight,
    greatest(power * (SELECT max(total / power) FROM powers), total::DOUBLE) AS share FROM powers),
size AS (SELECT greatest(1, ceil((SELECT sum(share) FROM rated) / 1048576))::INT AS blocks),
epochs AS (
  SELECT o.*, r.total, r.weight, r.share, e.epoch, md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), e.epoch::VARCHAR, '7')) AS drawn
  FROM own o JOIN rated r USING (src), unnest(range(0, ceil(r.share / r.total - 1e-9)::INT)) AS e(epoch)),
laid AS (
  SELECT *, epoch * total + sum(tokens) OVER (PARTITION BY src, epoch ORDER BY drawn ROWS UNBOUNDED PRECEDING) - tokens AS pos FROM epochs),
blocked AS (
  SELECT *, least(floor(pos::DOUBLE / share * blocks), blocks - 1)::INT AS block FROM laid, size WHERE epoch = 0 OR pos < share)
SELECT doc_id, source, tokens::BIGINT AS tokens, round(weight, 9) AS weight, epoch::INT AS epoch, block,
  (row_number() OVER (PARTITION BY block ORDER BY md5(drawn || 'block')) - 1)::INT AS slot
FROM blocked
"""
