"""Batches of consecutive items under a budget, as a parallel scan.

A batch closes before the item that would take it over its characters, and after so many items. Where a batch begins depends on all
batches before it, but only through one number: how far into a stretch of items the first new batch begins. So each stretch works out,
for every such number, where it hands over to the next stretch; these small maps are composed, and then each stretch is cut for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.items import numbered, same

def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _taken(items: Column, at: Column, most_items: int, most_chars: int) -> Column:
    """How many items a batch holds that begins at index ``at``. The first one always fits."""
    start = F.struct(_long(0).alias("chars"), _long(0).alias("n"), F.lit(True).alias("open"))

    def step(b: Column, item: Column) -> Column:
        fits = b["open"] & ((b["n"] == 0) | F.lit(most_chars == 0) | (b["chars"] + item["size"] <= most_chars))
        return F.struct((b["chars"] + F.when(fits, item["size"]).otherwise(_long(0))).alias("chars"), (b["n"] + F.when(fits, _long(1)).otherwise(_long(0))).alias("n"), fits.alias("open"))

    return F.aggregate(F.slice(items, at + 1, most_items), start, step, lambda b: b["n"])


def _composed(first: Column, then: Column) -> Column:
    """The map of one stretch after another: both are lists of (to, made) by the place of entry."""
    return F.transform(first, lambda e: F.struct(F.get(then, e["to"].cast("int"))["to"].alias("to"), (e["made"] + F.get(then, e["to"].cast("int"))["made"]).alias("made")))


def _entries(maps: Column, entry: Column, made: Column) -> Column:
    """For maps in order, (at, entry, made) of each: where its first new batch begins, and how many have begun before it."""
    start = F.struct(entry.alias("entry"), made.alias("made"), F.array().cast("array<struct<at:long,entry:long,made:long>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        own = F.get(m["map"], s["entry"].cast("int"))
        told = F.struct(m["at"].alias("at"), s["entry"].alias("entry"), s["made"].alias("made"))
        return F.struct(own["to"].alias("entry"), (s["made"] + own["made"]).alias("made"), F.concat(s["out"], F.array(told)).alias("out"))

    return F.aggregate(maps, start, step, lambda s: s["out"])


def packed(rows: DataFrame, *, by: str, order: str, size: str, most_items: int = 6, most_chars: int = 0, stretch: int = 2048, fan: int = 2048) -> DataFrame:
    """(by, order, size, place, batch): the items of each ``by`` in the order of a whole number, dealt into batches that are numbered from 0.

    A batch has at most ``most_items`` items and, unless ``most_chars`` is 0, at most so many characters: only an item that is larger
    by itself stands alone in a larger one. ``order`` is unique within ``by``; null is a ``by`` of its own, a null size counts 0. No
    task holds more than ``stretch`` items with the few that follow, ``fan`` maps of stretches, or a map for each ``stretch * fan`` items.
    """
    stretch = max(stretch, most_items)
    own = numbered(rows.select(by, order, F.coalesce(F.col(size).cast("long"), _long(0)).alias(size)), by=by, order=order, into="place")
    part = F.floor(F.col("place") / stretch)
    ahead = (F.col("place") % stretch < most_items - 1) & (part > 0)  # is looked at from the stretch before, too
    seen = own.select(by, F.struct("place", F.col(order).alias("order"), F.col(size).alias("size")).alias("item"), F.explode(F.when(ahead, F.array(part, part - 1)).otherwise(F.array(part))).alias("part"))
    lists = seen.groupBy(by, "part").agg(F.array_sort(F.collect_list("item")).alias("items"))
    held = F.size(F.filter("items", lambda x: F.floor(x["place"] / stretch) == F.col("part")))
    runs = F.transform(F.sequence(F.lit(0), F.col("held") - 1), lambda i: F.struct(i.cast("long").alias("i"), _taken(F.col("items"), i, most_items, most_chars).alias("n")))
    lists = lists.withColumn("held", held).withColumn("runs", runs)

    starts = F.array(*(F.struct(_long(e).alias("to"), _long(0).alias("made")) for e in range(most_items)))
    walked = F.aggregate("runs", starts, lambda at, r: F.transform(at, lambda e: F.when(e["to"] == r["i"], F.struct((e["to"] + r["n"]).alias("to"), (e["made"] + 1).alias("made"))).otherwise(e)))
    handed = F.transform(walked, lambda e: F.struct((e["to"] - F.col("held")).alias("to"), e["made"].alias("made")))
    maps = lists.select(by, "part", F.floor(F.col("part") / fan).alias("upper"), F.struct(F.col("part").alias("at"), handed.alias("map")).alias("m"))
    uppers = maps.groupBy(by, "upper").agg(F.array_sort(F.collect_list("m")).alias("maps"))
    whole = F.aggregate("maps", starts, lambda s, m: _composed(s, m["map"]))
    tops = uppers.select(by, F.struct(F.col("upper").alias("at"), whole.alias("map")).alias("m")).groupBy(by).agg(F.array_sort(F.collect_list("m")).alias("maps"))
    entered = tops.select(by, F.explode(_entries(F.col("maps"), _long(0), _long(0))).alias("e")).select(by, F.col("e.at").alias("upper"), F.col("e.entry").alias("entry"), F.col("e.made").alias("made"))
    inner = same(uppers, entered, [by, "upper"]).select(by, F.explode(_entries(F.col("maps"), F.col("entry"), F.col("made"))).alias("e"))
    cuts = inner.select(by, F.col("e.at").alias("part"), F.col("e.entry").alias("entry"), F.col("e.made").alias("made"))

    begin = F.struct(F.col("entry").alias("next"), (F.col("made") - 1).alias("batch"), F.array().cast("array<long>").alias("out"))

    def cut(s: Column, r: Column) -> Column:
        new = r["i"] == s["next"]
        batch = s["batch"] + F.when(new, _long(1)).otherwise(_long(0))
        return F.struct(F.when(new, s["next"] + r["n"]).otherwise(s["next"]).alias("next"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    numbers = F.aggregate("runs", begin, cut, lambda s: s["out"])
    dealt = same(lists, cuts, [by, "part"]).select(by, F.explode(F.arrays_zip(F.slice("items", F.lit(1), F.col("held")).alias("item"), numbers.alias("batch"))).alias("z"))
    return dealt.select(by, F.col("z.item.order").alias(order), F.col("z.item.size").alias(size), F.col("z.item.place").alias("place"), F.col("z.batch").alias("batch"))


def batch_ids(batches: DataFrame, *, by: str, order: str, digest) -> DataFrame:
    """(by, batch, items, chars, batch_id) of packed rows; the id is the start of a digest of the batch's own ids, so it names the content whatever came before."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.cast("string")), ",")
    return batches.groupBy(by, "batch").agg(F.count("*").alias("items"), F.sum("size").alias("chars"), F.substring(digest(ids), 1, 16).alias("batch_id"))
