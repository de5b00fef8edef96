"""Items: validation, ids, quality gates, dossiers; slices of exact offsets, spans and grounded quotes."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import text as T

ID = "^[A-Za-z0-9_.-]+$"


def violations(item_id: Column, text: Column) -> Column:
    """What is wrong with an item by itself; empty for a good one."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(item_id.rlike(ID), F.lit(False)), F.lit("id")), F.when(F.length(item_id) > 128, F.lit("id_length")),
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("blank")), F.when(T.garbage(text), F.lit("garbage")),
    ))


def by_ids(items: DataFrame, ids: DataFrame, *, fuzzy: bool = False) -> DataFrame:
    """Items whose id is listed; fuzzy takes underscores for blanks."""
    if not fuzzy:
        return items.join(ids.select("item_id").distinct(), "item_id", "left_semi")
    flat = lambda df: F.translate(df["item_id"], "_", " ")
    listed = ids.select(flat(ids).alias("__flat")).distinct()
    return items.join(listed, flat(items) == listed["__flat"], "left_semi")


def distinct_ids(items: DataFrame, *, order: str) -> DataFrame:
    """Ids that repeat get a digest of their source; the first of each keeps its name. A minimum, so no task gathers an id's rows."""
    first = items.groupBy("item_id").agg(F.min(order).alias("__first"))
    renamed = F.concat("item_id", F.lit("_"), F.substring(T.digest(F.col(order).cast("string")), 1, 8))
    return items.join(first, "item_id").withColumn("item_id", F.when(F.col(order) == F.col("__first"), F.col("item_id")).otherwise(renamed)).drop("__first")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the columns of the left, then the others of the right."""
    other = right.select(*(F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns))
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return left.join(other, on).drop(*(f"__{k}" for k in keys))


#: Marks of stretches: so many lists of so many.
_MARKS = 32


def stretches(rows: DataFrame, order: str, span: int) -> Column:
    """The stretch of each row in an order of numbers, all of about as many rows and of ``span`` or more: there are at most 1,024.

    Cut at quantiles of the whole table, so that it doesn't matter how the numbers are spread. One row comes to the driver.
    """
    many = _MARKS * _MARKS
    shares = [(i + 1) / many for i in range(many - 1)]
    told = rows.agg(F.count(order).alias("n"), F.percentile_approx(order, shares, 10 * many).alias("marks")).first()
    marks = sorted(set(told["marks"] or []))
    marks = marks[:: max(1, round(len(marks) / (told["n"] // span)))] if told["n"] > span else []
    if not marks:
        return F.lit(0)
    kind, at = rows.schema[order].dataType, F.col(order)
    fine = [marks[i : i + _MARKS] for i in range(0, len(marks), _MARKS)]
    value = lambda m: F.lit(m).cast(kind)
    coarse = F.size(F.filter(F.array(*(value(f[0]) for f in fine)), lambda m: m <= at))
    inner = F.size(F.filter(F.get(F.array(*(F.array(*map(value, f)) for f in fine)), coarse - 1), lambda m: m <= at))
    return F.when(at.isNull(), -1).when(coarse == 0, 0).otherwise((coarse - 1) * _MARKS + inner)


def numbered(rows: DataFrame, *, by: str, order: str, into: str = "place", span: int = 100_000) -> DataFrame:
    """Rows of each ``by`` numbered from 0 in the order of a number, nulls first. In two steps over stretches of the order, so that a frequent ``by`` is spread."""
    inside = F.row_number().over(Window.partitionBy(by, "__part").orderBy(order)) - 1
    own = rows.withColumn("__part", stretches(rows, order, span))
    sizes = own.groupBy(by, "__part").agg(F.count("*").alias("n"))
    before = sizes.select(by, "__part", (F.sum("n").over(Window.partitionBy(by).orderBy("__part")) - F.col("n")).alias("__base"))
    placed = same(own.withColumn("__at", inside), before, [by, "__part"])
    return placed.withColumn(into, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def seeded_sample(rows: DataFrame, *, order: str, size: int, seed: int, span: int = 100_000) -> DataFrame:
    """``size`` rows (all, if there are fewer) with ``turn``, their place in the sample: those that Python's generator of this seed draws from the rows in the order of a number.

    Places are drawn on the driver, and the rows at these places selected by counting rows in stretches: nothing is sorted as a whole.
    Equal numbers go by the row's other columns; rows without a number are never drawn.
    """
    own = rows.where(F.col(order).isNotNull())
    part = stretches(own, order, span)
    counts = {r["p"]: r["n"] for r in own.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # at most 1,024 rows
    drawn = random.Random(seed).sample(range(sum(counts.values())), min(size, sum(counts.values())))
    base, wanted = 0, []
    for p in sorted(counts):
        wanted += [(p, place - base + 1, turn) for turn, place in enumerate(drawn) if base <= place < base + counts[p]]
        base += counts[p]
    chosen = rows.sparkSession.createDataFrame(wanted, "__part int, __at int, turn int")
    others = [F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))]
    placed = own.withColumn("__part", part).join(F.broadcast(chosen.select("__part").distinct()), "__part", "left_semi")  # only stretches from which something is drawn
    placed = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(order, *others)))
    return placed.join(F.broadcast(chosen), ["__part", "__at"]).drop("__part", "__at")


def bundle(records: DataFrame, *, least_sources: int = 1) -> DataFrame:
    """records (entity, ord, category, uri, text) -> dossiers: text of all sections in order, first uri, counts; at least ``least_sources`` sections."""
    section = F.concat(F.lit("=== SECTION: "), "category", F.lit(" (URI: "), "uri", F.lit(") ===\n"), "text")
    lines = F.array_sort(F.collect_list(F.struct("ord", section.alias("line"), "uri")))
    own = records.groupBy("entity").agg(lines.alias("s"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("source_count"))
    return own.where(F.col("source_count") >= least_sources).select("entity", F.array_join(F.transform("s", lambda x: x.line), "\n").alias("text"), F.get("s", F.lit(0))["uri"].alias("source_uri"), "categories", "source_count")


# --- slices -----------------------------------------------------------------------------------------
_BREAKS = tuple(re.compile(p, re.M) for p in vocab.SLICE_BREAKS)


def slice_spans(text: str, budget: int) -> list[tuple[int, int]]:
    """[start, end) pieces that partition the text, none over the budget: packed greedily at section marks, else headings, blank lines, sentences, fixed windows."""

    def pack(start: int, end: int, level: int) -> list[tuple[int, int]]:
        if end - start <= budget:
            return [(start, end)] if end > start else []
        if level == len(_BREAKS):
            return [(i, min(end, i + budget)) for i in range(start, end, budget)]
        cuts = [m.start() if level < 2 else m.end() for m in _BREAKS[level].finditer(text, start, end)]
        edges = [start, *sorted({c for c in cuts if start < c < end}), end]
        if len(edges) == 2:
            return pack(start, end, level + 1)
        out: list[tuple[int, int]] = []
        at = start
        for a, b in zip(edges, edges[1:], strict=False):
            if b - at > budget and a > at:
                out += pack(at, a, level + 1)
                at = a
        return out + pack(at, end, level + 1)

    return pack(0, len(text), 0) if budget else [(0, len(text))] if text else []


def slices(items: DataFrame, *, item_id: str, text: str, budget: int = vocab.SLICE_CHARS) -> DataFrame:
    """(item_id, slice_id, start, end, partial); the slices of an item partition its text."""

    # By the hundred rows, not in batches of Arrow: those hold 10,000 texts, however long.
    cut = F.udf(lambda t: slice_spans(t or "", budget), "array<struct<start: int, end: int>>", useArrow=False)
    own = items.select(F.col(item_id).alias("item_id"), F.posexplode(cut(F.col(text))).alias("n", "s"), F.length(text).alias("size"))
    return own.select("item_id", F.concat(F.lit("s"), F.col("n") + 1).alias("slice_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), (F.col("s.end") - F.col("s.start") < F.col("size")).alias("partial"))


def windows(text: Column, budget: int) -> Column:
    """Starts of fixed windows."""
    return F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(budget))).otherwise(F.array().cast("array<int>"))


def sentences(text: Column) -> Column:
    """Sentences of a text: what ends in ., ! or ? before white space, or with its line; trimmed; blank ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(vocab.SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def statements(text: Column) -> Column:
    """Sentences as a comparison of captures takes them: parted after ., ! and ? before white space, and by blank lines."""
    return F.filter(F.transform(F.split(text, vocab.STATEMENT_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def located(items: DataFrame, pattern: str, *, keys: list[str], text: str) -> DataFrame:
    """Matches of a pattern in a text, trimmed of white space: keys, n, start, end, found. Places come from the lengths before each match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(F.slice(F.split(text, pattern), 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m")))
    each = items.select(*keys, F.posexplode(pieces).alias("n", "p"))
    upto = F.sum(F.col("p.gap") + F.length("p.m")).over(Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    lead = F.length("p.m") - F.length(F.regexp_replace("p.m", r"^\s+", ""))
    own = each.select(*keys, "n", (upto - F.length("p.m") + lead).cast("int").alias("start"), F.regexp_replace("p.m", r"^\s+|\s+$", "").alias("found"))
    return own.select(*keys, "n", "start", (F.col("start") + F.length("found")).alias("end"), "found").where("found <> ''")


def spans(items: DataFrame, terms: tuple[str, ...], *, item_id: str, text: str, most: int) -> DataFrame:
    """(item_id, candidate_id, start, end, hits, sentence): the ``most`` sentences of 15 to 300 characters that hit most distinct terms, earlier ones first, numbered in their order in the text."""
    wanted = tuple(dict.fromkeys(t.strip().lower() for t in terms if t.strip()))
    each = located(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("__text")), vocab.SENTENCE, keys=["item_id"], text="__text")
    each = each.where(F.length("found").between(*vocab.SPAN_CHARS)).withColumn("hits", sum((F.contains(F.lower("found"), F.lit(t)).cast("int") for t in wanted), F.lit(0))).where("hits > 0")
    ranked = each.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "start"))).where(F.col("place") <= most)
    number = F.row_number().over(Window.partitionBy("item_id").orderBy("start")) - 1
    return ranked.select("item_id", number.alias("candidate_id"), "start", "end", "hits", F.col("found").alias("sentence"))
