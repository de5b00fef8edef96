"""Delivery of scored records: boolean claim filters, typed sorts, top-k and ranks, facets."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.items import numbered

OPS = ("==", "!=", ">=", "<=", ">", "<", "in", "not_in")
Scalar = str | float | int | bool | None


@dataclass(frozen=True)
class Clause:
    name: str
    op: str
    value: Scalar | tuple[Scalar, ...]

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}")
        if (self.op in ("in", "not_in")) != isinstance(self.value, tuple) or self.value == ():
            raise ValueError("in and not_in take a list that isn't empty; other operators take one value")


@dataclass(frozen=True)
class Filter:
    """All clauses hold, and, if there are nested filters, at least one of those."""

    all: tuple[Clause, ...] = ()
    any: tuple[Filter, ...] = field(default=())


def _equal(claim: Column, value: Scalar) -> Column:
    """claim is JSON text: booleans never equal numbers; strings compare without case; null equals null alone."""
    if value is None:
        return claim == "null"
    if isinstance(value, bool):
        return claim == str(value).lower()
    if isinstance(value, str):
        return F.lower(F.get_json_object(F.concat(F.lit('{"v":'), claim, F.lit("}")), "$.v")) == value.lower()
    return F.coalesce(claim.try_cast("double") == float(value), F.lit(False))


def _number(claim: Column) -> Column:
    """The claim as a number: booleans count as 1 and 0, numerals in strings as what they say."""
    return F.when(claim == "true", 1.0).when(claim == "false", 0.0).otherwise(F.trim(claim, F.lit('"')).try_cast("double"))


def _clause(claims: Column, c: Clause) -> Column:
    claim = F.try_element_at(claims, F.lit(c.name))
    if c.op in ("==", "in"):
        hit = [_equal(claim, v) for v in (c.value if c.op == "in" else (c.value,))]
        out = hit[0]
        for h in hit[1:]:
            out = out | h
        return F.coalesce(out, F.lit(False))
    if c.op in ("!=", "not_in"):
        return ~_clause(claims, Clause(c.name, "==" if c.op == "!=" else "in", c.value))
    n, v = _number(claim), float(c.value)
    return F.coalesce({">=": n >= v, "<=": n <= v, ">": n > v, "<": n < v}[c.op], F.lit(False))


def holds(f: Filter, claims: Column) -> Column:
    """A filter as a column over claims, a map of names to JSON values. A missing claim satisfies only != and not_in."""
    out = F.lit(True)
    for c in f.all:
        out = out & _clause(claims, c)
    if f.any:
        some = F.lit(False)
        for nested in f.any:
            some = some | holds(nested, claims)
        out = out & some
    return out


def sort_keys(claim: Column, *, descending: bool = False) -> list[Column]:
    """Typed order: ascending nulls, numbers, strings; descending strings excluded from numbers, numbers first, nulls last."""
    number = _number(claim)
    rank = F.when(claim.isNull() | (claim == "null"), 0).when(number.isNotNull(), 2 if descending else 1).otherwise(1 if descending else 2)
    word = F.when(number.isNull() & (claim != "null"), claim)
    if descending:
        return [rank.desc(), number.desc_nulls_last(), word.desc_nulls_last()]
    return [rank.asc(), number.asc_nulls_first(), word.asc_nulls_first()]


def top(records: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """The first k records in a total order, with their rank: limit first, so that only k rows are ranked in one task."""
    if k < 0:
        raise ValueError("top must not be negative")
    return records.orderBy(*keys).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def bias_adjusted(score: Column, bias: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score - F.coalesce(bias, F.lit(0.0))))


def typed(claim: Column, *, descending: bool = False) -> Column:
    """A claim (JSON text) as a value whose natural order is the typed one: nulls, then numbers, then strings; descending, strings come before numbers."""
    text = claim.isNotNull() & F.startswith(claim, F.lit('"')) & _number(claim).isNull()
    number = F.when(~F.coalesce(text, F.lit(False)), _number(claim))
    kind = F.when(number.isNotNull(), 2 if descending else 1).when(text, 1 if descending else 2).otherwise(0)
    return F.struct(kind.alias("kind"), number.alias("number"), F.when(text, F.trim(claim, F.lit('"'))).alias("text"))


def ranked(rows: DataFrame, value: Column, tie: str, *, descending: bool = False, stretches: int = 64) -> DataFrame:
    """All rows with their rank from 1 in the order of ``value`` (a struct), equal ones in the order of the whole number ``tie``.

    No task sorts everything: distinct values are counted, the counts summed over stretches of values between fixed marks, and the
    rows of a value numbered in stretches of ``tie``. The marks come from a bounded sample and only balance the tasks.
    """
    own = rows.withColumn("__v", value)
    counts = own.groupBy("__v").agg(F.count("*").alias("n"))
    some = sorted((tuple(r["__v"]) for r in counts.orderBy(F.xxhash64("__v")).limit(32 * stretches).select("__v").collect()), key=lambda v: [(x is not None, x if x is not None else 0) for x in v])
    kinds = [f.dataType.simpleString() for f in own.schema["__v"].dataType.fields]
    mark = lambda v: F.struct(*[F.lit(x).cast(k).alias(n) for x, k, n in zip(v, kinds, own.schema["__v"].dataType.fieldNames(), strict=True)])
    marks = [mark(v) for v in some[:: max(1, len(some) // stretches)]]
    stretch = reduce(lambda a, b: a + b, [(F.col("__v") >= m).cast("int") for m in marks], F.lit(0))
    order = (F.desc if descending else F.asc)
    placed = counts.withColumn("__s", stretch)
    inside = F.sum("n").over(Window.partitionBy("__s").orderBy(order("__v")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    sums = placed.groupBy("__s").agg(F.sum("n").alias("m"))  # a row for each stretch
    before = sums.select("__s", (F.sum("m").over(Window.orderBy(order("__s"))) - F.col("m")).alias("__base"))
    first = placed.withColumn("__at", inside).join(F.broadcast(before), "__s").select("__v", (F.col("__base") + F.col("__at")).alias("__first"))
    return numbered(own, by="__v", order=tie, into="__n").join(first, "__v").withColumn("rank", (F.col("__first") + F.col("__n") + 1).cast("int")).drop("__v", "__n", "__first")
