"""Sharding by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups that alone hold a noticeable share of all bytes are packed on the driver; there can be only so many. All others are packed
by tasks: each has a hash partition of the groups, in descending order, and bins of that part of each shard's room which falls to
it. So every group enters the tightest bin of its partition, and no task, nor the driver, sees all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import materialise


class Bins:
    """Open bins in a balanced tree, a treap ordered by (remaining capacity, number).

    Priorities come from the key, so the tree's shape depends on its content alone. A node is [key, priority, left, right].
    """

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _split(node, key):
        if node is None:
            return None, None
        if node[0] < key:
            a, b = Bins._split(node[3], key)
            node[3] = a
            return node, b
        a, b = Bins._split(node[2], key)
        node[2] = b
        return a, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Bins._merge(a[3], b)
            return a
        b[2] = Bins._merge(a, b[2])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, hash(key), None, None]), b)

    def roomiest(self) -> tuple[int, int]:
        """Remove and return the bin with the most remaining capacity, which may be negative; the highest number of equals."""
        node = self.root
        while node[3] is not None:
            node = node[3]
        self.root, _ = self._split(self.root, node[0])
        return node[0]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``, the lowest number first."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            a, b = self._split(self.root, best)
            _, c = self._split(b, (best[0], best[1] + 1))
            self.root = self._merge(a, c)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The bin of each size and the number of bins. A size beyond the capacity has a bin to itself."""
    bins, placed, count = Bins(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = bins.take(sizes[i]) if sizes[i] <= capacity else None
        if found is None:
            found, count = (capacity, count), count + 1
        placed[i] = found[1]
        if found[0] > sizes[i]:
            bins.add(found[0] - sizes[i], found[1])
    return placed, count


def tightest(sizes: list[int], shards: int) -> list[int]:
    """Bins of the smallest capacity found by bisection that needs at most ``shards`` of them."""
    low, high = max([-(-sum(sizes) // shards), *sizes]), sum(sizes)
    best, count = best_fit_decreasing(sizes, low)
    if count <= shards:
        return best
    best, _ = best_fit_decreasing(sizes, high)
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        placed, count = best_fit_decreasing(sizes, middle)
        if count <= shards:
            best, high = placed, middle
        else:
            low = middle
    return best


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _packed(rooms: dict[int, list[int]] | None, capacity: int | None):
    """mapInArrow over (part, size, h) in the order of (part, size descending): (part, h, bin), and each part's bins as (part, null, bin, load).

    With ``rooms`` a part has one bin for each shard, and what fits in none enters the roomiest. With ``capacity`` bins are opened as needed.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, loads = None, Bins(), []
        for batch in batches:
            part, size, h = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for p, s in zip(part, size, strict=True):
                if p != now:
                    if now is not None and capacity:
                        yield _loads(now, loads)
                    now, bins, loads = p, Bins(), []
                    for b, room in enumerate(rooms[p] if rooms else []):
                        bins.add(room, b)
                        loads.append(0)
                found = bins.take(s)
                if found is None and rooms:
                    found = bins.roomiest()
                elif found is None:
                    found = (max(capacity, s), len(loads))
                    loads.append(0)
                out.append(found[1])
                loads[found[1]] += s
                if rooms or found[0] > s:
                    bins.add(found[0] - s, found[1])
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(h, pa.int64()), pa.array(out, pa.int32()), pa.nulls(len(h), pa.int64())], names=["part", "h", "bin", "load"])
        if now is not None and capacity:
            yield _loads(now, loads)

    return pack


def _loads(part: int, loads: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part] * len(loads), pa.int32()), pa.nulls(len(loads), pa.int64()), pa.array(range(len(loads)), pa.int32()), pa.array(loads, pa.int64())], names=["part", "h", "bin", "load"])


def place(groups: DataFrame, *, shards: int = 8, capacity: int | None = None, heavy: int = 8192, groups_in_task: int = 1 << 16, most_parts: int = 4096) -> DataFrame:
    """(h, shard) of each of the groups (h long, size long).

    For ``shards`` of near equal bytes, groups of more than 1/``heavy`` of all bytes, so fewer than ``heavy``, are packed first. The
    rest is packed in hash partitions, whose bins share what room is left; the shards' sizes differ by what did not fit in the
    partitions, sizes of the smallest groups there. With ``capacity`` shards are as many as needed: of a partition's bins at most
    one is not more than half full, and these are packed once more, so the shards exceed those of one packing by about a bin for
    each partition's waste. A group larger than ``capacity`` has a shard to itself. An empty table gives none.
    """
    spark = groups.sparkSession
    groups = materialise(groups, "groups")
    count, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = min(most_parts, count // groups_in_task + 1)
    large = [] if capacity else [(r.h, r["size"]) for r in groups.where(F.col("size") > -(-total // heavy)).orderBy(F.desc("size"), "h").collect()]
    bins = tightest([s for _, s in large], shards) if large else []
    if large and max(bins) >= shards:
        raise ValueError(f"{max(bins) + 1} bins for {shards} shards")
    light = groups if capacity else groups.where(F.col("size") <= -(-total // heavy))
    light = light.withColumn("part", F.pmod("h", F.lit(parts)).cast("int"))
    rooms = None
    if not capacity:
        taken = np.bincount(bins, [s for _, s in large], shards)[:shards] if large else np.zeros(shards)
        free = np.maximum(np.maximum(-(-total // shards), taken.max()) - taken, 0.0)
        share = free / (free.sum() or 1)
        rooms = {r.part: [-int(-x // 1) for x in r["size"] * share] for r in light.groupBy("part").agg(F.sum("size").alias("size")).collect()}  # at most most_parts rows
    sorted_ = light.select("part", "size", "h").repartition(parts, "part").sortWithinPartitions("part", F.desc("size"), "h")
    packed = materialise(sorted_.mapInArrow(_packed(rooms, capacity), "part int, h long, bin int, load long"), "packed")
    inside = packed.where("h is not null")
    if not capacity:
        return spark.createDataFrame([(h, b) for (h, _), b in zip(large, bins, strict=True)], "h long, shard int").unionByName(inside.select("h", F.col("bin").alias("shard")))
    bounds = packed.where("h is null").groupBy("part").agg(F.max("bin").alias("last"), F.min_by("bin", F.struct("load", "bin")).alias("bin"), F.min("load").alias("load")).orderBy("part").collect()
    half = [r for r in bounds if 2 * r.load <= capacity]  # at most one a part
    merged, number = best_fit_decreasing([r.load for r in half], capacity)
    base = np.cumsum([0, *[r.last + 1 for r in bounds]])
    to = {(r.part, r.bin): int(base[-1]) + b for r, b in zip(half, merged, strict=True)}
    # Numbers without holes: a part's bins but those moved, then the merged ones.
    rows, at = [], 0
    for r in bounds:
        moved = r.bin if (r.part, r.bin) in to else None
        rows.append((r.part, at, moved, to.get((r.part, r.bin), 0) - int(base[-1])))
        at += r.last + 1 - (moved is not None)
    layout = spark.createDataFrame(rows, "part int, first int, moved int, to int")
    joined = inside.join(F.broadcast(layout), "part")
    own = F.col("first") + F.col("bin") - F.when(F.col("bin") > F.col("moved"), 1).otherwise(0)
    return joined.select("h", F.when(F.col("bin") == F.col("moved"), F.lit(at) + F.col("to")).otherwise(own).cast("int").alias("shard"))


def text_hash(text: Column) -> Column:
    """The group of a text: equal texts share it, and a null text that of the empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dealt(rows: DataFrame, placed: DataFrame, *, shards: int = 8, rows_in_task: int = 20_000) -> DataFrame:
    """``rows`` (doc_id, h, ...) with shard and slot. Slots count from 0 in the order of a hash bucket and of the doc_id (null first)."""
    subs = max(1, rows.count() // (shards * rows_in_task) + 1)
    own = rows.join(materialise(placed, "placed"), "h").withColumn("sub", F.pmod(F.xxhash64("doc_id", "h"), F.lit(subs)))
    counts = own.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    before = counts.select("shard", "sub", (F.sum("n").over(Window.partitionBy("shard").orderBy("sub")) - F.col("n")).alias("base"))
    at = F.row_number().over(Window.partitionBy("shard", "sub").orderBy(F.col("doc_id").asc_nulls_first(), "h"))
    return own.withColumn("at", at).join(before, ["shard", "sub"]).withColumn("slot", (F.col("base") + F.col("at") - 1).cast("long")).drop("sub", "at", "base")


def digest(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 8, capacity: int | None = None, rows_in_task: int = 20_000, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Rows of equal text are a group and stay together; a null text is a group with the empty text. Sizes are UTF-8 bytes plus
    1. Repeated rows get slots of their own; among rows of one doc_id and text the order of slots is arbitrary.
    """
    own = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), text_hash(F.col(text)).alias("h"),
    )
    own = materialise(own, "sizes")
    placed = place(own.groupBy("h").agg(F.sum("size").alias("size")), shards=shards, capacity=capacity, **options)
    return dealt(own, placed, shards=shards, rows_in_task=rows_in_task).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 8, capacity: int | None = None, rows_in_task: int = 4096, **options) -> DataFrame:
    """``docs`` with two more columns: shard, and slot in the shard, as in ``digest``. Columns of those names are replaced; all others stay."""
    sizes = materialise(docs.select(text_hash(F.col(text)).alias("h"), text_size(F.col(text)).alias("size")).groupBy("h").agg(F.sum("size").alias("size")), "sizes")
    placed = place(sizes, shards=shards, capacity=capacity, **options)
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(F.col(text)).alias("h"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    return dealt(rows, placed, shards=shards, rows_in_task=rows_in_task).select("row.*", "shard", "slot")
