"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint falls into segments; two fingerprints at most ``distance`` bits apart differ in some segment by at most
``distance // segments`` bits. So each distinct fingerprint is filed under its own value of every segment, visits the small
Hamming ball round that value, and complete distances are verified inside a table entry. An entry gives a spanning forest of
its links, never all pairs, so groups of near copies stay linear; components are then contracted by large-star / small-star.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import NULL_ID, doc_key, fresh, materialise, width

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash over shingles of ``words`` words of the text with A-Z lower-cased. No words: 0."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    line = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, *, text: str = "text", into: str = "fingerprint", words: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` and a long column ``into``: the fingerprint's bits as a signed number."""

    @F.pandas_udf("long")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn(into, own(F.col(text)))


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    edges = [round(BITS * i / count) for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def segments_for(count: int, distance: int) -> int:
    """How many segments cost least for ``count`` fingerprints: rows filed, and comparisons inside entries (some thousand a row's cost).

    Only balls of radius 1 or more are considered; more fingerprints want wider segments.
    """

    def cost(segments: int) -> float:
        width = BITS // segments
        rows = count * segments * sum(math.comb(width, r) for r in range(distance // segments + 1))
        return rows + rows / 2**width * count / 1000

    return min(range(2, max(2, distance) + 1), key=cost)


def _forest(own: np.ndarray, visits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links owner-owner of one table entry, grown from its owners, and one link of a visitor to each tree that it touches.

    Each fingerprint is compared only with those not yet reached, so a dense entry costs little more than one pass.
    """
    left, right = [], []
    free = own
    while len(free):
        todo, free, away = [free[0]], free[1:], visits
        while todo:
            at = todo.pop()
            if len(free):
                near = np.bitwise_count(free ^ at) <= distance
                if near.any():
                    hit = free[near]
                    left.append(np.full(len(hit), at)), right.append(hit)
                    todo.extend(hit)
                    free = free[~near]
            if len(away):
                near = np.bitwise_count(away ^ at) <= distance
                if near.any():
                    left.append(np.full(near.sum(), at)), right.append(away[near])
                    away = away[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _entries(distance: int, held_rows: int = 1 << 18):
    """mapInArrow over rows (key, fp, own), an entry's rows together and its owners first: the links of each entry.

    Of an entry of very many rows the owners stay in memory and the visitors pass by in blocks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])], axis=1)
            new = np.flatnonzero(np.diff(rows[0])) + 1
            last = new[-1] if len(new) else 0
            held = rows[:, last:]
            if last:
                yield from found(rows[:, :last])
            if held.shape[1] > held_rows and not held[2, -1]:
                yield from found(held)
                held = held[:, held[2] > 0]
        if held.shape[1]:
            yield from found(held)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.concatenate(([0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]))
        owners = np.add.reduceat(rows[2], edges[:-1])
        left, right = [], []
        for k in np.flatnonzero((owners > 0) & (np.diff(edges) > 1)):
            part = rows[1:, edges[k] : edges[k + 1]]
            fps, mine = part[0].astype(np.uint64), part[1] > 0
            a, b = _forest(fps[mine], fps[~mine], distance)
            if len(a):
                left.append(a), right.append(b)
        if left:
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return links


def _visit(number: int, value: Column):
    return lambda flip: F.struct(F.lit(number).alias("seg"), value.bitwiseXOR(flip).alias("value"), (flip == 0).cast("int").alias("own"))


def links(fingerprints: DataFrame, *, fp: str = "fp", distance: int = 4, segments: int | None = None, owners_in_task: int = 4096) -> DataFrame:
    """Distinct links (a < b) whose components are those of all pairs of ``fingerprints`` at most ``distance`` bits apart.

    ``fingerprints`` has distinct, non-null longs. Null in, nothing out; an empty table gives no links. Without ``segments`` their
    number follows from the number of fingerprints. An entry of more than ``owners_in_task`` fingerprints is dealt in parts: each
    holds some of them as owners, and is visited by all the others.
    """
    own = fingerprints.where(F.col(fp).isNotNull()).select(F.col(fp).alias("fp"))
    segments = segments or segments_for(own.count(), distance)
    radius = distance // segments
    probes, homes = [], []
    for number, (shift, bits) in enumerate(_segments(segments)):
        mask = (1 << bits) - 1
        value = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND(F.lit(mask).cast("long"))
        flips = [sum(1 << i for i in chosen) for size in range(radius + 1) for chosen in combinations(range(bits), size)]
        probes.append(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), _visit(number, value)))
        homes.append(F.struct(F.lit(number).alias("seg"), value.alias("value")))
    filed = own.withColumn("p", F.explode(F.concat(*probes))).select("p.seg", "p.value", "fp", "p.own")
    crowd = own.withColumn("p", F.explode(F.array(*homes))).groupBy("p.seg", "p.value").agg(F.count("*").alias("n")).where(F.col("n") > owners_in_task)
    crowd = materialise(crowd.select("seg", "value", F.ceil(F.col("n") / owners_in_task).cast("int").alias("parts")), "crowded-entries")
    if crowd.isEmpty():
        filed = filed.withColumn("part", F.lit(0))
    else:
        spread = filed.join(crowd, ["seg", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        filed = spread.withColumn("own", F.when(F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part"), F.col("own")).otherwise(0))
    spark = fingerprints.sparkSession
    key = (F.col("part").cast("long") * 8 + F.col("seg")) * F.lit(1 << 32) + F.col("value")  # a segment, of two to eight, has at most 32 bits
    dealt = filed.select(key.alias("key"), "fp", "own").repartition(width(spark), "key").sortWithinPartitions("key", F.desc("own"))
    return dealt.mapInArrow(_entries(distance), "a long, b long").distinct()


def components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star; each round is written to the shared folder. The nodes' neighbourhoods are only
    aggregated (minimum), never gathered.
    """
    mark = [F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))]
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = now.agg(*mark).first()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "b", "m")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = materialise(small, "small-star")
        if (after := now.agg(*mark).first()) == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _named(own: DataFrame, distance: int, segments: int | None) -> DataFrame:
    """(fp, root, component_id) of the fingerprints of own (doc_id, fp)."""
    distinct = own.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("first"))
    distinct = materialise(distinct, "distinct-fingerprints")
    roots = components(links(distinct, distance=distance, segments=segments))
    rooted = materialise(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    return materialise(rooted.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, distance: int = 4, segments: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; component_id is the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows share a fingerprint, so a
    component. A null doc_id counts as the smallest id and gives component_id null.
    """
    own = with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), into="fp", words=words, seed=seed)
    own = materialise(own.select("doc_id", "fp"), "fingerprints")
    return own.join(_named(own, distance, segments), "fp").select("doc_id", "fp", F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, the fingerprint in 16 hex digits, and the component."""
    return classes(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, distance: int = 4, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null first) and, among its rows, of the least text hash.

    All columns stay. Rows of one id with unrelated texts are documents of their own. Of rows that repeat id and text one stays.
    Null and empty texts are near copies of each other. An empty table gives none.
    """
    id_, tkey, row = (fresh(docs, stem) for stem in ("id", "tkey", "row"))
    keys = dict(zip((id_, tkey), doc_key(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))), strict=True))
    own = with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *[c.alias(k) for k, c in keys.items()]), into="fp", words=words, seed=seed)
    own = materialise(own.select("doc_id", id_, tkey, "fp"), "fingerprints")
    chosen = own.join(_named(own, distance, segments), "fp").groupBy("root").agg(F.min(F.struct(id_, tkey)).alias("k")).select("k.*")
    out = docs.withColumns(keys).join(materialise(chosen, "kept"), [id_, tkey], "left_semi")
    order = Window.partitionBy(id_, tkey).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    return out.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(*keys, row)
