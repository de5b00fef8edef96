"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, kept in flat neighbour arrays.

Shards are cells about centres that are fitted to a bounded sample; a cell of many vectors is several shards. A query goes to the
shards of as many near cells as a sample says that its neighbours need, and the shards' results are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import materialise, width


class HNSW:
    """One graph over the rows of a matrix. Level 0 has 2m neighbours a node, the levels above m; a free place is -1."""

    def __init__(self, data: np.ndarray, *, m: int = 12, ef: int = 48, seed: int = 3):
        self.data, self.m, self.ef = data, m, ef
        n = len(data)
        self.norm = np.einsum("ij,ij->i", data, data)
        top = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / math.log(m)).astype(int), 12)
        self.level = top
        self.links = [np.full((n, 2 * m if level == 0 else m), -1, np.int32) for level in range(int(top.max(initial=0)) + 1)]
        self.entry = -1
        for i in range(n):
            self._insert(i)

    def _far(self, q: np.ndarray, qq: float, at: np.ndarray) -> np.ndarray:
        return self.norm[at] - 2.0 * (self.data[at] @ q) + qq

    def _search(self, q: np.ndarray, qq: float, start: list[tuple[float, int]], ef: int, level: int, seen: np.ndarray, stamp: int) -> list[tuple[float, int]]:
        """The ef nearest found on a level, as a heap of (-distance, node)."""
        links = self.links[level]
        todo = list(start)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        for _, i in start:
            seen[i] = stamp
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            far = self._far(q, qq, near)
            if len(best) >= ef:
                few = far < -best[0][0]
                near, far = near[few], far[few]
            for x, j in zip(far.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-x, j))
                    heapq.heappush(todo, (x, j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, j))
                    heapq.heappush(todo, (x, j))
        return best

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to those already chosen; the rest fill up."""
        order = sorted(found)
        ids = np.array([i for _, i in order])
        between = self.norm[ids][:, None] + self.norm[ids][None, :] - 2.0 * self.data[ids] @ self.data[ids].T
        chosen: list[int] = []
        for k, (d, _) in enumerate(order):
            if len(chosen) == most:
                break
            if not chosen or d < between[k, chosen].min():
                chosen.append(k)
        for k in range(len(order)):
            if len(chosen) >= most:
                break
            if k not in chosen:
                chosen.append(k)
        return [int(ids[k]) for k in chosen]

    def _insert(self, i: int) -> None:
        if self.entry < 0:
            self.entry, self._seen, self._stamp = i, np.zeros(len(self.data), np.int64), 0
            return
        q, qq = self.data[i], float(self.norm[i])
        now = [(float(self._far(q, qq, np.array([self.entry]))[0]), self.entry)]
        for level in range(self.level[self.entry], -1, -1):
            self._stamp += 1
            if level > self.level[i]:
                now = [min((-d, j) for d, j in self._search(q, qq, now, 1, level, self._seen, self._stamp))]
                continue
            now = [(-d, j) for d, j in self._search(q, qq, now, self.ef, level, self._seen, self._stamp)]
            links = self.links[level]
            near = self._diverse(now, self.m)
            links[i, : len(near)] = near
            for j in near:
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    them = np.append(row, i)
                    far = self._far(self.data[j], float(self.norm[j]), them)
                    kept = self._diverse(list(zip(far.tolist(), them.tolist(), strict=True)), len(row))
                    row[:] = -1
                    row[: len(kept)] = kept
        if self.level[i] > self.level[self.entry]:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        """About the k nearest rows to q, nearest first."""
        if self.entry < 0:
            return []
        qq = float(q @ q)
        now = [(float(self._far(q, qq, np.array([self.entry]))[0]), self.entry)]
        for level in range(self.level[self.entry], 0, -1):
            self._stamp += 1
            now = [min((-d, j) for d, j in self._search(q, qq, now, 1, level, self._seen, self._stamp))]
        self._stamp += 1
        found = self._search(q, qq, now, max(ef, k), 0, self._seen, self._stamp)
        return [j for _, j in sorted((-d, j) for d, j in found)[:k]]


def usable(v: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


@dataclass
class Cells:
    """Centres by dimension, the number of a dimension's first cell, and how many near cells a query of it visits.

    Cell 0 takes vectors of dimensions that the sample has not shown.
    """

    centres: dict[int, np.ndarray]
    first: dict[int, int]
    probes: dict[int, int]

    def near(self, vectors: list[np.ndarray], several: bool) -> list[np.ndarray]:
        """The nearest cell of each vector, or with ``several`` all that a query visits."""
        found = [np.zeros(1, np.int64)] * len(vectors)
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for size, rows in by.items():
            if size in self.centres:
                order = _ranked(np.array([vectors[i] for i in rows]), self.centres[size])[:, : self.probes[size] if several else 1]
                for i, cells in zip(rows, order + self.first[size], strict=True):
                    found[i] = cells
        return found


def _ranked(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centres of each row, nearest first."""
    return np.argsort((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1, kind="stable")


def centres(x: np.ndarray, count: int, *, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm; a centre that loses all rows moves to a random one."""
    rng = np.random.default_rng(seed)
    at = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmin((at**2).sum(axis=1) - 2 * x[i : i + 4096] @ at.T, axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        size = np.bincount(own, minlength=count)
        begin = np.cumsum(size) - size
        some = size > 0
        sums = np.add.reduceat(x[order], begin[some], axis=0)
        at = x[rng.choice(len(x), count)]
        at[some] = sums / size[some][:, None]
    return at


def probes(x: np.ndarray, at: np.ndarray, k: int, share: float, asked: int = 256) -> int:
    """How many near cells hold ``share`` of the k nearest rows of x, over ``asked`` of its rows. Rows of the whole table lie denser, so their neighbours need no more."""
    rows = np.arange(0, len(x), max(1, len(x) // asked))
    norm, cell = (x**2).sum(axis=1), _ranked(x, at)[:, 0]
    place = np.argsort(_ranked(x[rows], at), axis=1)  # of each centre in a row's order
    needed = []
    for r, p in zip(rows, place, strict=True):
        far = norm - 2 * x @ x[r]
        far[r] = np.inf
        needed.append(p[cell[np.argpartition(far, min(k, len(x) - 1) - 1)[:k]]])
    return int(np.quantile(np.concatenate(needed), share, method="higher")) + 1


def fit(members: DataFrame, count: int, *, k: int, share: float, max_sample: int, max_bytes: int) -> Cells:
    """Cells fitted to the vectors of the least hashes: 64 a cell, at most ``max_sample``, and at most ``max_bytes`` of the commonest dimensions."""
    sample = members.orderBy("h", "h2").select("v").limit(min(max_sample, 64 * count))
    by: dict[int, list[np.ndarray]] = {}
    size = 0
    for batch in sample.toArrow().to_batches():
        for v in _vectors(batch.column("v")):
            size += v.nbytes
            if size <= max_bytes:
                by.setdefault(len(v), []).append(v)
    rows = sum(map(len, by.values()))
    out, first = Cells({}, {}, {}), 1
    for dimension, vectors in sorted(by.items()):
        x = np.array(vectors)
        at = centres(x, max(1, min(len(x), round(count * len(x) / rows))))
        out.centres[dimension], out.first[dimension] = at, first
        out.probes[dimension] = probes(x, at, k, share) if len(x) > 1 else 1
        first += len(at)
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(column) else []


def nearest(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, m: int = 12, ef: int = 48, ef_search: int = 64,
    shard_rows: int = 2048, max_cells: int = 4096, max_sample: int = 1 << 17, max_bytes: int = 64 << 20, share: float = 0.99,
) -> DataFrame:
    """The k nearest rows to each query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id; the query's own id
    is no candidate. Vectors null, zero, or with null or non-finite components take no part, nor do rows with a null id; a query
    and a candidate of different dimension don't meet. Rows that repeat an id with another vector are candidates of their own;
    exactly repeated rows are one. Equal vectors are indexed once and stand for all their ids, of which a query can see only the
    k + 1 smallest, so a vector that very many rows share fills no shard.

    There are as many cells as shards of ``shard_rows`` vectors, at most ``max_cells``; a larger cell is split by a hash. A query
    visits the near cells that hold ``share`` of the neighbours in the sample, so work follows how the vectors cluster.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    own = own.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # Members in two steps, by a salt, so that no task gathers all ids of one vector.
    least = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    salted = own.groupBy("h", "h2", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(F.first("v").alias("v"), least.alias("ids"))
    members = salted.groupBy("h", "h2").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    members = materialise(members, "vectors")
    spark = vectors.sparkSession
    count = min(max_cells, members.count() // shard_rows + 1)
    cells = fit(members, count, k=k, share=share, max_sample=max_sample, max_bytes=max_bytes)

    def housed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells.near(_vectors(batch.column("v")), False)
            yield pa.record_batch([*batch.columns, pa.array([int(c[0]) for c in at], pa.int32())], names=[*batch.schema.names, "cell"])

    filed = materialise(members.select("h", "v", "ids").mapInArrow(housed, "h long, v array<double>, ids array<long>, cell int"), "cells")
    sizes = {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}  # at most a row for each centre
    parts = {c: -(-n // (2 * shard_rows)) for c, n in sizes.items()}
    bases, shards = {}, 0
    for c in sorted(parts):
        bases[c], shards = shards, shards + parts[c]
    layout = spark.createDataFrame([(c, bases[c], parts[c]) for c in parts], "cell int, base int, parts int")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(cells.near(_vectors(batch.column("v")), True)):
                to = [s for c in found.tolist() if c in bases for s in range(bases[c], bases[c] + parts[c])]
                row = batch.slice(i, 1).take(pa.array([0] * len(to), pa.int32()))
                yield pa.record_batch([pa.array(to, pa.int32()), pa.array([1] * len(to), pa.int32()), *row.columns], names=["shard", "kind", "v", "ids"])

    # Queries lie beside the vectors of each shard that they visit.
    queries = materialise(own.where(F.col("id") % every == 0).select("id", "v").distinct(), "queries")
    shape = "shard int, kind int, v array<double>, ids array<long>"
    asked = queries.select("v", F.array("id").alias("ids")).mapInArrow(visits, shape)
    indexed = filed.join(F.broadcast(layout), "cell").select((F.col("base") + F.pmod("h", F.col("parts"))).cast("int").alias("shard"), F.lit(0).alias("kind"), "v", "ids")
    tasks = int(max(width(spark), min(shards, 16 * width(spark))))
    dealt = indexed.unionByName(asked).repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard", "kind")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graphs, rows = None, [], []
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1, [len(shard)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    now, graphs, rows = shard[a], [], []
                piece = batch.slice(a, b - a)
                if kind[a] == 0:
                    rows.append(piece)
                    continue
                if rows:
                    graphs, rows = _graphs(pa.Table.from_batches(rows), m, ef), []
                yield _answers(piece, graphs, k, ef_search)

    found = dealt.mapInArrow(answers, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _graphs(table: pa.Table, m: int, ef: int) -> list[tuple[HNSW, np.ndarray, list[list[int]]]]:
    """A graph for each dimension of the shard's vectors; almost always one."""
    vectors, ids = table.column("v").to_pylist(), table.column("ids").to_pylist()
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    out = []
    for rows in by.values():
        data = np.array([vectors[i] for i in rows], np.float64)
        out.append((HNSW(data, m=m, ef=ef), data, [ids[i] for i in rows]))
    return out


def _answers(queries: pa.RecordBatch, graphs: list, k: int, ef: int) -> pa.RecordBatch:
    rows: list[tuple[int, int, float]] = []
    for query, v in zip(queries.column("ids").to_pylist(), queries.column("v").to_pylist(), strict=True):
        q = np.array(v, np.float64)
        for graph, data, ids in graphs:
            if data.shape[1] != len(q):
                continue
            at = graph.search(q, k + 1, ef)
            for i, d in zip(at, np.sqrt(np.cumsum((data[at] - q) ** 2, axis=1)[:, -1]).tolist(), strict=True):
                rows.extend((query[0], j, d) for j in ids[i] if j != query[0])
    frame = pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    return pa.RecordBatch.from_pandas(frame, preserve_index=False)


#: Exact search; up to some thousand vectors the graphs find the same rows.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(range(1, len(v.v) + 1), lambda i: (v.v[i] - q.v[i]) * (v.v[i] - q.v[i])))) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
