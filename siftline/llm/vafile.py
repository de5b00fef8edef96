"""Exact search by a vector-approximation file: small codes of cells are scanned for bounds, and few exact vectors are read.

Each dimension is cut into at most 256 cells, so a vector's approximation has a byte a dimension. For a query and a cell the inner
product lies between two bounds. Tasks scan the approximations against blocks of queries and keep what may still be among the k best;
then exact vectors are read in the order of their upper bounds, the foremost first, until the k-th result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.codes import scaled, whole
from siftline.llm.common import materialise, width

#: Components saturate here: products of two, summed over 32,768 dimensions, fit in 64 bits.
MOST = 1 << 24
#: Queries and approximations that are compared at a time.
BLOCK = 512, 2048


@dataclass
class Grid:
    """The cells of each dimension of vectors of one length: (size, cells + 1) edges; cell c of a dimension holds edges[c] <= x < edges[c + 1].

    The outermost edges are the table's least and greatest values (the last one plus 1), so no vector lies outside.
    """

    edges: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for k, edges in enumerate(self.edges):
            out[:, k] = np.searchsorted(edges[1:-1], x[:, k], side="right")
        return out

    def bounds(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice the middle, and twice the radius, of each row's cell in each dimension, as doubles that are whole numbers."""
        at = np.arange(codes.shape[1])
        low, high = self.edges[at, codes].astype(np.float64), self.edges[at, codes.astype(np.int64) + 1].astype(np.float64) - 1
        return low + high, high - low


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _by_size(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch by the length of its vectors; almost always all of it."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        yield size, batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))


def fit(vectors: DataFrame, *, cells: int, max_sample: int, max_bytes: int) -> dict[int, Grid]:
    """A grid for each length of vectors in a sample of the least hashes, with about equally many of the sample in each cell.

    The sample has at most ``max_sample`` vectors and ``max_bytes``; least and greatest values are those of all vectors. Where the
    cells lie decides only how close bounds are: vectors of a length that the sample lacks have one cell.
    """
    by: dict[int, list[np.ndarray]] = {}
    held = 0
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    for batch in vectors.orderBy("h", "h2").select("v").limit(max(1, min(max_sample, max_bytes // (4 * longest)))).toArrow().to_batches():
        for size, part in _by_size(batch, "v"):
            by.setdefault(size, []).append(_matrix(part.column("v"), size))
            held += by[size][-1].nbytes
    by.pop(0, None)

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, part in _by_size(batch, "v"):
                if size:
                    x = _matrix(part.column("v"), size)
                    low[size] = np.minimum(low.get(size, MOST), x.min(axis=0))
                    high[size] = np.maximum(high.get(size, -MOST), x.max(axis=0))
        for size in low:
            yield pa.record_batch([pa.array([size] * size), pa.array(range(size)), pa.array(low[size].tolist()), pa.array(high[size].tolist())], names=["size", "at", "low", "high"])

    shown = vectors.where(F.size("v").isin(list(by))).select("v")
    ends = shown.mapInArrow(extent, "size long, at long, low long, high long").groupBy("size", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    span = {(r["size"], r["at"]): (r["low"], r["high"]) for r in ends.collect()}  # a row for each dimension of the lengths that the sample shows
    out = {}
    for size, found in by.items():
        x = np.sort(np.concatenate(found), axis=0)
        inner = x[np.linspace(0, len(x) - 1, cells + 1).round().astype(int)[1:-1]].T  # values of the sample, so that frequent ones begin a cell
        low, high = np.array([span[size, k] for k in range(size)]).T
        out[size] = Grid(np.concatenate((low[:, None], np.clip(inner, low[:, None], high[:, None] + 1), high[:, None] + 1), axis=1).astype(np.int64))
    return out


class Best:
    """Per query of one block the approximations that may be among its k best, as they are scanned."""

    def __init__(self, own: list[int], x: np.ndarray, k: int):
        self.own, self.x, self.k = np.array(own, np.int64), x.astype(np.float64), k
        self.least = np.full(len(own), -np.inf)  # the k-th greatest lower bound so far
        self.lows = np.full((len(own), k), -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # query, row, upper bound
        self.held = 0

    def scan(self, rows: np.ndarray, only: np.ndarray, middle: np.ndarray, radius: np.ndarray) -> None:
        """``only`` is the one id of a row, or the least number where it has several: a row that is the query alone bounds nothing."""
        for begin in range(0, len(self.own), BLOCK[0]):
            at = slice(begin, begin + BLOCK[0])
            x = self.x[at]
            centre, reach = x @ middle.T, np.abs(x) @ radius.T
            slack = (np.abs(x) @ (np.abs(middle).max(axis=0) + radius.max(axis=0)))[:, None] * 2.0**-36  # more than the sums of doubles can err
            low, high = (centre - reach - slack) / 2, (centre + reach + slack) / 2
            low[self.own[at, None] == only] = -np.inf
            most = min(self.k, low.shape[1])
            self.lows[at] = np.sort(np.concatenate((self.lows[at], np.partition(low, low.shape[1] - most, axis=1)[:, -most:]), axis=1), axis=1)[:, -self.k :]
            self.least[at] = self.lows[at, 0]
            q, r = np.nonzero(high >= self.least[at, None])
            self.kept.append((q + begin, rows[r], high[q, r]))
            self.held += len(q)
        if self.held > 8 * self.k * len(self.own) + 65536:
            self.prune()

    def prune(self) -> None:
        """Drops what later lower bounds have ruled out."""
        q, row, high = (np.concatenate(x) for x in zip(*self.kept, strict=True)) if self.kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        may = high >= self.least[q]
        self.kept, self.held = [(q[may], row[may], high[may])], int(may.sum())

    def found(self, queries: np.ndarray) -> pa.RecordBatch:
        self.prune()
        q, row, high = self.kept[0]
        return pa.record_batch([pa.array(queries[q]), pa.array(row), pa.array(high)], names=["query", "row", "high"])


def search(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, cells: int = 256, query_rows: int = 16384, max_stripes: int = 64,
    max_sample: int = 1 << 16, max_bytes: int = 32 << 20,
) -> DataFrame:
    """The k rows of greatest inner product with each query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score.

    A component x is floor(256 x), saturated at 2^24 on both sides. The score is a long; ties go to the smaller id; the query's own id
    is no candidate. Vectors null or with null or non-finite components take no part, nor do rows with a null id; a query and a
    candidate of different length don't meet, and empty vectors score 0. Rows that repeat an id with another vector are candidates, and
    queries, of their own, the ranks of such queries being counted apart; exactly repeated rows are one. Equal vectors are
    searched once and stand for all their ids, of which a query can see only the k + 1 smallest.

    Queries are dealt into blocks of ``query_rows``, approximations into as many stripes as keep all tasks busy, at most
    ``max_stripes``; a task holds one block and streams one stripe. All bounds are exact, so no result is lost at any setting.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & whole(F.col("v")))
    own = own.select("id", scaled(F.col("v"), MOST).alias("v")).withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    # Ids of a vector in two steps, by a salt, so that no task gathers all ids of one vector.
    least = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    asks = F.array_distinct(F.flatten(F.collect_list("ids")))
    salted = own.groupBy("h", "h2", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(F.first("v").alias("v"), least.alias("ids"))
    exact = salted.groupBy("h", "h2").agg(F.first("v").alias("v"), F.slice(F.array_sort(asks), 1, k + 1).alias("ids"))
    exact = materialise(exact.withColumn("row", F.monotonically_increasing_id()), "exact")
    asked = own.where(F.col("id") % every == 0).select("id", "v").distinct()
    asked = materialise(asked.withColumn("query", F.monotonically_increasing_id()), "asked")
    grids = fit(exact, cells=cells, max_sample=max_sample, max_bytes=max_bytes)

    blocks = max(1, -(-asked.count() // query_rows))
    stripes = max(1, min(max_stripes, -(-2 * width(spark) // blocks)))
    only = F.when(F.size("ids") == 1, F.col("ids")[0]).otherwise(F.lit(-(2**63)))
    shape = "row long, only long, size int, code binary, v array<int>"

    def approximated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch, "v"):
                codes = grids[size].codes(_matrix(part.column("v"), size)).tobytes() if size in grids else b""
                each = size if size in grids else 0
                told = [codes[i * each : (i + 1) * each] for i in range(len(part))]
                yield pa.record_batch([part.column("row"), part.column("only"), pa.array([size] * len(part), pa.int32()), pa.array(told, pa.binary()), pa.nulls(len(part), pa.list_(pa.int32()))], names=["row", "only", "size", "code", "v"])

    stripe = F.pmod(F.xxhash64("row"), F.lit(stripes)).cast("int")
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    approximate = exact.select("row", only.alias("only"), "v").mapInArrow(approximated, shape)
    scanned = approximate.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), stripe.alias("stripe"), F.lit(1).alias("kind"), "row", "only", "size", "code", "v")
    queries = asked.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("kind"), F.col("query").alias("row"), F.col("id").alias("only"), F.size("v").alias("size"), F.lit(None).cast("binary").alias("code"), "v")
    tasks = blocks * stripes
    dealt = queries.unionByName(scanned).repartitionById(tasks, F.col("block") * stripes + F.col("stripe")).sortWithinPartitions("block", "stripe", "kind")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, best = None, {}, {}
        for batch in batches:
            cell = batch.column("block").to_numpy().astype(np.int64) * stripes + batch.column("stripe").to_numpy()
            kind = batch.column("kind").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1, [len(cell)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if cell[a] != now:
                    yield from (one.found(ids) for one, ids in best.values())
                    now, rows, best = cell[a], {}, {}
                for size, part in _by_size(batch.slice(a, b - a), "v") if kind[a] == 0 else _by_code(batch.slice(a, b - a)):
                    if kind[a] == 0:
                        rows.setdefault(size, []).append(part)
                        continue
                    if size in rows:
                        table = pa.Table.from_batches(rows.pop(size)).combine_chunks()
                        x = _matrix(table.column("v").combine_chunks(), size)
                        best[size] = Best(table.column("only").to_pylist(), x, k), table.column("row").to_numpy()
                    if size in best:
                        _scan(best[size][0], part, size, grids.get(size))
        yield from (one.found(ids) for one, ids in best.values())

    may = materialise(dealt.mapInArrow(bounded, "query long, row long, high double"), "bounds")
    # The foremost by their upper bounds are read first; of the rest only those whose bound reaches the k-th score so found.
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "row"))
    front = materialise(may.withColumn("place", place).where(F.col("place") <= 2 * k).select("query", "row", "high"), "front")
    scored = materialise(_scored(front, asked, exact), "scores")
    own_order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    certain = scored.withColumn("rank", F.row_number().over(own_order)).where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    last = front.groupBy("query").agg(F.min(F.struct(F.col("high"), -F.col("row"))).alias("last"))  # of the order (high falling, row rising)
    rest = may.join(last, "query").where(F.struct(F.col("high"), -F.col("row")) < F.col("last")).join(certain, "query", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    both = scored.unionByName(_scored(rest.select("query", "row", "high"), asked, exact))
    out = both.withColumn("rank", F.row_number().over(own_order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def _by_code(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes).tolist():
        yield size, batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))


def _scan(best: Best, part: pa.RecordBatch, size: int, grid: Grid | None) -> None:
    rows, only = part.column("row").to_numpy(), part.column("only").to_numpy()
    for begin in range(0, len(rows), BLOCK[1]):
        at = slice(begin, begin + BLOCK[1])
        if grid is None:
            middle, radius = np.zeros((len(rows[at]), size)), np.full((len(rows[at]), size), 2.0 * MOST)
        else:
            codes = np.frombuffer(b"".join(part.column("code").slice(begin, BLOCK[1]).to_pylist()), np.uint8).reshape(-1, size)
            middle, radius = grid.bounds(codes)
        best.scan(rows[at], only[at], middle, radius)


def _scored(pairs: DataFrame, asked: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, query_id, vec_id, score) of pairs, from the exact vectors; a row of ``exact`` stands for all its ids but the query's."""
    product = F.aggregate(F.zip_with("v", "x", lambda a, b: a.cast("long") * b.cast("long")), F.lit(0).cast("long"), lambda s, p: s + p)
    read = pairs.join(exact.select("row", F.col("v").alias("x"), "ids"), "row").join(asked.select("query", F.col("id").alias("query_id"), "v"), "query")
    return read.select("query", "query_id", F.explode("ids").alias("vec_id"), product.alias("score")).where(F.col("vec_id") != F.col("query_id"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(range(1, len(v.v) + 1), lambda i: v.v[i] * q.v[i]))::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
