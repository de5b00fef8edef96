"""Vector code compression: each part of an integer vector becomes the index of its nearest codebook entry, found without floating point.

Parts and entries are padded with zeros to a power of two and turned by the integer Walsh-Hadamard transform H. As H is orthogonal up to
the scale n, n times the squared distance of two parts is the sum of the squared differences of their coefficients. These are added in
sequency order (slowly changing rows first, which hold most of a smooth part), and an entry is given up once its sum exceeds the whole
sum of another entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise

#: Rows of a task that are compared with a codebook at a time.
BLOCK = 2048
#: Bits that a component may have, less those of the padded part's length: sums of squares then fit in 64 bits.
BITS = 28


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural n x n Hadamard matrix by their number of sign changes: row s of the order is the bit reversal of s in Gray code."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    out = np.zeros(n, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def transform(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, in sequency order; the row is padded with zeros to a power of two."""
    width = parts.shape[1]
    n = 1 << max(0, width - 1).bit_length()
    out = np.zeros((len(parts), n), np.int64)
    out[:, :width] = parts
    step = 1
    while step < n:
        pairs = out.reshape(len(parts), n // (2 * step), 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(parts), n)
        step *= 2
    return out[:, sequency_order(n)]


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the index of its nearest entry (ties: the smaller index) and their squared distance, exactly."""
    x, c = transform(parts), transform(entries)
    n = x.shape[1]
    first = (x[:, :1] - c[:, 0]) ** 2
    # The whole sum of the entry that begins best bounds the least one from above; entries of equal sums stay, for the tie.
    begun = np.argmin(first, axis=1)
    bound = ((x - c[begun]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for k in range(1, n):
        total = total + (x[row, k] - c[entry, k]) ** 2
        kept = total <= bound[row]
        row, entry, total = row[kept], entry[kept], total[kept]
        if len(row) == len(parts):
            break
    if len(row) == len(parts):  # one entry is left for each row: the one that gave the bound
        return entry, ((parts - entries[entry]) ** 2).sum(axis=1)
    order = np.lexsort((entry, total, row))
    best = order[np.unique(row[order], return_index=True)[1]]
    return entry[best], total[best] // n


def whole(v: Column) -> Column:
    """Vectors that take part: not null, and no null or non-finite component."""
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def scaled(v: Column, most: int) -> Column:
    """floor(256 x) of each component as an integer, at most ``most`` from zero."""
    return F.transform(v, lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x * 256.0))))).cast("int"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The lists of a column as rows; shorter ones end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == size).all():
        return flat.reshape(-1, size).astype(np.int64)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def codebooks(vectors: DataFrame, *, parts: int, entries: int, rounds: int, size: int) -> np.ndarray:
    """The entries of each part position, (parts, entries, width): at first the parts of the smallest ids, then means of what lies nearest, rounded down.

    ``vectors`` has id and v (integers). The driver holds one codebook: ``entries`` vectors.
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).toArrow().column("v").combine_chunks()
    books = _matrix(first, size).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    width = books.shape[2]
    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(now.shape[:2], np.int64), np.zeros(now.shape, np.int64)
            for batch in batches:
                rows = _matrix(batch.column("v"), size).reshape(-1, parts, width)
                for p in range(parts):
                    for begin in range(0, len(rows), BLOCK):
                        part = rows[begin : begin + BLOCK, p]
                        entry, _ = nearest_entries(part, now[p])
                        count[p] += np.bincount(entry, minlength=now.shape[1])
                        np.add.at(total[p], entry, part)
            p, e = np.nonzero(count)
            columns = [p, e, count[p, e], *(total[p, e, k] for k in range(width))]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=names)

        names = ["part", "entry", "n", *(f"s{k}" for k in range(width))]
        # A row for each used entry and task at most; what comes back is a row for each entry.
        found = vectors.select("v").mapInArrow(sums, ", ".join(f"{x} long" for x in names)).groupBy("part", "entry").agg(*(F.sum(x).alias(x) for x in names[2:]))
        books = now.copy()
        for r in found.collect():
            books[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def encode(
    vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) of each kept row, and the codebooks (parts, entries, width) with which codes turn into vectors again.

    Vectors that are null or hold null or non-finite components are dropped. A component x is floor(256 x), in [-m, m] with m = 2^28
    over the padded length of a part: beyond it saturates. Vectors shorter than the longest count as ending in zeros, which also
    fill it up to a multiple of ``parts``. Null ids come after all others where the first entries are chosen, equal ids go by their
    vectors; rows that repeat count each time. Of equally near entries the first is taken, so also of entries that are equal.
    """
    kept = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).where(whole(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 1
    size = -(-longest // parts) * parts
    most = (1 << BITS) // (1 << (size // parts - 1).bit_length())
    rows = kept.select("id", "label", scaled(F.col("v"), most).alias("v"))
    books = codebooks(rows, parts=parts, entries=entries, rounds=rounds, size=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), size).reshape(-1, parts, size // parts)
            codes, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
            for begin in range(0, len(x), BLOCK):
                at = slice(begin, begin + BLOCK)
                for p in range(parts):
                    codes[at, p], far = nearest_entries(x[at, p], books[p])
                    error[at] += far
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel()))
            yield pa.record_batch([batch.column("id"), batch.column("label"), lists, pa.array(error)], names=["vec_id", "label", "codes", "error"])

    kind = dict(rows.dtypes)["label"]
    return rows.mapInArrow(run, f"vec_id long, label {kind}, codes array<int>, error long"), books


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors, as integers, that rows of codes stand for."""
    return np.concatenate([books[p, codes[:, p]] for p in range(codes.shape[1])], axis=1)


def digest(vectors: DataFrame, *, max_labels: int = 1 << 17, **options) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error, codebooks_sha256; what is kept, and further options, as in ``encode``.

    label_error is the sum over the rows of the same label, nulls together (null where it leaves 64 bits). No rows: an empty result.
    """
    coded, books = encode(vectors, **options)
    coded = materialise(coded, "codes")
    told = ",".join(map(str, books.ravel().tolist()))
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    known = materialise(sums, "label-errors")
    if known.count() <= max_labels:
        known = F.broadcast(known)
    two = F.transform("codes", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0"))
    out = coded.alias("c").join(known.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return out.select("vec_id", F.lower(F.array_join(two, "")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"))


#: Exact, with all distances: entries and parts are rows (part, place in the part, value).
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT id, k AS part, list_slice(v, k * (len(v) // 16) + 1, (k + 1) * (len(v) // 16)) AS x FROM v, range(16) t(k)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS entry, x FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY id) <= 64),
d0 AS (SELECT p.id, p.part, p.x, arg_min(c0.entry, (list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c0.x[i]) * (p.x[i] - c0.x[i]))), c0.entry)) AS entry
  FROM p JOIN c0 USING (part) GROUP BY ALL),
m0 AS (SELECT part, entry, list(s ORDER BY i) AS x FROM (
  SELECT part, entry, i, floor(sum(x[i]) / count(*))::BIGINT AS s FROM d0, range(1, (SELECT max(len(x)) FROM p) + 1) t(i) GROUP BY ALL) GROUP BY ALL),
c1 AS (SELECT part, entry, coalesce(m0.x, c0.x) AS x FROM c0 LEFT JOIN m0 USING (part, entry)),
d1 AS (SELECT p.id, p.part, p.x, arg_min(c1.entry, (list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c1.x[i]) * (p.x[i] - c1.x[i]))), c1.entry)) AS entry
  FROM p JOIN c1 USING (part) GROUP BY ALL),
m1 AS (SELECT part, entry, list(s ORDER BY i) AS x FROM (
  SELECT part, entry, i, floor(sum(x[i]) / count(*))::BIGINT AS s FROM d1, range(1, (SELECT max(len(x)) FROM p) + 1) t(i) GROUP BY ALL) GROUP BY ALL),
c2 AS (SELECT part, entry, coalesce(m1.x, c1.x) AS x FROM c1 LEFT JOIN m1 USING (part, entry)),
d2 AS (SELECT id, part, min((far, entry)) AS best FROM (
  SELECT p.id, p.part, c2.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c2.x[i]) * (p.x[i] - c2.x[i]))) AS far FROM p JOIN c2 USING (part)) GROUP BY ALL),
r AS (SELECT id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM d2 GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM c2)
SELECT v.id AS vec_id, r.code, r.error, sum(r.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, h.h AS codebooks_sha256 FROM v JOIN r USING (id), h
"""
