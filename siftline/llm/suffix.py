"""Suffix-array dedup: repeated byte strings, found in suffix arrays built by linear grouping.

The distinct segments of repeated cores (see ``segments``) are dealt to shards. A shard's text has a symbol for each byte beside
a core, and one for each core. Its suffixes are sorted by Lyndon groups; a window goes if the suffix that begins with it has all
of the window in common with a neighbour in that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import segments as S
from siftline.llm.common import materialise, single, width


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """Group suffixes by the longest Lyndon word they begin with.

    Groups are taken in descending order. Each suffix of the group at hand asks for the nearest earlier suffix of a lower group
    (its previous smaller one); suffixes asked for by most members move up furthest within their own group. Returns the group
    (its first place in the order) and the previous smaller suffix of each suffix. The text ends in its only least symbol.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for i, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = i
        place[s], group[s] = i, start
        size[start] += 1
    smaller = [-1] * n
    end = n
    while end > 0:
        here = group[order[end - 1]]
        end = here
        members = order[here : here + size[here]]
        if len(members) > 1:
            members.sort()
        asked: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= here:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                asked[p] = asked.get(p, 0) + 1
        if not asked:
            continue
        levels: dict[int, list[int]] = {}
        for p, times in asked.items():
            levels.setdefault(times, []).append(p)
        for times in sorted(levels, reverse=True):
            moved: dict[int, int] = {}
            for p in levels[times]:  # swap to the end of what is left of its group
                old = group[p]
                last = old + size[old] - 1 - moved.get(old, 0)
                other, at = order[last], place[p]
                order[at], order[last] = other, p
                place[other], place[p] = at, last
                moved[old] = moved.get(old, 0) + 1
            for old, count in moved.items():
                if count < size[old]:
                    size[old] -= count
                    new = old + size[old]
                    size[new] = count
                    for i in range(new, new + count):
                        group[order[i]] = new
    return group, smaller


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes: each one placed puts the suffix before it, and that one's chain of smaller ones, next in their groups."""
    n = len(text)
    group, smaller = lyndon_groups(text)
    free, out, placed = list(range(n)), [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    free[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return out


def shared_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many symbols, up to ``most``, each suffix shares with the one before it in the order."""
    padded = np.concatenate((text, np.zeros(most, text.dtype)))
    shared = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for j in range(most):
        alive = alive[padded[order[alive] + j] == padded[order[alive - 1] + j]]
        shared[alive] += 1
    return shared


def repeated_windows(own: dict) -> np.ndarray:
    """A flag for each window of each segment: the suffix that begins with it shares all of it with a neighbour in the suffix array."""
    text, _, begin, need = S.contracted(own, 1)
    order = np.array(suffix_array(text.tolist()))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    shared = np.append(shared_prefixes(text, order, int(need.max())), 0)
    at = place[begin]
    return np.maximum(shared[at], shared[at + 1]) >= need


def _gone(own: DataFrame, *, length: int, gram: int, coarse: int, fine: int, hot: int, shard_symbols: int) -> DataFrame:
    def cut(raw: np.ndarray, _: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        data = raw.tobytes()
        return [data[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    return S.repeated(
        own, symbols=lambda raw, ends: (S.byte_symbols(raw), ends), cut=cut, found=repeated_windows, both_ways=True,
        unit=1, n=length, k=gram, coarse=coarse, fine=fine, width=width(own.sparkSession), hot=hot, shard_symbols=shard_symbols,
    )


def _pieces(own: DataFrame, short: DataFrame, passage: int, length: int) -> DataFrame:
    """Runs of ``length`` bytes or more that repeated passages cover: id, part (its key), tkey, at (byte), text (binary)."""
    lists = short.groupBy("id", "tkey").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))  # bounded by a document's length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tkeys, runs = (batch.column(c) for c in ("id", "tkey", "runs"))
            for first, last, raw, ends in S.texts(batch, batch.schema.get_field_index("text")):
                rows = []
                for i, a, b in zip(range(first, last), np.concatenate(([0], ends[:-1])), ends, strict=True):
                    v = runs[i].values
                    flags = S.covered(v.field("start").to_numpy(), v.field("windows").to_numpy(), passage, int(b - a))
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
                    rows += [(ids[i].as_py(), tkeys[i].as_py(), int(x), raw[a + x : a + y].tobytes()) for x, y in zip(edges[::2], edges[1::2], strict=True) if y - x >= length]
                columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "tkey", "at", "text"])

    made = own.join(lists, ["id", "tkey"]).select("id", "tkey", "text", "runs").mapInArrow(cut, "id long, tkey long, at long, text binary")
    return materialise(made.withColumn("part", F.xxhash64("tkey", "at")), "pieces")


def gone(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, passage: int = 256, gram: int = 32, coarse: int = 93, fine: int = 24, hot: int = 1 << 18, shard_symbols: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """Windows that also start elsewhere, as runs (id, tkey, start (byte), windows): those of ``length`` bytes, and those of the shorter ``passage``.

    A repeated string of ``length`` bytes lies in bytes that repeated passages cover, so these runs alone are searched for it; where
    ``passage`` is not the shorter one, ``length`` stands for both. ``length`` and ``passage`` are over ``gram``.
    """
    own, rest = single(S.keyed(docs, doc_id, text)), {"gram": gram, "hot": hot, "shard_symbols": shard_symbols}
    if passage >= length:
        found = materialise(_gone(own, length=length, coarse=min(coarse, length - gram), fine=min(fine, length - gram), **rest), "passages")
        return found, found
    short = materialise(_gone(own, length=passage, coarse=passage, fine=max(1, fine * passage // length), **rest), "passages")
    pieces = _pieces(own, short, passage, length)
    found = _gone(pieces.select("id", F.col("part").alias("tkey"), "text"), length=length, coarse=coarse, fine=fine, **rest)
    places = pieces.select("id", "part", F.col("tkey").alias("whole"), "at")
    long = found.withColumnRenamed("tkey", "part").join(places, ["id", "part"]).select("id", F.col("whole").alias("tkey"), (F.col("start") + F.col("at")).alias("start"), "windows")
    return long, short


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, n_passages long, kept binary"


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, passage: int = 256, digest_only: bool = False, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), n_passages, and kept, the remaining bytes.

    A byte is removed if a string of ``length`` bytes covers it that also starts at any other place, in this document or
    another. Strings are judged on the input and never cross documents. n_passages are the bytes that repeated strings of
    ``passage`` bytes cover, which are shorter (or of ``length``, if that is less); it tells of repeats, and removes nothing. Null and empty texts have no bytes.
    Repeated rows (same id and text) are one document and share its result; equal texts of different ids remove each other. A
    null id is an id. With ``digest_only`` kept is the SHA-256 of those bytes in hex.
    """
    passage = min(passage, length)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    long, short = gone(own, length=length, passage=passage, **options)
    runs = long.withColumn("size", F.lit(length))
    joined = S.with_gone(own, runs if passage == length else runs.unionByName(short.withColumn("size", F.lit(passage))))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), batch.column("at")
            for first, last, raw, ends in S.texts(batch, 1):
                rows = []
                for i, a, b in zip(range(first, last), np.concatenate(([0], ends[:-1])), ends, strict=True):
                    data, flags = raw[a:b], {n: np.zeros(b - a, bool) for n in (length, passage)}
                    if at[i].is_valid:
                        start, windows, size = (at[i].values.field(c).to_numpy() for c in ("start", "windows", "size"))
                        flags = {n: S.covered(start[size == n], windows[size == n], n, len(data)) for n in flags}
                    out = flags[length]
                    rest = data[~out].tobytes()
                    spans = int((out & ~np.concatenate(([False], out[:-1]))).sum()) if len(out) else 0
                    rows.append((len(data), int(out.sum()), spans, int(flags[passage].sum()), hashlib.sha256(rest).hexdigest().encode() if digest_only else rest))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([ids.slice(first, last - first), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_passages", "kept"])

    return joined.mapInArrow(kept, SCHEMA)


def digest(docs: DataFrame, **options) -> DataFrame:
    found = remove(docs, digest_only=True, **options)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"), "n_passages")


#: All windows of 400 bytes by their MD5, and runs of those that occur twice; bearable to some thousand documents.
def _covered_sql(n: int, name: str) -> str:
    return f"""
{name}w AS (SELECT doc_id, i.i AS start, md5(substr(h, 2 * i.i + 1, {2 * n})) AS s FROM d, unnest(range(0, greatest(n - {n - 1}, 0))) AS i(i)),
{name}g AS (SELECT w.doc_id, w.start FROM {name}w w JOIN (SELECT s FROM {name}w GROUP BY s HAVING count(*) > 1) t ON w.s = t.s),
{name}r AS (SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= {n} THEN 0 ELSE 1 END AS head FROM {name}g),
{name}x AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM {name}r),
{name}s AS (SELECT doc_id, min(start) AS a, max(start) + {n} AS b FROM {name}x GROUP BY doc_id, run)"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),{_covered_sql(400, "l")},{_covered_sql(256, "p")},
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM ls),
k AS (
  SELECT p.doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS lead
  FROM p JOIN d ON p.doc_id = d.doc_id GROUP BY 1),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_passages FROM ps GROUP BY 1)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(lead, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_passages, 0)::BIGINT AS n_passages
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
