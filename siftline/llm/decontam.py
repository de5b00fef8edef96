"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans every text once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import fresh, materialise

#: Bytes that words keep: digits, letters (lower-cased) and everything beyond ASCII; the rest separates words.
_KEPT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SCHEMA = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>, n_items long"
FIELDS = ["n_words", "n_hit", "item_ids", "spans", "n_items"]


def normalise(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT).split()


@dataclass
class Passages:
    """An automaton over blocks of the items' words, and around each block what has to stand beside it for a window.

    A window of n words holds a whole block of ``block`` = (n + 1) // 2 words of its item, counted from the item's begin. So the
    automaton needs each word of an item once, not n times, and a block that occurs is grown to both sides word by word.
    """

    n: int
    blocks: ahocorasick.Automaton

    @property
    def block(self) -> int:
        return (self.n + 1) // 2


def automaton(items: Iterable[tuple[str | None, str | None]], n: int) -> Passages:
    """Items of fewer than ``n`` words are one pattern each; of the others all whole blocks, with up to n - block words at both sides."""
    out = Passages(n, ahocorasick.Automaton())
    size, same = out.block, {}
    patterns: dict[str, tuple[set, dict]] = {}  # items that are the pattern; items by the words at both sides
    for item, text in items:
        words = [same.setdefault(w, w) for w in normalise(text)]
        if 0 < len(words) < n:
            patterns.setdefault(_framed(words), (set(), {}))[0].add(item)
        for i in range(0, len(words) - size + 1, size) if len(words) >= n else ():
            sides = tuple(words[max(0, i - n + size) : i]), tuple(words[i + size : i + n])
            patterns.setdefault(_framed(words[i : i + size]), (set(), {}))[1].setdefault(sides, set()).add(item)
    for pattern, (whole, sides) in patterns.items():
        out.blocks.add_word(pattern, (pattern.count(" ") - 1, len(pattern), tuple(whole), tuple((x, y, tuple(ids)) for (x, y), ids in sides.items())))
    if len(out.blocks):
        out.blocks.make_automaton()
    return out


def _framed(words: list[bytes]) -> str:
    return f" {b' '.join(words).decode('latin-1')} "


def scan(text: str | None, found: Passages) -> tuple[int, int, list[str], list[tuple[int, int]], int]:
    """Words, hit words, ids of items with occurring windows, the hit runs as code-point offsets of the original text, and the number of these items: all without an id count as one."""
    words = normalise(text)
    if not words or not len(found.blocks):
        return len(words), 0, [], [], 0
    line = _framed(words)
    hits = list(found.blocks.iter(line))
    if not hits:
        return len(words), 0, [], [], 0
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    edges = np.zeros(len(words) + 1, np.int64)
    items: set[str | None] = set()
    for end, (size, length, whole, sides) in hits:
        first = int(np.searchsorted(blanks, end - length + 1))
        if whole:
            edges[first] += 1
            edges[first + size] -= 1
            items.update(whole)
        for before, after, ids in sides:
            a = b = 0
            while a < len(before) and a < first and before[-1 - a] == words[first - 1 - a]:
                a += 1
            while b < len(after) and first + size + b < len(words) and after[b] == words[first + size + b]:
                b += 1
            if a + size + b >= found.n:
                edges[first - a] += 1
                edges[first + size + b] -= 1
                items.update(ids)
    hit = np.cumsum(edges[:-1]) > 0
    if not hit.any():
        return len(words), 0, [], [], 0
    return len(words), int(hit.sum()), sorted(i for i in items if i is not None), _original(text, hit), len(items)


def _original(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as [start, end) in code points of the text as it was."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kept = np.concatenate(([False], np.frombuffer(_KEPT, np.uint8)[raw] != 0x20, [False]))
    starts, ends = np.flatnonzero(kept[1:] & ~kept[:-1]), np.flatnonzero(~kept[1:] & kept[:-1])
    code_point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    runs = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [(int(code_point[starts[a]]), int(code_point[ends[b - 1]])) for a, b in zip(runs[::2], runs[1::2], strict=True)]


#: Words of an item that are taken at a time; the next take begins with the words that a window needs of the one before.
TAKE = 1 << 16


def parts(benchmark: DataFrame, *, item_id: str, text: str, window_words: int, max_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in lists of at most ``max_bytes`` of text and framing (and one take), one after the other: the driver holds one. A long item comes in takes that share words."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = normalise(row.t)
        for begin in range(0, max(1, len(words) - window_words + 1), TAKE):
            take = b" ".join(words[begin : begin + TAKE + window_words - 1]).decode("utf-8", "surrogatepass")
            if held and size + 2 * len(take) > max_bytes:
                yield held
                held, size = [], 0
            held.append((row.i, take))
            size += 2 * len(take) + 64
    yield held


#: The automaton that this worker built last, with its key: Spark reuses workers for task after task.
_built: dict[str, Passages] = {}


def _kept(key: str, items: list[tuple[str | None, str | None]], n: int) -> Passages:
    if key not in _built:
        _built.clear()
        _built[key] = automaton(items, n)
    return _built[key]


def _column(items: list[tuple[str | None, str | None]], n: int):
    key = hashlib.sha256(repr((n, items)).encode("utf-8", "surrogatepass")).hexdigest()

    @F.pandas_udf(SCHEMA)
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = _kept(key, items, n)
        for texts in batches:
            yield pd.DataFrame([scan(t, found) for t in texts], columns=FIELDS)

    return marked


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", into: str = "hit", item_text: str = "text", item_id: str = "item_id", window_words: int = 13, max_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with one more column ``into`` (SCHEMA): words, hit words, item ids and spans of the benchmark passages in the text.

    A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. Null and empty texts have no words and no hits; an empty benchmark hits nothing; repeated items or rows change nothing. An item without an id hits like any other; it is counted in n_items, but item_ids leave it out. Columns of ``docs`` stay as they are; one named like ``into`` is replaced.

    A benchmark of more than ``max_bytes`` (twice its text) is scanned part by part: a worker builds one automaton, of at most that many
    nodes or so, and each part's hits are written before the next part is read.
    """
    lists = parts(benchmark, item_id=item_id, text=item_text, window_words=window_words, max_bytes=max_bytes)
    first, second = next(lists), next(lists, None)
    if second is None:
        return docs.withColumn(into, _column(first, window_words)(F.col(text)))
    own = docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), F.col(text).alias("t"))
    found = []
    for n, items in enumerate(chain((first, second), lists)):
        hit = own.select("h", "h2", _column(items, window_words)("t").alias("own")).where("own.n_hit > 0").dropDuplicates(["h", "h2"])
        found.append(materialise(hit, f"hits-{n}"))
    every = reduce(DataFrame.unionByName, found).groupBy("h", "h2").agg(F.collect_list("own").alias("own"))  # a row for each part at most
    key, key2, name = fresh(docs, "h"), fresh(docs, "h2"), fresh(docs, "own")
    every = materialise(every, "hits").select(F.col("h").alias(key), F.col("h2").alias(key2), F.col("own").alias(name))
    joined = docs.withColumns({key: F.xxhash64(text), key2: F.xxhash64(F.lit(1), text)}).join(every, [key, key2], "left")
    return joined.withColumn(into, _merged(F.col(name), F.col(text))).drop(key, key2, name)


def _merged(parts: Column, text: Column) -> Column:
    """The results over the parts of a large benchmark as one."""

    @F.pandas_udf(SCHEMA)
    def merge(parts: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for own, text in zip(parts, texts, strict=True):
            own = [] if own is None else own
            spans: list[tuple[int, int]] = []
            for a, b in sorted((s["start"], s["end"]) for p in own for s in p["spans"]):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            items = sorted({i for p in own for i in p["item_ids"]})
            unnamed = any(p["n_items"] > len(p["item_ids"]) for p in own)
            rows.append((len(normalise(text)), sum(len(normalise(text[a:b])) for a, b in spans), items, spans, len(items) + unnamed))
        return pd.DataFrame(rows, columns=FIELDS)

    return merge(parts, text)


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """True where at least one in ``share`` words is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def digest(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: counts, the digest of the item ids, and whether the document is contaminated."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    hit = mark(own, benchmark, **options).select("doc_id", "hit.*")
    return hit.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated rows; all columns stay."""
    name = fresh(docs, "hit")
    hit = mark(docs, benchmark, text=text, into=name, **options)
    return hit.where(~contaminated(F.col(f"{name}.n_words"), F.col(f"{name}.n_hit"))).drop(name)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id::VARCHAR AS item, least(13, len(w)) AS n, array_to_string(w[s.s + 1 : s.s + least(13, len(w))], ' ') AS seq FROM b, unnest(range(0, greatest(1, len(w) - 12))) AS s(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM p),
x AS (SELECT doc_id, s.s AS start, n, array_to_string(w[s.s + 1 : s.s + n], ' ') AS seq FROM d, sizes, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s(s)),
h AS (SELECT x.doc_id, x.start, x.n, p.item FROM x JOIN p ON x.seq = p.seq AND x.n = p.n),
c AS (SELECT doc_id, count(DISTINCT start + j.j) AS n_hit FROM h, unnest(range(0, n)) AS j(j) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
