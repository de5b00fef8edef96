"""Substring dedup: a compressed FM-index per shard, and matching statistics by backward search over its wavelet tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import segments as S
from siftline.llm.common import width

_WORD_BITS = 64


class Wavelet:
    """A wavelet tree, stored level by level: at each level the symbols are split stably by one bit, the zeros first.

    A level is a packed bit vector with a running count of ones per machine word.
    """

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % _WORD_BITS + _WORD_BITS, np.uint8))), bitorder="little").view("<u8")
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.levels.append((packed, ones, len(bit) - int(bit.sum())))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position ``end``."""
        low, high = np.zeros_like(end), end
        for (packed, ones, zeros), level in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> level & 1) == 1
            low1, high1 = (self._ones(packed, ones, x) for x in (low, high))
            low, high = np.where(one, zeros + low1, low - low1), np.where(one, zeros + high1, high - high1)
        return high - low

    @staticmethod
    def _ones(packed: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; the text ends with its only least symbol."""
    rank, k = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.concatenate((rank[k:], np.full(min(k, len(rank)), -1)))
        key = rank * (int(rank.max()) + 2) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, k = new, 2 * k
        if rank.max() == len(rank) - 1 or k > len(rank):
            return order


class FMIndex:
    """Symbol counts and the wavelet tree of the Burrows-Wheeler transform of a text of small integers ending in its only 0."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        self.sigma = int(text.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.tree = Wavelet(text[order - 1], max(1, int(self.sigma - 1).bit_length()))

    def statistics(self, text: np.ndarray, ends: np.ndarray, length: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the streamed text: how far back from each of ``ends``, up to its ``length`` symbols, the text still
        occurs ``least`` times in the index, and the first row of that interval of suffixes."""
        depth = np.zeros(len(ends), np.int64)
        rows = np.full(len(ends), -1)
        live = np.arange(len(ends))
        first, last = np.zeros(len(ends), np.int64), np.full(len(ends), self.before[-1])
        for back in range(1, int(length.max(initial=0)) + 1):
            go = length[live] >= back
            live, first, last = live[go], first[go], last[go]
            symbol = text[ends[live] - back]
            first = self.before[symbol] + self.tree.rank(symbol, first)
            last = self.before[symbol] + self.tree.rank(symbol, last)
            some = last - first >= least
            live, first, last = live[some], first[some], last[some]
            if not len(live):
                break
            depth[live], rows[live] = back, first
        return depth, rows


def repeated_windows(own: dict, keep_first: bool = True) -> np.ndarray:
    """A flag for each window of each segment: it occurs in another segment of the shard (earlier, with ``keep_first``)."""
    text, row, begin, need = S.contracted(own, 8)
    depth, interval = FMIndex(text).statistics(text, begin + need, need)
    gone = depth >= need
    if keep_first:
        hit = np.flatnonzero(gone)
        inside = np.arange(len(row)) - (np.cumsum(own["windows"]) - own["windows"])[row]
        doc, start = own["id"][row[hit]], own["start"][row[hit]] + inside[hit]
        order = np.lexsort((start, doc, interval[hit]))
        lead = np.concatenate(([True], np.diff(interval[hit][order]) != 0)) if len(hit) else np.empty(0, bool)
        # Rows of one id and start (an id with several texts) tie with the leader and stay.
        group = np.cumsum(lead) - 1
        leader = order[lead]
        stays = (doc[order] == doc[leader][group]) & (start[order] == start[leader][group]) if len(hit) else lead
        gone[hit[order[stays]]] = False
    return gone


def gone(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 20, gram: int = 6, coarse: int = 15, fine: int = 4, hot: int = 1 << 20, shard_symbols: int = 1 << 20) -> DataFrame:
    """Windows of ``words`` words that occur earlier, as runs: id, tkey, start (word), windows."""

    def symbols(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, stops = S.words(raw, ends)
        return S.word_symbols(raw, starts, stops), np.searchsorted(starts, ends)

    def cut(_: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        data = own.tobytes()
        return [data[a:b] for a, b in zip((8 * first).tolist(), (8 * last).tolist(), strict=True)]

    return S.repeated(
        S.keyed(docs, doc_id, text), symbols=symbols, cut=cut, found=repeated_windows, both_ways=False,
        unit=8, n=words, k=gram, coarse=coarse, fine=fine, width=width(docs.sparkSession), hot=hot, shard_symbols=shard_symbols,
    )


SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 20, digest_only: bool = False, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, and kept: the words outside repeated windows, joined by one space.

    A window is ``words`` consecutive words; it is removed if its words also start earlier: in a document of a smaller id, or
    earlier in the same document. Windows are judged on the input. Null and empty texts have no words. Repeated rows (same id
    and text) are one document and share its result; windows of rows with one id but different texts don't remove each
    other at the same start. A null id is the smallest. With ``digest_only`` kept is the SHA-256 of those words.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    joined = S.with_gone(own, gone(own, words=words, **options))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), batch.column("at")
            for first, last, raw, ends in S.texts(batch, 1):
                total, removed, out = [], [], []
                data = raw.tobytes()
                for i, a, b in zip(range(first, last), np.concatenate(([0], ends[:-1])), ends, strict=True):
                    tokens = data[a:b].split()
                    runs, flags = at[i], None
                    if runs.is_valid and len(tokens):
                        v = runs.values
                        flags = S.covered(v.field("start").to_numpy(), v.field("windows").to_numpy(), words, len(tokens))
                        tokens = [t for t, f in zip(tokens, flags.tolist(), strict=True) if not f]
                    total.append(len(tokens) + (int(flags.sum()) if flags is not None else 0))
                    removed.append(int(flags.sum()) if flags is not None else 0)
                    line = b" ".join(tokens)
                    out.append(hashlib.sha256(line).hexdigest() if digest_only else line.decode("utf-8", "replace"))
                yield pa.record_batch([ids.slice(first, last - first), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(kept, SCHEMA)


def digest(docs: DataFrame, **options) -> DataFrame:
    return remove(docs, digest_only=True, **options).withColumnRenamed("kept", "kept_sha256")


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i.i AS start, array_to_string(w[i.i + 1 : i.i + 20], ' ') AS seq FROM words, unnest(range(0, greatest(len(w) - 19, 0))) AS i(i)),
marked AS (SELECT doc_id, start, row_number() OVER (PARTITION BY seq ORDER BY doc_id, start) > 1 AS gone FROM windows),
cover AS (SELECT DISTINCT doc_id, start + j.j AS at FROM marked, unnest(range(0, 20)) AS j(j) WHERE gone),
each AS (SELECT doc_id, p.p AS at, w[p.p + 1] AS word FROM words, unnest(range(0, len(w))) AS p(p)),
kept AS (
  SELECT e.doc_id, count(c.at) AS n_removed, string_agg(e.word, ' ' ORDER BY e.at) FILTER (c.at IS NULL) AS line
  FROM each e LEFT JOIN cover c ON e.doc_id = c.doc_id AND e.at = c.at GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.line, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
