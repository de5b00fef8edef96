"""Cross-tokenizer alignment: tokens of two vocabularies cut into groups that cover the same bytes, by diagonal run skipping.

Two tokenizers that agree on the bytes of a text mostly agree on its tokens too. The end offsets of both are compared at the current
index shift: stretches in which the arrays are equal are jumped by exponential probing, and only where they part is a group resolved
token by token, after which the shift is another one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise

#: Fixed value: how the byte-level vocabulary cuts a text before it merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between two word characters a single blank begins a piece in both vocabularies: a long text may be cut there and each stretch encoded for itself.
_CUT = re.compile(r"(?<=\w) (?=\w)")
_BLANK = "▁"
#: Characters after which a long text is cut, at the next place that allows it.
STRETCH = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in which a byte-level vocabulary is written: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Vocabularies:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, folder: str, byte_file: str, piece_file: str):
        with open(f"{folder}/{byte_file}", encoding="utf-8") as file:
            told = json.load(file)
        special, alphabet = {t["id"] for t in told["added_tokens"]}, byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in told["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding(byte_file, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{piece_file}")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any(_BLANK in p.lstrip(_BLANK) for p in pieces)
        self.a_size, self.b_size = (np.array([len(t) for t in tokens]) for tokens in (self.a_bytes, self.b_bytes))
        #: Each id in decimals, followed by the sign that goes on within a group, ends its first or its second side.
        self.marks = [f"{i}{sign}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in ",|;"]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a blank and the text by both; none where the text is null or empty, or one of them does not give its bytes back."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        whole = (" " + text).encode("utf-8", "surrogatepass")
        a, b = [], []
        for part in stretches(text) if self.cuttable else [text]:
            a.append(self.a.encode_to_numpy(" " + part, disallowed_special=()))
            b += self.b.encode(part)
        ids = np.concatenate(a).astype(np.int64)
        # The first has a sign for each byte and cuts the text without a gap, so its bytes are the text's where their number is.
        same = int(self.a_size[ids].sum()) == len(whole) and b"".join(map(self.b_bytes.__getitem__, b)) == whole
        return (ids, np.array(b, np.int64)) if same else none


def stretches(text: str, length: int = STRETCH) -> Iterator[str]:
    """The text in stretches of at least ``length`` characters; the blanks at which it is cut are left out."""
    begin = 0
    while cut := _CUT.search(text, begin + length):
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


@lru_cache(maxsize=2)
def vocabularies(folder: str, byte_file: str, piece_file: str) -> Vocabularies:
    """Loaded once a worker."""
    return Vocabularies(folder, byte_file, piece_file)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end, as indices into both arrays (exclusive). Both are of 4-byte integers, rise, and end with the same value.

    ``i`` and ``j`` are tokens whose ends are to be compared, so their difference is the present shift. Where they part the lower end
    moves on until they meet again, which closes an irregular group and sets the shift; the run of equal ends from there on is found
    by probes of doubling width, and then of halving width.
    """
    raw_a, raw_b, at_a, at_b = ends_a.tobytes(), ends_b.tobytes(), memoryview(ends_a), memoryview(ends_b)
    runs: list[tuple[int, int, int]] = []
    i = j = 0
    n = len(ends_a)
    while i < n:
        a, b = at_a[i], at_b[j]
        while a != b:
            if a < b:
                i += 1
                a = at_a[i]
            else:
                j += 1
                b = at_b[j]
        x, y, width = 4 * i + 4, 4 * j + 4, 4
        while (part := raw_a[x : x + width]) and part == raw_b[y : y + width]:
            x, y, width = x + len(part), y + len(part), 2 * width
        while width > 4:  # the run ends inside the last probe
            width //= 2
            part = raw_a[x : x + width]
            if len(part) == width and part == raw_b[y : y + width]:
                x, y = x + width, y + width
        runs.append((i, j, x // 4 - i))
        i, j = x // 4, y // 4
    first_a, first_b, length = np.array(runs, np.int64).reshape(-1, 3).T
    within = np.arange(1, length.sum() + 1) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(first_a, length) + within, np.repeat(first_b, length) + within


def aligned(text: str | None, known: Vocabularies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids by both vocabularies, and the index after each group's last token in both."""
    a, b = known.encode(text)
    return a, b, *groups(np.cumsum(known.a_size[a], dtype=np.int32), np.cumsum(known.b_size[b], dtype=np.int32))


def spelled(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, known: Vocabularies) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group in order, of the first vocabulary and then of the second."""
    begin_a, begin_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    signs_a, signs_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    signs_a[ends_a - 1], signs_b[ends_b - 1] = 1, 2
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + np.repeat(begin_b, ends_a - begin_a)] = 3 * a + signs_a
    out[np.arange(len(b)) + np.repeat(ends_a, ends_b - begin_b)] = 3 * b + signs_b
    return b"".join(map(known.marks.__getitem__, out.tolist()))[:-1]


def align(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizers: str = "/opt/tokenizers", byte_file: str = "byte_bpe_50k.json", piece_file: str = "piece_bpe_32k.model",
) -> DataFrame:
    """(doc_id, a, b, ends_a, ends_b) of each row: token ids of a blank and the text by both vocabularies, and the index after each group's last token in both.

    ``tokenizers`` is a folder that every executor has. Null and empty texts, and texts whose bytes one of the vocabularies does not
    give back (the second has no sign of its own for U+2581), have empty lists. A row is a row: those that repeat are aligned each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(tokenizers, byte_file, piece_file)
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                lists = aligned(value.as_py(), known)
                yield pa.record_batch([batch.column(0).slice(i, 1), *(pa.array([x.tolist()], pa.list_(pa.int32())) for x in lists)], names=["doc_id", "a", "b", "ends_a", "ends_b"])

    return _pair(documents, doc_id, text).mapInArrow(run, "doc_id long, a array<int>, b array<int>, ends_a array<int>, ends_b array<int>")


def _pair(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def digest(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizers: str = "/opt/tokenizers", byte_file: str = "byte_bpe_50k.json", piece_file: str = "piece_bpe_32k.model",
    max_pairs: int = 1 << 20,
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a token of each vocabulary whose byte ranges end together, so each group has one: that of its last tokens. The count of
    a pair of ids is the number of links of all rows that hold it (rows that repeat count each time); n_best are the links whose pair
    has the highest count of its second id, ties included; count_sum sums the counts over the links. Null and empty texts, and texts
    whose bytes are not given back, have zeros and ''; null ids stay null. Other columns of the table are not read.

    The commonest pairs, at most ``max_pairs``, go to the tasks; rarer ones are joined by a shuffle. Both together are all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(tokenizers, byte_file, piece_file)
        for batch in batches:
            for begin in range(0, len(batch), 128):
                part = batch.slice(begin, 128)
                yield _digested(part.column(0), part.column(1), known)

    shape = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = materialise(_pair(documents, doc_id, text).mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", "l.pairs", "l.times").withColumnRenamed("pairs", "pair")
    counts = materialise(links.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    best = counts.groupBy(second).agg(F.max("count").alias("most"))  # a row for each id of the second vocabulary
    counts = materialise(counts.join(best, counts["pair"].bitwiseAND(F.lit(0xFFFFFFFF)) == best["b"]).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")
    sums = _summed(links, counts, max_pairs)
    found = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def _digested(ids: pa.Array, texts: pa.Array, known: Vocabularies) -> pa.RecordBatch:
    sizes: list[tuple[int, int, int]] = []
    digests: list[str] = []
    pairs: list[np.ndarray] = []
    times: list[np.ndarray] = []
    for value in texts:
        a, b, ends_a, ends_b = aligned(value.as_py(), known)
        sizes.append((len(a), len(b), len(ends_a)))
        digests.append(hashlib.sha256(spelled(a, b, ends_a, ends_b, known)).hexdigest() if len(a) else "")
        pair, n = np.unique((a[ends_a - 1] << 32) | b[ends_b - 1], return_counts=True) if len(a) else (np.zeros(0, np.int64),) * 2
        pairs.append(pair)
        times.append(n)
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in pairs]))), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
    n_a, n_b, n_groups = (pa.array(x, pa.int64()) for x in zip(*sizes, strict=True))
    return pa.record_batch([ids, n_a, n_b, n_groups, pa.array(digests), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])


def _summed(links: DataFrame, counts: DataFrame, max_pairs: int) -> DataFrame:
    """(row, n_best, count_sum). Pairs of a count from the least power of two on at which at most ``max_pairs`` are left are broadcast."""
    sizes = {r["p"]: r["n"] for r in counts.groupBy(F.floor(F.log2("count")).alias("p")).agg(F.count("*").alias("n")).collect()}  # at most 64 rows
    power, held = 64, 0
    while power and held + sizes.get(power - 1, 0) <= max_pairs:
        power -= 1
        held += sizes.get(power, 0)
    frequent: Column = F.lit(True) if not power else F.floor(F.log2("count")) >= power
    joined = links.join(F.broadcast(counts.where(frequent)), "pair")
    if power:
        joined = joined.unionByName(links.join(counts.where(~frequent), "pair"))
    times = F.col("times").cast("long")
    return joined.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("count")).alias("count_sum"))
