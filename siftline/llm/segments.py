"""Segments: how repeated runs of symbols are brought together without comparing everything with everything.

Each window of ``n`` symbols has an anchor, the k-gram of the least hash inside it (the leftmost of equals), at some offset.
Offsets fall into classes of ``width``. The windows of one class that share one occurrence of an anchor have a core in common,
``n - width + 1`` symbols or more: they make a segment, that is symbols to the left, the core, symbols to the right. Equal
windows have anchors at equal offsets, so a repeat is found among the segments of one core alone.

Exact copies of a segment are counted by Spark with partial aggregation, so a passage in a third of all documents is one row.
Distinct segments of one core go to an index, where the core is a single symbol. Cores are refined first, from ``coarse`` to
``fine`` classes, and those of very many segments are refined once more, down to single windows, which have no distinct
segments left. Every step is exact; equality rests on hashes of two independent families, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import discard, doc_key, materialise

U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
#: Bytes that split words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The base to the powers 0 to n."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        x = np.full(max(n + 1, 1 << 16), base, U)
        x[0] = 1
        have = _powers[base] = np.cumprod(x, dtype=U)
    return have[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Sums:
    """Hashes of any stretches of a sequence of 64-bit symbols, independent of where a stretch lies. There are two families."""

    def __init__(self, symbols: np.ndarray, family: int = 0):
        forth, self._back = (powers(x[family], len(symbols)) for x in (_BASES, _INVERSES))
        self._sums = np.zeros(len(symbols) + 1, U)
        np.cumsum((mixed(symbols ^ U(0xA5A5A5A5)) | U(1) if family else symbols) * forth[: len(symbols)], dtype=U, out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(U))


def byte_symbols(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of each word of concatenated texts that end at ``ends``; no word crosses a text's end."""
    kept = np.concatenate(([False], ~SPACE[raw], [False]))
    fence = np.zeros(len(raw) + 1, bool)
    fence[ends] = fence[0] = True
    starts = np.flatnonzero(kept[1:-1] & (~kept[:-2] | fence[:-1]))
    stops = np.flatnonzero(kept[1:-1] & (~kept[2:] | fence[1:])) + 1
    return starts, stops


def word_symbols(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return Sums(byte_symbols(raw)).of(starts, stops)


def runs(sums: Sums, ends: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share one occurrence of an anchor: first window, windows, anchor, document. Documents end at ``ends``."""
    size = int(ends[-1]) if len(ends) else 0
    m = size - n + 1
    if m <= 0:
        return (np.empty(0, np.int64),) * 4
    at = np.arange(size - k + 1)
    key = (sums.of(at, at + k) >> U(32) << U(32)) | at.astype(U)
    anchor = (_sliding_min(key, n - k + 1)[:m] & U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    valid = doc[:m] == doc[n - 1 :]
    same = np.zeros(m, bool)
    same[1:] = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1]) & (doc[1:m] == doc[: m - 1])
    heads = np.flatnonzero(valid & ~same)
    tails = np.flatnonzero(valid & ~np.concatenate((same[1:], [False])))
    return heads, tails - heads + 1, anchor[heads], doc[heads]


def split(heads: np.ndarray, count: np.ndarray, anchor: np.ndarray, n: int, k: int, width: int) -> dict[str, np.ndarray]:
    """Runs of windows cut where the class of the anchor's offset changes.

    Returns of each piece: run, start, windows, offset (of the anchor in the first window), class, and the [a, b) of its core.
    """
    most, least = anchor - heads, anchor - heads - count + 1
    pieces = most // width - least // width + 1
    run = np.repeat(np.arange(len(heads)), pieces)
    at = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    kind = most[run] // width - at
    high, low = np.minimum(most[run], (kind + 1) * width - 1), np.maximum(least[run], kind * width)
    last = np.minimum((kind + 1) * width - 1, n - k)
    where = anchor[run]
    return {"run": run, "start": where - high, "windows": high - low + 1, "offset": high, "class": kind, "a": where - kind * width, "b": where - last + n}


def _sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` consecutive keys, from running minima of blocks of ``w``."""
    m = len(key) - w + 1
    if m <= 0:
        return np.empty(0, U)
    padded = np.concatenate((key, np.full(-len(key) % w, np.iinfo(U).max, U))).reshape(-1, w)
    forth = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], forth[w - 1 : w - 1 + m])


def hashed(p: dict[str, np.ndarray], sums: Sums, twin: Sums, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece: its core by either family (the first with the class), and all of it by the second with its place about the anchor."""
    core = mixed(sums.of(p["a"], p["b"]) ^ mixed(p["class"].astype(U) + U(1)))
    whole = mixed(twin.of(p["start"], p["start"] + p["windows"] - 1 + n) ^ mixed(p["offset"].astype(U) + U(1)))
    return core.view(np.int64), twin.of(p["a"], p["b"]).view(np.int64), whole.view(np.int64)


def first_of(doc: np.ndarray, start: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Marks the first occurrence of a segment within its document."""
    order = np.lexsort((start, seg, doc))
    repeat = np.zeros(len(doc), bool)
    repeat[order[1:]] = (doc[order][1:] == doc[order][:-1]) & (seg[order][1:] == seg[order][:-1])
    return ~repeat


def texts(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a batch of about ``limit`` bytes of text: first and last row, the bytes, and where each row's text ends."""
    array = batch.column(column).cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


OCCURRENCE = "id long, tkey long, core long, seg long, start long, windows int, offset int, first boolean"


def occurrences(docs: DataFrame, symbols: Callable, n: int, k: int, width: int) -> DataFrame:
    """All segments of docs (id, tkey, text), OCCURRENCE. symbols: bytes, text ends -> symbols, symbol ends."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tkeys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, _, raw, ends in texts(batch, 2):
                own, stops = symbols(raw, ends)
                sums, twin = Sums(own), Sums(own, 1)
                heads, count, anchor, doc = runs(sums, stops, n, k)
                p = split(heads, count, anchor, n, k, width)
                core, _, seg = hashed(p, sums, twin, n)
                doc = doc[p["run"]]
                start = p["start"] - np.concatenate(([0], stops[:-1]))[doc]
                yield pa.record_batch(
                    [pa.array(x) for x in (ids[doc + first], tkeys[doc + first], core, seg, start, p["windows"].astype(np.int32), p["offset"].astype(np.int32), first_of(doc, start, seg))],
                    names=["id", "tkey", "core", "seg", "start", "windows", "offset", "first"],
                )

    return docs.mapInArrow(found, OCCURRENCE)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, tkey, text) of each row; the key of a repeated row is that of the row it repeats."""
    own = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key, tkey = doc_key(F.col("i"), F.col("text"))
    return own.select(key.alias("id"), tkey.alias("tkey"), "text")


def repeats(occ: DataFrame, both_ways: bool, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What exact copies tell, and what is left for an index. ``keys`` name a core. ``occ``, a written table, is read and discarded.

    Returns (id, tkey, start, windows) of copies whose windows are all removed, and the one occurrence that stands for each
    distinct segment of a core with several. Of equal segments the first (in the document of the smallest id, earliest there)
    stays; with ``both_ways`` none does.
    """
    groups = occ.groupBy(*keys).agg(F.min("seg").alias("s0"), F.max("seg").alias("s1"), F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
    groups = materialise(groups, "core-counts")  # so that the join has exchanges of its own, whose hot partitions can be split
    hits = occ.join(groups.select(*keys, (F.col("s0") == F.col("s1")).alias("single"), "least"), keys)
    hits = materialise(hits, "repeated-cores")
    discard(groups, occ)
    later = F.lit(True) if both_ways else ((F.col("id") != F.col("least")) | ~F.col("first"))
    gone = hits.where("single").where(later).select("id", "tkey", "start", "windows")
    several = hits.where("not single").drop("least", "single")
    distinct = several.groupBy(*keys, "seg").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    distinct = materialise(distinct, "distinct-segments")
    marked = materialise(several.join(distinct, [*keys, "seg"]), "several")
    discard(distinct)
    again = marked.where("n > 1").where(later).select("id", "tkey", "start", "windows")
    alone = marked.where((F.col("id") == F.col("least")) & F.col("first"))
    return gone.unionByName(again), alone.select(*occ.columns)


CONTENT = OCCURRENCE + ", twin long, span int, left binary, right binary"


def refine(docs: DataFrame, wanted: DataFrame, symbols: Callable, cut: Callable, n: int, k: int, width: int) -> DataFrame:
    """Wanted segments split into narrower classes, with what lies about their cores: CONTENT.

    ``span`` is how many symbols a window has beside the core. cut: bytes of texts, symbols, places -> the content of each place.
    """
    lists = wanted.groupBy("id", "tkey").agg(F.collect_set(F.struct("start", "windows", "offset")).alias("at"))  # bounded by a document's length; repeated rows give one
    joined = docs.join(lists, ["id", "tkey"]).dropDuplicates(["id", "tkey"])

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tkeys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tkey"))
            for first, last, raw, ends in texts(batch, batch.schema.get_field_index("text")):
                own, stops = symbols(raw, ends)
                begins = np.concatenate(([0], stops[:-1]))
                at = batch.column("at").slice(first, last - first)
                doc = np.repeat(np.arange(last - first), at.value_lengths().to_numpy())
                flat = at.flatten()
                start, windows, offset = (flat.field(c).to_numpy() for c in ("start", "windows", "offset"))
                heads = start + begins[doc]
                p = split(heads, windows.astype(np.int64), heads + offset, n, k, width)
                core, other, seg = hashed(p, Sums(own), Sums(own, 1), n)
                doc = doc[p["run"]]
                inside = p["start"] - begins[doc]
                left, right = cut(raw, own, p["start"], p["a"]), cut(raw, own, p["b"], p["start"] + p["windows"] - 1 + n)
                span = n - (p["b"] - p["a"])
                columns = (ids[doc + first], tkeys[doc + first], core, seg, inside, p["windows"].astype(np.int32), p["offset"].astype(np.int32), first_of(doc, inside, seg), other, span.astype(np.int32))
                made = pa.record_batch([*[pa.array(x) for x in columns], pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=[f.split()[0] for f in CONTENT.split(", ")])
                for i in range(0, made.num_rows, 20_000):
                    yield made.slice(i, 20_000)

    return joined.select("id", "tkey", "text", "at").mapInArrow(content, CONTENT)


GONE = "id long, tkey long, start long, windows int"


def search(content: DataFrame, found: Callable, *, both_ways: bool, unit: int, width: int, hot: int, shard_symbols: int) -> DataFrame:
    """Windows that repeat between distinct segments of one core (GONE), by an index per shard.

    ``found`` gets a shard's rows as arrays (core, twin, id, tkey, start, windows, span, left, right) and returns per row which
    windows go. A core is whole in its shard. A core whose segments hold more than ``hot`` symbols would overfill a shard: its
    segments are refined down to single windows, of which there are only copies, and these are counted.
    """
    content = materialise(content, "contents")
    symbols = ((F.octet_length("left") + F.octet_length("right")) / unit + 2).cast("long")
    large = materialise(content.groupBy("core", "twin").agg(F.sum(symbols).alias("symbols")).where(F.col("symbols") > hot).select("core", "twin"), "hot-cores")
    usual, frequent = content.join(large, ["core", "twin"], "left_anti"), content.join(large, ["core", "twin"], "left_semi")
    total = usual.agg(F.sum(symbols)).first()[0] or 0
    shards = total // shard_symbols + 1

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partitions come in the order of their shards."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column("shard").to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1, [len(number)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column("shard")[0].as_py() != number[a]:
                    yield indexed(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield indexed(held)

    def indexed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        own = {c: table.column(c).to_numpy() for c in ("core", "twin", "id", "tkey", "start", "windows", "span")}
        own |= {c: table.column(c).to_pylist() for c in ("left", "right")}
        return _runs(own, found(own))

    partitions = int(max(width, min(shards, 4 * width)))
    columns = ["core", "twin", "id", "tkey", "start", "windows", "span", "left", "right"]
    dealt = usual.withColumn("shard", F.pmod(F.xxhash64("core", "twin"), F.lit(shards))).repartitionById(partitions, (F.col("shard") % partitions).cast("int")).sortWithinPartitions("shard", "core", "id", "start", "tkey")
    out = dealt.select("shard", *columns).mapInArrow(shard, GONE)
    if large.isEmpty():
        return out
    keys = ["core", "twin", "place", "h0", "h1"]
    alone = materialise(frequent.mapInArrow(_windows(unit), "core long, twin long, place int, h0 long, h1 long, id long, tkey long, start long"), "hot-windows")
    least = materialise(alone.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("id", "start")).alias("least")).where("n > 1"), "hot-copies")
    again = alone.join(least, keys)
    if not both_ways:
        again = again.where((F.col("id") != F.col("least.id")) | (F.col("start") != F.col("least.start")))
    return out.unionByName(again.select("id", "tkey", "start", F.lit(1).alias("windows")))


def about(own: dict, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all contents, left and right parts by turns; how many the parts have; each part a piece of the first array."""
    parts = [x for pair in zip(own["left"], own["right"], strict=True) for x in pair]
    symbols = np.frombuffer(b"".join(parts), np.uint8 if unit == 1 else U)
    sizes = np.array([len(x) // unit for x in parts], np.int64).reshape(-1, 2)
    return symbols, sizes[:, 0], sizes[:, 1]


def contracted(own: dict, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard as one text of small integers: left part, core as one symbol, right part, 1, and so on; 0 at the end.

    Returns the text; of each window its row, where it begins, and how many symbols it has.
    """
    symbols, left, right = about(own, unit)
    named, names = (symbols.astype(np.int64), 256) if unit == 1 else ((u := np.unique(symbols, return_inverse=True))[1], len(u[0]))
    cores = np.unique(np.stack((own["core"], own["twin"]), axis=1), axis=0, return_inverse=True)[1].ravel()
    rows = len(left)
    begin = np.concatenate(([0], np.cumsum(left + right + 2)))
    text = np.ones(int(begin[-1]) + 1, np.int64)
    text[-1] = 0
    at = np.arange(len(symbols)) + np.repeat(np.stack((2 * np.arange(rows), 2 * np.arange(rows) + 1), axis=1).ravel(), np.stack((left, right), axis=1).ravel())
    text[at] = named + 2
    text[begin[:-1] + left] = cores + names + 2
    windows = own["windows"].astype(np.int64)
    row = np.repeat(np.arange(rows), windows)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    return text, row, begin[row] + inside, own["span"].astype(np.int64)[row] + 1


def _windows(unit: int):
    """Each window of each content alone: the core, the window's place about it, and hashes of the symbols to both sides."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(c).to_numpy() for c in ("core", "twin", "id", "tkey", "start", "windows", "span")}
            own |= {c: batch.column(c).to_pylist() for c in ("left", "right")}
            symbols, left, right = about(own, unit)
            symbols = byte_symbols(symbols) if unit == 1 else symbols
            begin = np.concatenate(([0], np.cumsum(left + right)))[:-1]
            windows = own["windows"].astype(np.int64)
            row = np.repeat(np.arange(len(left)), windows)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            hashes = [Sums(symbols, family).of(begin[row] + inside, begin[row] + inside + own["span"][row]).view(np.int64) for family in (0, 1)]
            place = (left[row] - inside).astype(np.int32)
            yield pa.record_batch(
                [pa.array(x) for x in (own["core"][row], own["twin"][row], place, *hashes, own["id"][row], own["tkey"][row], own["start"][row] + inside)],
                names=["core", "twin", "place", "h0", "h1", "id", "tkey", "start"],
            )

    return spread


def _runs(own: dict, gone: np.ndarray) -> pa.RecordBatch:
    """gone: a flag for each window of each row, one after another; as runs in the document."""
    row = np.repeat(np.arange(len(own["windows"])), own["windows"])
    at = np.arange(len(row)) - np.repeat(np.cumsum(own["windows"]) - own["windows"], own["windows"])
    head = gone & ~np.concatenate(([False], gone[:-1] & (row[1:] == row[:-1])))
    tail = gone & ~np.concatenate((gone[1:] & (row[1:] == row[:-1]), [False]))
    h, t = np.flatnonzero(head), np.flatnonzero(tail)
    r = row[h]
    return pa.record_batch([pa.array(own["id"][r]), pa.array(own["tkey"][r]), pa.array(own["start"][r] + at[h]), pa.array((t - h + 1).astype(np.int32))], names=["id", "tkey", "start", "windows"])


def repeated(docs: DataFrame, *, symbols: Callable, cut: Callable, found: Callable, both_ways: bool, unit: int, n: int, k: int, coarse: int, fine: int, width: int, hot: int, shard_symbols: int) -> DataFrame:
    """All windows of docs (id, tkey, text) that go, as runs (GONE)."""
    occ = materialise(occurrences(docs, symbols, n, k, coarse), "occurrences")
    whole, alone = repeats(occ, both_ways, ["core"])
    narrow = materialise(refine(docs, alone, symbols, cut, n, k, fine), "refined")
    parts, alone = repeats(narrow, both_ways, ["core", "twin"])
    inside = search(alone, found, both_ways=both_ways, unit=unit, width=width, hot=hot, shard_symbols=shard_symbols)
    return whole.unionByName(parts).unionByName(inside)


def covered(starts: np.ndarray, windows: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of a document's ``size`` symbols lie in a removed window."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + windows - 1 + n, -1)
    return np.cumsum(edges[:-1]) > 0


def with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) with the removed windows of each: doc_id, text, at (the columns of ``gone`` but the keys)."""
    own = docs.select("doc_id", "text", *[c.alias(a) for c, a in zip(doc_key(F.col("doc_id"), F.coalesce("text", F.lit(""))), ("id", "tkey"), strict=True)])
    lists = gone.groupBy("id", "tkey").agg(F.collect_list(F.struct(*[c for c in gone.columns if c not in ("id", "tkey")])).alias("at"))  # bounded by a document's length
    return own.join(lists, ["id", "tkey"], "left").select("doc_id", "text", "at")
