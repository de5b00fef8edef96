"""Grounding: where quotes stand in texts, exactly, in normal form, or nearly; and whether cited offsets hold."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import vocab


def mentions(items: DataFrame, texts: DataFrame, *, normalised: bool = False, least: int = vocab.MIN_QUOTE, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, quote_id, start, end, times): where a quote of at least ``least`` characters stands first in a text, and how often.

    ``normalised`` compares normal forms; places are those of the text as it is. Each text is scanned once. The quotes go to the
    tasks as one automaton of at most ``most_bytes``, checked here; more of them are scanned part by part. Texts come to Python by
    the hundred, not in batches of Arrow: those hold 10,000 rows, however long.
    """
    found = None
    for rows in _parts(items, least, most_bytes):
        seen = F.udf(_scan(rows, normalised), "array<struct<quote_id: long, start: int, end: int, times: long>>", useArrow=False)
        one = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(seen("text")).alias("m")).select("doc_id", "m.*")
        found = one if found is None else found.unionByName(one)
    return found


def _parts(items: DataFrame, least: int, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    long = items.where(F.length("quote") >= least).select(F.col("quote_id").cast("long").alias("quote_id"), "quote")
    total = long.agg(F.sum(F.octet_length("quote") + 64)).first()[0] or 0
    parts = total // most_bytes + 1
    for part in range(parts):
        yield [tuple(r) for r in long.where(F.pmod(F.xxhash64("quote"), F.lit(parts)) == part).toLocalIterator()]


def _scan(rows: list[tuple[int, str]], normalised: bool):
    ids: dict[str, list[int]] = {}
    automata = []

    def scan(text: str | None) -> list[tuple[int, int, int, int]]:
        if not automata:  # once a task
            import ahocorasick

            for quote_id, quote in rows:
                if wanted := normal(quote)[0] if normalised else quote:
                    ids.setdefault(wanted, []).append(quote_id)
            automata.append(ahocorasick.Automaton())
            for wanted in ids:
                automata[0].add_word(wanted, wanted)
            if ids:
                automata[0].make_automaton()
        plain, at = normal(text) if normalised and text else (text, None)
        seen: dict[str, list[int]] = {}
        if ids and plain:
            for last, wanted in automata[0].iter(plain):
                seen.setdefault(wanted, [last - len(wanted) + 1, 0])[1] += 1
        places = {w: (first, first + len(w)) if at is None else _original(at, first, len(w)) for w, (first, _) in seen.items()}
        return [(i, *places[w], times) for w, (_, times) in seen.items() for i in ids[w]]

    return scan


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@lru_cache(maxsize=65_536)
def _form(character: str) -> str:
    return unicodedata.normalize("NFKC", vocab.PLAIN_SIGNS.get(character, character))


#: Characters below it are looked up; those of most texts are.
_COMMON = 0x3000


@lru_cache(maxsize=1)
def _singles() -> np.ndarray:
    """The form of each common character, white space as a blank; -1 where it has more than one character or none."""
    forms = [_form(chr(c)) for c in range(_COMMON)]
    return np.array([-1 if len(f) != 1 else 0x20 if f.isspace() else ord(f) for f in forms], np.int64)


def _spread(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forms of characters, white space as blanks, and the ordinal of the character that each is of."""
    if not len(codes):
        return codes, codes
    if codes.max() < _COMMON and (out := _singles()[codes]).min() >= 0:
        return out, np.arange(len(codes))
    codes, inverse = np.unique(codes, return_inverse=True)
    forms = [_form(chr(c)) if not 0xD800 <= c < 0xE000 else "\ufffd" for c in codes.tolist()]
    sizes = np.array([len(f) for f in forms], np.int64)
    flat = _codes("".join(forms))
    at = np.repeat(np.arange(len(inverse)), sizes[inverse])
    inside = np.arange(len(at)) - np.repeat(np.cumsum(sizes[inverse]) - sizes[inverse], sizes[inverse])
    out = flat[(np.cumsum(sizes) - sizes)[inverse][at] + inside]
    return np.where(np.isin(out, [c for c in set(flat.tolist()) if chr(c).isspace()]), 0x20, out), at


def normal(text: str) -> tuple[str, np.ndarray]:
    """The text in plain signs and compatibility forms with white space collapsed, and the place in the text of each of its characters."""
    out, at = _spread(_codes(text))
    blank = out == 0x20
    kept = ~(blank & np.concatenate(([True], blank[:-1]))) if len(out) else blank
    out, at = out[kept], at[kept]
    if len(out) and out[-1] == 0x20:
        out, at = out[:-1], at[:-1]
    return out.astype("<u4").tobytes().decode("utf-32-le", "replace"), at


def _original(at: np.ndarray, first: int, size: int) -> tuple[int, int]:
    """[start, end) in the text of ``size`` characters of its normal form from ``first`` on."""
    return int(at[first]), int(at[min(first + size, len(at)) - 1]) + 1


def normal_find(quote: str, text: str) -> tuple[int, int, bool] | None:
    """Where the normal form of a quote stands in that of a text, as [start, end) of the text, and whether it stands there again."""
    wanted, (plain, at) = normal(quote)[0], normal(text)
    first = plain.find(wanted) if wanted else -1
    return None if first < 0 else (*_original(at, first, len(wanted)), plain.find(wanted, first + 1) >= 0)


def in_span(quote: str, span: str) -> tuple[int, int] | None:
    """Where a quote stands within the one span it cites: all of it, or once in normal form. Nothing else is searched."""
    if quote == span:
        return 0, len(span)
    found = normal_find(quote, span)
    return found[:2] if found and not found[2] else None


def fuzzy_find(quote: str, text: str, least: float = vocab.FUZZY_RATIO) -> tuple[int, int, float, bool] | None:
    """The best window of the quote's length by difflib's ratio over normal forms, on a step of an eighth of it; none under ``least``.

    Its ends are then moved by a few characters of the text where that fits better. The last field says that another window, apart
    from the first, reaches the ratio as well, so that the quote has no one place.
    """
    wanted, (plain, at) = normal(quote)[0], normal(text)
    size = len(wanted)
    if not size or not plain:
        return None
    matcher = difflib.SequenceMatcher(None, autojunk=False)
    matcher.set_seq2(wanted)
    codes, starts = _codes(wanted), np.arange(0, max(1, len(plain) - size + 1), max(1, size // 8))
    letters = np.unique(codes)
    masks, padded = _masks(codes, letters), np.concatenate((_places(letters, _codes(plain)), np.full(size, len(letters))))

    @cache
    def ratio(window: str) -> float:
        matcher.set_seq1(window)
        return matcher.ratio()

    # difflib is slow: it is asked only where it may reach the ratio, and where that may matter.
    common = np.concatenate([common_lengths(masks, size, padded[starts[a : a + 2048, None] + np.arange(size)]) for a in range(0, len(starts), 2048)])
    bounds = 2.0 * common / (size + min(size, len(plain)))
    fits = bounds >= least - 1e-9
    hits, bounds = starts[fits].tolist(), bounds[fits].tolist()
    of = lambda start: ratio(plain[start : start + size])
    best = _first_best(hits, bounds, of)
    if best is None or of(best) < least:
        return None
    again = hits[-1] - hits[0] >= size and next(s for s in reversed(hits) if of(s) >= least) - next(s for s in hits if of(s) >= least) >= size
    start, end = _original(at, best, size)
    windows = [(start, end)] + [(s, e) for d in vocab.REPAIR_STEPS for s in (max(0, start - d), start) for e in (min(len(text), end + d), end)]
    forms = {(s, e): normal(text[s:e])[0] for s, e in windows}
    lanes = np.full((len(forms), max(map(len, forms.values()))), len(letters))
    for lane, form in zip(lanes, forms.values(), strict=True):
        lane[: len(form)] = _places(letters, _codes(form))
    bounds = [2.0 * m / (size + len(form)) for m, form in zip(common_lengths(masks, size, lanes).tolist(), forms.values(), strict=True)]
    start, end = _first_best(list(forms), bounds, lambda window: ratio(forms[window]))
    return start, end, ratio(forms[start, end]), again


def _first_best(options: list, bounds: list[float], value: Callable):
    """The first of the options with the greatest value, which is at most the bound of each; it is worked out only for those that may be it."""
    best = None
    for bound, k in sorted(zip((-b for b in bounds), range(len(bounds)), strict=True)):
        if best is None or (bound, k) < best:
            best = min(best or (0.0, len(options)), (-value(options[k]), k))
    return None if best is None else options[best[1]]


#: Bits of a limb; the one above takes the carry.
_LIMB = 63
#: So few sequences are compared one by one.
_FEW = 64


def _grams(codes: np.ndarray) -> np.ndarray:
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def common_lengths(masks: np.ndarray, size: int, lanes: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of a sequence of ``size`` symbols and each row of ``lanes``; masks: symbol -> limbs of the places where the sequence has it."""
    if len(lanes) < _FEW:
        whole, every = [sum(int(limb) << (_LIMB * k) for k, limb in enumerate(limbs)) for limbs in masks], (1 << size) - 1
        return np.array([size - reduce(lambda row, c: ((row + (row & whole[c])) | (row & ~whole[c])) & every, lane, every).bit_count() for lane in lanes.tolist()], np.int64)
    full, top = np.uint64((1 << _LIMB) - 1), np.uint64(_LIMB)
    rows = [np.full(len(lanes), full) for _ in range(masks.shape[1])]
    columns, limbs = np.ascontiguousarray(lanes.T), np.ascontiguousarray(masks.T)
    both, total, carry = (np.empty(len(lanes), np.uint64) for _ in range(3))
    for symbols in columns:
        carry[:] = 0
        for limb, row in zip(limbs, rows, strict=True):
            np.bitwise_and(np.take(limb, symbols, out=both, mode="clip"), row, out=both)
            np.add(np.add(row, both, out=total), carry, out=total)
            np.right_shift(total, top, out=carry)
            np.bitwise_and(total, full, out=total)
            np.bitwise_or(np.bitwise_xor(row, both, out=row), total, out=row)
    held = sum(np.bitwise_count(row).astype(np.int64) for row in rows)
    return len(rows) * _LIMB - held


#: Characters of a text that are aligned as one word of bits.
_BLOCK = 16
#: Blocks that are aligned side by side, so that their words stay in a core's cache.
_LANES = 32_768


def block_costs(blocks: np.ndarray, quote: np.ndarray) -> np.ndarray:
    """The least edit distance of each block of 16 symbols and any stretch of the quote: Myers' bit vectors, a block a word."""
    symbols, order = np.unique(quote, return_inverse=True)
    out = np.empty(len(blocks), np.int64)
    for some, into in zip(*(np.array_split(x, -(-len(blocks) // _LANES)) for x in (blocks, out)), strict=True) if len(blocks) else ():
        has = [np.packbits(some.ravel() == s, bitorder="little").view("<u2") for s in symbols]
        up, down = np.full(len(some), 0xFFFF, np.uint16), np.zeros(len(some), np.uint16)
        score, best = np.full(len(some), _BLOCK, np.int16), np.full(len(some), _BLOCK, np.int16)
        diagonal, right, left = (np.empty(len(some), np.uint16) for _ in range(3))
        last = right.view(np.int16), left.view(np.int16), np.empty(len(some), np.int16)
        for k in order.tolist():
            np.bitwise_and(has[k], up, out=diagonal)
            np.add(diagonal, up, out=diagonal)
            np.bitwise_xor(diagonal, up, out=diagonal)
            np.bitwise_or(diagonal, has[k], out=diagonal)
            np.bitwise_or(diagonal, down, out=diagonal)
            np.bitwise_or(diagonal, up, out=right)
            np.invert(right, out=right)
            np.bitwise_or(right, down, out=right)
            np.bitwise_and(diagonal, up, out=left)
            np.right_shift(last[0], 15, out=last[2])  # -1 where the last row grows
            np.subtract(score, last[2], out=score)
            np.right_shift(last[1], 15, out=last[2])
            np.add(score, last[2], out=score)
            np.minimum(best, score, out=best)
            np.add(right, right, out=right)
            np.add(left, left, out=left)
            np.bitwise_or(diagonal, right, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, left, out=up)
            np.bitwise_and(diagonal, right, out=down)
        into[:] = best
    return out


def _masks(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """symbol -> limbs of the places where the sequence has it, for ``common_lengths``; the last row is that of other symbols."""
    masks, at = np.zeros((len(letters) + 1, -(-len(codes) // _LIMB)), np.uint64), np.arange(len(codes))
    np.bitwise_or.at(masks, (np.searchsorted(letters, codes), at // _LIMB), np.uint64(1) << (at % _LIMB).astype(np.uint64))
    return masks


def _places(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The place of each value among the known ones, theirs being sorted; the number of these for others."""
    at = np.searchsorted(known, found)
    return np.where((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == found), at, len(known)) if len(known) else at


class Chunks:
    """What chunks of a few symbols cost at least in each of some quotes: the least number of insertions and deletions that turn any stretch of the quote into the chunk.

    Texts repeat short chunks, so each is worked out once, for all quotes together. A bit is a quote; for every place of the quotes
    and every cost there is a word that says in which of them the chunk so far can end there at that cost. Chunks that begin alike
    share their steps.
    """

    #: Symbols of a chunk, if their places among the letters fit a word.
    SIZE = 6
    #: Costs are told apart up to this one; what costs more counts as one more.
    MOST = 2
    #: Chunks whose steps are taken at once.
    TURN = 512
    #: One chunk of a text in so many may be taken with any symbol at its end.
    RARE = 5

    def __init__(self, quotes: list[np.ndarray], letters: int, room: int):
        self.any, self.bits = letters + 1, (letters + 1).bit_length()
        self.size, self.room = min(self.SIZE, 63 // self.bits), room
        self.masks = []
        for a in range(0, len(quotes), 64):
            some = quotes[a : a + 64]
            mask = np.zeros((letters + 2, max(map(len, some))), np.uint64)
            mask[self.any] = ~np.uint64(0)
            for k, quote in enumerate(some):
                mask[quote, np.arange(len(quote))] |= np.uint64(1 << k)
            self.masks.append(mask)
        self.known, self.column, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(quotes), 0), np.uint8)

    def keys(self, text: np.ndarray) -> np.ndarray:
        """The chunks of a text of so many whole ones, a number each."""
        return reduce(lambda key, symbols: (key << self.bits) | symbols, text.reshape(-1, self.size).T.astype(np.int64))

    def costs(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """At most what each of the chunks costs, which are in order and stand so many times: a row for each quote, a column for each chunk.

        One that is new and stands once is taken with any symbol at its end, so that others share it; unless there are many of these,
        as then too few windows could be ruled out.
        """
        rare = (times == 1) & (_places(self.known, keys) == len(self.known))
        rare &= self.RARE * np.count_nonzero(rare) < times.sum()
        keys, back = np.unique(np.where(rare, (keys >> self.bits << self.bits) | self.any, keys), return_inverse=True)
        at = _places(self.known, keys)
        new = keys[at == len(self.known)]
        if len(self.known) + len(new) > self.room:  # those that the texts don't hold now are forgotten
            at = at[at < len(self.known)]
            self.known, self.held = self.known[at], np.take(self.held, self.column[at], axis=1)
            self.column = np.arange(len(at))
        if len(new):
            many, known = len(self.known), np.concatenate((self.known, new))
            if len(known) > self.held.shape[1]:
                wider = np.empty((len(self.held), max(len(known), min(len(known) * 5 // 4, self.room))), np.uint8)
                wider[:, :many] = self.held[:, :many]
                self.held = wider
            for a in range(0, len(new), 65_536):
                some = new[a : a + 65_536]
                self.held[:, many + a : many + a + len(some)] = self._work_out(some)
            order = np.argsort(known, kind="stable")
            self.known, self.column = known[order], np.concatenate((self.column, np.arange(many, len(known))))[order]
        return np.take(self.held, self.column[np.searchsorted(self.known, keys)][back], axis=1)

    def _work_out(self, keys: np.ndarray) -> np.ndarray:
        chunks = np.stack([(keys >> (self.bits * k)) & ((1 << self.bits) - 1) for k in reversed(range(self.size))], axis=1)
        new = np.ones(chunks.shape, bool)
        np.logical_or.accumulate(chunks[1:] != chunks[:-1], axis=1, out=new[1:])
        ends = np.empty((self.MOST + 1, len(chunks), len(self.masks)), np.uint64)
        for k, mask in enumerate(self.masks):
            turn = max(1, min(self.TURN, (1 << 18) // mask.shape[1]))
            for a in range(0, len(chunks), turn):
                fresh = new[a : a + turn].copy()
                fresh[0] = True
                ends[:, a : a + turn, k] = self._ends(chunks[a : a + turn], fresh, mask)
        costs = np.full((len(self.masks) * 64, len(chunks)), self.MOST + 1, np.uint8)
        for end in ends:
            costs -= np.unpackbits(end.astype("<u8").view(np.uint8), axis=1, bitorder="little").T
        return costs[: len(self.held)]

    def _ends(self, chunks: np.ndarray, fresh: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
        """In which quotes each chunk costs 0, at most 1 and so on; fresh: which symbols don't begin as the chunk before."""
        rows, node = [np.full((1, mask.shape[1] + 1), ~np.uint64(0))] * (self.MOST + 1), np.zeros(len(chunks), np.int64)
        for k in range(self.size - 1):
            at = np.flatnonzero(fresh[:, k])
            has, before, rows = mask[chunks[at, k]], [row[node[at]] for row in rows], []
            for d, row in enumerate(before):
                end = np.empty_like(row)
                end[:, 0] = before[d - 1][:, 0] if d else 0
                inner = np.bitwise_and(row[:, :-1], has, out=end[:, 1:])
                if d:  # a symbol of the chunk is left out, or one of the quote
                    np.bitwise_or(inner, before[d - 1][:, 1:], out=inner)
                    np.bitwise_or(inner, rows[-1][:, :-1], out=inner)
                rows.append(end)
            node = np.cumsum(fresh[:, k]) - 1
        # Of the last symbol it doesn't matter where it ends.
        has, out = mask[chunks[:, -1]], []
        for d, row in enumerate(rows):
            end = row[node, :-1]
            out.append(np.bitwise_or.reduce(np.bitwise_and(end, has, out=end), axis=1))
            if d:
                out[d] |= out[d - 1] | np.bitwise_or.reduce(rows[d - 1], axis=1)[node]
        return out


class Near:
    """Which quotes can nearly stand in which texts: a necessary condition for ``fuzzy_find``, so that no pair is lost.

    A ratio r over a window of w characters and a quote of n takes m = r(n + w)/2 matched characters. Then n + w - 2m insertions and
    deletions turn the quote into the window, and what they cost falls to the window's chunks, each of which costs at least what
    turns the nearest stretch of the quote into it: so the sum over the chunks inside a window is at most n + w - 2m. Unlike texts
    cost a fifth to a half more. Where that leaves many windows, as of long quotes, blocks of 16 characters are aligned likewise.
    Last, m is at most the longest common subsequence of the window itself.
    """

    #: Quotes whose chunks are worked out at once.
    GROUP = 256
    #: Bytes of chunks that are kept for the texts to come, a byte a quote.
    ROOM = 128 << 20
    #: More windows than these are told apart by their blocks.
    MANY = 4096

    def __init__(self, quotes: list[str], least: float = vocab.FUZZY_RATIO):
        self.least = least
        # Quotes of one word of bits are nearly as long as each other.
        plain = sorted(((q, _codes(normal(quote)[0])) for q, quote in enumerate(quotes)), key=lambda x: len(x[1]))
        self.empty, plain = [q for q, codes in plain if not len(codes)], [x for x in plain if len(x[1])]
        self.groups = []
        for a in range(0, len(plain), self.GROUP):
            some = plain[a : a + self.GROUP]
            letters = np.unique(np.concatenate([c for _, c in some]))
            placed = [(q, np.searchsorted(letters, codes)) for q, codes in some]
            self.groups.append((letters, Chunks([c for _, c in placed], len(letters), self.ROOM // len(plain)), placed))

    def pairs(self, texts: list[str]) -> list[tuple[int, int]]:
        """(ordinal of the text, ordinal of the quote)."""
        own = [_codes(normal(text)[0]) for text in texts]
        found = [(t, q) for q in self.empty for t in range(len(texts))]
        for letters, chunks, quotes in self.groups:
            found += self._group(letters, chunks, quotes, own)
        return sorted(found, key=lambda x: (x[1], x[0]))

    def _group(self, letters: np.ndarray, chunks: Chunks, quotes: list[tuple[int, np.ndarray]], own: list[np.ndarray]) -> list[tuple[int, int]]:
        size, other, longest = np.array([len(codes) for codes in own], np.int64), len(letters), max(len(quote) for _, quote in quotes)
        # All texts one after the other, each filled up to whole chunks and blocks.
        unit = int(np.lcm(_BLOCK, chunks.size))
        held = -(-size // unit) * unit
        base, total = np.cumsum(held) - held, int(held.sum())
        if not total:
            return []
        place = np.full(0x110000, other, np.int32)
        place[letters] = np.arange(other)
        text = np.full(total + longest, other, np.int32)
        for at, codes in zip(base.tolist(), own, strict=True):
            text[at : at + len(codes)] = place[codes]
        keys, chunk, times = np.unique(chunks.keys(text[:total]), return_inverse=True, return_counts=True)
        owner, sums = np.repeat(np.arange(len(own)), held // chunks.size), np.zeros(len(chunk) + 1, np.uint32)
        windows = []
        for k, (cost, (_, quote)) in enumerate(zip(chunks.costs(keys, times), quotes, strict=True)):
            np.cumsum(cost[chunk], dtype=np.uint32, out=sums[1:])
            t, start = self._windows(len(quote), chunks.size, sums, owner, base, size)
            if len(t) > self.MANY:
                fits = self._aligned(quote, text[:total].reshape(-1, _BLOCK), base[t] + start, np.minimum(len(quote), size[t]))
                t, start = t[fits], start[fits]
            windows.append((np.full(len(t), k), t, start))
        return self._common(quotes, other, text, base, size, *map(np.concatenate, zip(*windows, strict=True)))

    def _windows(self, n: int, chunk: int, sums: np.ndarray, owner: np.ndarray, base: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that may reach the ratio by their chunks: the text of each, and its start there."""
        step, inside, most = max(1, n // 8), max(0, n // chunk - 1), np.uint32(2 * n * (1 - self.least) + 1e-6)
        after = sums[1:]
        at = np.flatnonzero(after[inside:] - after[: len(after) - inside] <= most)
        t = owner[at]
        first = at * chunk - base[t]
        starts = -(-first // step)[:, None] * step + np.arange(0, chunk, step)
        row, column = np.nonzero((starts < first[:, None] + chunk) & (starts <= (size[t] - n)[:, None]))
        t, start = t[row], starts[row, column]
        place = base[t] + start
        good = sums[(place + n) // chunk] - sums[np.minimum(-(-place // chunk), (place + n) // chunk)] <= most
        # Texts shorter than the quote are one window.
        short = np.flatnonzero((size < n) & (size > 0))
        from_, upto = base[short] // chunk, (base[short] + size[short]) // chunk
        short = short[sums[upto] - sums[from_] <= (n + size[short]) * (1 - self.least) + 1e-6]
        return np.concatenate((t[good], short)), np.concatenate((start[good], np.zeros(len(short), np.int64)))

    def _aligned(self, quote: np.ndarray, blocks: np.ndarray, start: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which windows may reach the ratio by the blocks inside them."""
        inner = -(-start // _BLOCK)[:, None] + np.arange(max(1, len(quote) // _BLOCK))
        whole, fits, cost = (inner + 1) * _BLOCK <= (start + window)[:, None], np.ones(len(start), bool), np.zeros(len(start))
        # Three quarters of the blocks are nearly always enough to rule a window out.
        for last in (False, True):
            row, column = np.nonzero(whole & fits[:, None] & ((inner % 4 == 3) == last))
            used, at = np.unique(inner[row, column], return_inverse=True)
            cost += np.bincount(row, weights=block_costs(blocks[used], quote)[at], minlength=len(start))
            fits &= cost <= (len(quote) + window) * (1 - self.least) + 1e-6
        return fits

    def _common(self, quotes, other: int, text: np.ndarray, base: np.ndarray, size: np.ndarray, k: np.ndarray, t: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
        """Those of the windows with so long a common subsequence that the ratio may be reached, of all quotes together: a quote's symbols are its own."""
        found, n = set(), np.array([len(quote) for _, quote in quotes], np.int64)
        for a in range(0, len(k), 8192):
            own, at, here = k[a : a + 8192], t[a : a + 8192], np.arange(n[k[a : a + 8192]].max())
            low, window = own[0], np.minimum(n[own], size[at])
            limbs = [_masks(quotes[i][1], np.arange(other)) for i in range(low, own[-1] + 1)]
            masks = np.concatenate([np.pad(m, ((0, 0), (0, -(-len(here) // _LIMB) - m.shape[1]))) for m in limbs])
            lanes = np.where(here < window[:, None], text[(base[at] + start[a : a + 8192])[:, None] + here], other) + ((own - low) * (other + 1))[:, None]
            fits = common_lengths(masks, len(here), lanes) >= (n[own] + window) * self.least / 2 - 1e-6
            found.update(zip(at[fits].tolist(), own[fits].tolist(), strict=True))
        return [(t, quotes[i][0]) for t, i in found]


def near(items: DataFrame, texts: DataFrame, *, least: int = vocab.MIN_QUOTE, most_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, quote_id, quote, text): every pair in which a quote of at least ``least`` characters can stand, exactly or nearly; in parts as ``mentions``.

    The work lies in the tasks, so texts are dealt out anew: a file may hold very many of them in one stretch.
    """
    spark, found = texts.sparkSession, None
    dealt = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    for rows in _parts(items, least, most_bytes):
        one = dealt.mapInPandas(_near(rows), "doc_id long, quote_id long, quote string, text string")
        found = one if found is None else found.unionByName(one)
    return found


@lru_cache(maxsize=1)
def _index(quotes: tuple[str, ...]) -> Near:
    """Kept from task to task of a worker, as its chunks are."""
    return Near(list(quotes))


def _near(rows: list[tuple[int, str]]):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quotes = sorted({q for _, q in rows})
        ids: dict[str, list[int]] = {}
        for quote_id, quote in rows:
            ids.setdefault(quote, []).append(quote_id)
        index = _index(tuple(quotes))
        for frame in batches:
            frame = frame[frame.text.notna() & (frame.text != "")]
            size = frame.text.str.len().cumsum() // (1 << 22)
            for _, some in frame.groupby(size):
                docs, texts = some.doc_id.tolist(), some.text.tolist()
                out = [(docs[t], i, quotes[q], texts[t]) for t, q in index.pairs(texts) for i in ids[quotes[q]]]
                yield pd.DataFrame(out, columns=["doc_id", "quote_id", "quote", "text"])

    return scan


def fuzzy(pairs: DataFrame) -> DataFrame:
    """pairs (doc_id, quote_id, quote, text) -> (doc_id, quote_id, start, end, ratio, ambiguous) of quotes that nearly stand in the text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = [(d, q, *found) for d, q, quote, text in zip(frame.doc_id, frame.quote_id, frame.quote, frame.text, strict=True) if (found := fuzzy_find(quote, text))]
            yield pd.DataFrame(rows, columns=["doc_id", "quote_id", "start", "end", "ratio", "ambiguous"])

    return pairs.select("doc_id", "quote_id", "quote", "text").mapInPandas(find, "doc_id long, quote_id long, start int, end int, ratio double, ambiguous boolean")


def resolve(quote: str, text: str) -> tuple[str, int | None, int | None]:
    """How a quote is grounded in a text, and where: exact, normalized or fuzzy; ambiguous if it has several places on the first of these that finds it; else missing."""
    first = text.find(quote) if quote else -1
    if first >= 0:
        return ("ambiguous", None, None) if text.find(quote, first + 1) >= 0 else ("exact", first, first + len(quote))
    if found := normal_find(quote, text):
        return ("ambiguous", None, None) if found[2] else ("normalized", *found[:2])
    if near_by := fuzzy_find(quote, text):
        return ("ambiguous", None, None) if near_by[3] else ("fuzzy", *near_by[:2])
    return "missing", None, None


def ladder(pairs: DataFrame, *, least: int = vocab.MIN_QUOTE) -> DataFrame:
    """pairs (doc_id, quote_id, quote, text) -> (doc_id, quote_id, rung, start, end) by ``resolve``; too short a quote is ``short``."""

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for d, q, quote, text in zip(frame.doc_id, frame.quote_id, frame.quote, frame.text, strict=True):
                rows.append((d, q, *(("short", None, None) if len(quote or "") < least else resolve(quote, text or ""))))
            out = pd.DataFrame(rows, columns=["doc_id", "quote_id", "rung", "start", "end"])
            yield out.astype({"start": "Int32", "end": "Int32"})

    return pairs.select("doc_id", "quote_id", "quote", "text").mapInPandas(climb, "doc_id long, quote_id long, rung string, start int, end int")


def verify(quotes: DataFrame, slices: DataFrame, *, least: int = vocab.MIN_QUOTE) -> DataFrame:
    """quotes (item_id, slice_id, start, end, quote) against slices (item_id, slice_id, start, end, text): the quotes with what is wrong with each, null if nothing is.

    A quote must be long enough, cite a slice that there is, lie inside it, be as long as it says, and be what stands there.
    """
    own = slices.select("item_id", "slice_id", F.col("start").alias("from"), F.col("end").alias("to"), "text")
    both = quotes.join(own, ["item_id", "slice_id"], "left")
    there = F.substr("text", F.col("start") - F.col("from") + 1, F.col("end") - F.col("start"))
    wrong = (
        F.when(F.length("quote") < least, "short").when(F.col("from").isNull(), "unknown slice").when((F.col("start") < F.col("from")) | (F.col("end") > F.col("to")), "outside")
        .when(F.col("end") - F.col("start") != F.length("quote"), "length").when(there != F.col("quote"), "text")
    )
    return both.select(*quotes.columns, wrong.alias("wrong"))
