"""Parsers of small foreign texts: robots rules, sitemaps, capture indexes, JSON-LD, JSON in prose, bodies of responses.

All are Column expressions but two: JSON inside prose, and bodies in an encoding that Spark doesn't read, are Arrow UDFs over small helpers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import urls
from siftline.functions.text import let


def robots(text: Column, agent: str = "siftline") -> Column:
    """(allow, disallow): the path prefixes of the groups of a robots text that are for everyone or for ``agent``.

    Lines of user agents before the first rule open a group together; a user agent after a rule opens the next.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.substring_index(x, "#", 1)))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(
        F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("mine"), F.lit(False).alias("ruled"), none.alias("allow"), none.alias("disallow"))

    def step(at: Column, line: Column) -> Column:
        names, rules = line["key"] == "user-agent", line["key"].isin("allow", "disallow")
        mine = F.when(names, (at["mine"] & ~at["ruled"]) | line["value"].isin("*", agent)).otherwise(at["mine"])
        taken = lambda kind: F.when((line["key"] == kind) & at["mine"] & (line["value"] != ""), F.concat(at[kind], F.array(line["value"]))).otherwise(at[kind])
        return F.struct(mine.alias("mine"), (F.when(names, F.lit(False)).otherwise(at["ruled"] | rules)).alias("ruled"), taken("allow").alias("allow"), taken("disallow").alias("disallow"))

    return F.aggregate(pairs, start, step, lambda at: F.struct(at["allow"].alias("allow"), at["disallow"].alias("disallow")))


def _inside(block: Column, tag: str) -> Column:
    """The text of an element's first child of that name, entities read; empty if there is none."""
    found = F.regexp_extract(block, rf"(?s)<(?:[\w-]+:)?{tag}\b[^>]*>\s*<!\[CDATA\[(.*?)\]\]>", 1)
    plain = F.regexp_extract(block, rf"(?s)<(?:[\w-]+:)?{tag}\b[^>]*>\s*([^<]*)<", 1)
    for sign, entity in vocab.XML_ENTITIES.items():  # the ampersand last, so that nothing is read twice
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return F.trim(F.coalesce(F.nullif(found, F.lit("")), plain))


def sitemap(xml: Column) -> Column:
    """(sitemaps, pages): the files an index lists, or the (loc, lastmod) a map lists. Name spaces don't matter; entries without a place are left out."""
    blocks = lambda tag: F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf"(?s)<(?:[\w-]+:)?{tag}\b[^>]*>.*?</(?:[\w-]+:)?{tag}>"), F.lit(0))
    index = F.coalesce(xml.rlike(r"<(?:[\w-]+:)?sitemapindex\b"), F.lit(False))
    files = F.filter(F.transform(blocks("sitemap"), lambda b: _inside(b, "loc")), lambda x: x != "")
    pages = F.filter(F.transform(blocks("url"), lambda b: F.struct(_inside(b, "loc").alias("loc"), F.nullif(_inside(b, "lastmod"), F.lit("")).alias("lastmod"))), lambda p: p["loc"] != "")
    return F.struct(F.when(index, files).otherwise(F.slice(files, 1, 0)).alias("sitemaps"), F.when(index, F.slice(pages, 1, 0)).otherwise(pages).alias("pages"))


def captures(payload: Column) -> Column:
    """Rows (timestamp, original, status, length) of a capture index: a JSON list of lists, with a first row of names or the usual order. Rows without a time or an address are left out."""
    rows = F.filter(F.from_json(payload, "array<array<string>>"), lambda r: F.size(r) > 0)
    head = F.transform(F.get(rows, F.lit(0)), lambda c: F.lower(F.trim(c)))
    named = F.arrays_overlap(head, F.array(*map(F.lit, ("timestamp", "statuscode", "original"))))
    names = F.when(named, head).otherwise(F.array(*map(F.lit, vocab.CAPTURE_FIELDS)))
    body = F.when(named, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)

    def cell(row: Column, *wanted: str) -> Column:
        found = [F.nullif(F.trim(F.get(row, F.array_position(names, w).cast("int") - 1)), F.lit("")) for w in wanted]
        return F.coalesce(*found, F.lit(""))

    made = F.transform(body, lambda r: F.struct(cell(r, "timestamp").alias("timestamp"), cell(r, "original").alias("original"), cell(r, "statuscode", "status").alias("status"), cell(r, "length").alias("length")))
    return F.filter(made, lambda c: (c["timestamp"] != "") & (c["original"] != ""))


def capture_parts(url: Column) -> Column:
    """(original, timestamp) of an archive's capture address; null for others."""
    own = F.trim(url)
    return F.when(own.rlike(vocab.CAPTURE_URL), F.struct(F.regexp_extract(own, vocab.CAPTURE_URL, 2).alias("original"), F.regexp_extract(own, vocab.CAPTURE_URL, 1).alias("timestamp")))


def capture_url(original: Column, timestamp: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), F.trim(timestamp.cast("string")), F.lit("id_/"), F.trim(original))


def epoch(text: Column) -> Column:
    """Seconds of an ISO time, which is UTC unless it says otherwise; null for what is none."""
    own = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    zoned = F.when(own.rlike(r"[+-]\d\d:?\d\d$") & own.rlike(r"\d[T ]\d"), own).otherwise(F.concat(own, F.when(own.rlike(r"\d[T ]\d"), F.lit("+00:00")).otherwise(F.lit("T00:00:00+00:00"))))
    return F.when(own.rlike(r"^\d{4}-\d\d-\d\d"), F.unix_micros(F.try_to_timestamp(F.replace(zoned, F.lit(" "), F.lit("T")))) / 1e6)


# --- JSON-LD ----------------------------------------------------------------------------------------
#: So many wrappers (lists, graphs) around each other are opened; what lies deeper isn't read.
WRAPPERS = 4


def _part(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$['{name}']", kind)


def _string(value: Column) -> Column:
    """A text value with white space collapsed; empty for all others."""
    return F.when(F.schema_of_variant(value) == "STRING", F.trim(F.regexp_replace(F.try_variant_get(value, "$", "string"), r"\s+", " "))).otherwise("")


def ld_nodes(html: Column) -> Column:
    """The JSON-LD objects of a page as variants, in order. Broken blocks, and those that name a key twice, are passed over; null has none."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(vocab.LD_BLOCK), F.lit(1))
    nodes = F.transform(blocks, F.try_parse_json)
    for _ in range(WRAPPERS):
        opened = F.transform(F.filter(nodes, lambda n: n.isNotNull()), lambda n: F.coalesce(_part(n, "@graph"), n))
        nodes = F.flatten(F.transform(opened, lambda n: F.coalesce(F.try_variant_get(n, "$", "array<variant>"), F.array(n))))
    return F.filter(nodes, lambda n: F.startswith(F.schema_of_variant(n), F.lit("OBJECT")))


def _types(node: Column) -> Column:
    one = F.array(F.coalesce(_part(node, "@type", "string"), F.lit("")))
    return F.filter(F.transform(F.coalesce(_part(node, "@type", "array<string>"), one), F.lower), lambda t: t.isNotNull() & (t != ""))


def ld_employers(nodes: Column) -> Column:
    """(name, domain) of the firm that each job posting names, in order; a source's own host is no domain."""

    def firm(node: Column) -> Column:
        said = _part(node, "hiringOrganization")
        said = F.coalesce(F.get(F.try_variant_get(said, "$", "array<variant>"), F.lit(0)), said)
        name = F.coalesce(F.nullif(_string(said), F.lit("")), F.trim(F.regexp_replace(_part(said, "name", "string"), r"\s+", " ")), F.lit(""))
        address = F.coalesce(F.nullif(F.trim(_part(said, "url", "string")), F.lit("")), F.trim(_part(said, "sameAs", "string")), F.lit(""))
        found = let(address, lambda a: F.when(a == "", "").otherwise(F.coalesce(urls.entity(a), F.lit(""))))
        return F.struct(name.alias("name"), let(found, lambda d: F.when(urls.is_source_host(d), "").otherwise(d)).alias("domain"))

    return F.transform(F.filter(nodes, lambda n: F.array_contains(_types(n), "jobposting")), firm)


def ld_descriptions(nodes: Column) -> Column:
    """What the articles, postings, products, pages and untyped objects say, each text once."""
    kinds = F.array(*map(F.lit, vocab.LD_TYPES))
    telling = F.filter(nodes, lambda n: (F.size(_types(n)) == 0) | F.arrays_overlap(_types(n), kinds))
    return F.filter(F.flatten(F.transform(telling, lambda n: F.array(*(_string(_part(n, k)) for k in vocab.LD_TEXTS)))), lambda t: t != "")


def ld(html: Column) -> Column:
    """(employer, domain, description) of a page's JSON-LD: the first posting that names a firm or its domain, and the longest text (of equally long ones the first)."""

    def read(nodes: Column) -> Column:
        named = F.get(F.filter(ld_employers(nodes), lambda e: (e["name"] != "") | (e["domain"] != "")), F.lit(0))
        told = F.array_max(F.transform(ld_descriptions(nodes), lambda t, i: F.struct(F.length(t).alias("size"), (-i).alias("place"), t.alias("text"))))
        return F.struct(named.alias("firm"), told.alias("told"))

    def plain(x: Column) -> Column:
        none = F.lit("")
        return F.struct(F.coalesce(x["firm"]["name"], none).alias("employer"), F.coalesce(x["firm"]["domain"], none).alias("domain"), F.coalesce(x["told"]["text"], none).alias("description"))

    return let(let(ld_nodes(html), read), plain)


# --- JSON in prose ----------------------------------------------------------------------------------
#: Brackets nested deeper than this are not read as JSON.
DEEPEST = 500
_SIGN = re.compile(r"\\.|[\"\[\]{}]", re.S)
_SPARE = re.compile(r"(\"(?:\\.|[^\"\\])*\")|,(?=\s*[\]}])", re.S)


def _balanced(text: str, quoted: bool) -> Iterator[tuple[int, int]]:
    """Spans from a bracket to the one that closes it, if the text begins outside (or inside) of a string."""
    around: list[list[int]] = []  # place and height of each bracket that is open
    for sign in _SIGN.finditer(text):
        kind = sign[0]
        if kind == '"':
            quoted = not quoted
        elif quoted or len(kind) > 1:
            continue
        elif kind in "[{":
            around.append([sign.start(), 1])
        elif around and text[around[-1][0]] + kind in ("[]", "{}"):
            begin, height = around.pop()
            if around:
                around[-1][1] = max(around[-1][1], height + 1)
            if height <= DEEPEST:
                yield begin, sign.end()
        else:
            around.clear()


def _spans(text: str) -> list[str]:
    """All that may be a JSON object or list, by where it begins. Prose may hold any number of quotes, so both readings of them are taken."""
    return [text[a:b] for a, b in sorted({*_balanced(text, False), *_balanced(text, True)})]


def _readings(text: str) -> Iterator[str]:
    """What may be the JSON of an answer, the likeliest first: all of it, what is fenced, what lies in brackets; then with commas forgiven before closing brackets."""
    fenced = text.split(vocab.FENCE, 2)[1:2] if text.count(vocab.FENCE) > 1 else []
    fenced = [f.removeprefix("json").strip() for f in fenced]
    yield from [text, *fenced]
    yield from (_SPARE.sub(r"\1", f) for f in fenced)
    inner = _spans(text)
    yield from inner
    yield from (_SPARE.sub(r"\1", f) for f in inner)


def _values(readings: Iterator[str]) -> Iterator:
    for reading in readings:
        try:
            yield json.loads(reading)
        except (ValueError, RecursionError):
            continue


def find_json(text: str | None):
    """The JSON that a worker's answer holds; None if there is none."""
    return next(_values(_readings((text or "").strip())), None)


def find_payload(text: str | None, keys: tuple[str, ...] = ("input_items", "output_schema")):
    """The first object in a prompt that has all of the keys."""
    return next((o for o in _values(iter(_spans(text or ""))) if isinstance(o, dict) and set(keys) <= o.keys()), None)


def answer(text: Column) -> Column:
    """``find_json`` as canonical JSON text: sorted keys, no blanks."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        found = [find_json(t) for t in texts]
        return pd.Series([None if f is None else json.dumps(f, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for f in found], dtype=object)

    return read(text)


def canonical_json(pairs: dict[str, Column]) -> Column:
    """An object of the columns as JSON text with sorted keys and no blanks; nulls are written."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(pairs.items())]), {"ignoreNullFields": "false"})


# --- bodies of responses ----------------------------------------------------------------------------
def body(raw: Column, content_type: Column) -> Column:
    """The text of a response. A declared encoding that fits goes first, else UTF-8 if it is that, else Windows-1252; what that lacks is marked in UTF-8. Null is empty.

    Spark reads all but declared encodings of other names: only such rows have anything for the Python helper.
    """
    said = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), vocab.CHARSET, 1))
    octets = F.coalesce(raw, F.lit(b""))
    unicode, latin = octets.cast("string"), F.decode(octets, "ISO-8859-1")
    high = {bytes([b]).decode("latin-1"): bytes([b]).decode("windows-1252", "ignore") for b in range(0x80, 0xA0)}
    known, lacking = [k for k, v in high.items() if v], "".join(k for k, v in high.items() if not v)
    windows = F.translate(latin, "".join(known), "".join(high[k] for k in known))
    usual = F.when(F.is_valid_utf8(unicode), unicode).when(~latin.rlike(f"[{lacking}]"), windows).otherwise(F.make_valid_utf8(unicode))
    foreign = ~said.isin("", *vocab.UTF8_NAMES, *vocab.LATIN_NAMES)

    @F.pandas_udf("string")
    def declared(raws: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([_decoded(r, n) for r, n in zip(raws, names, strict=True)], dtype=object)

    return F.when(said.isin(*vocab.LATIN_NAMES), latin).otherwise(F.coalesce(declared(F.when(foreign, octets), said), usual))


def _decoded(raw: bytes | None, encoding: str) -> str | None:
    """The text, if the encoding is known and fits."""
    try:
        return None if raw is None else raw.decode(encoding)
    except (LookupError, ValueError):
        return None


# --- images -----------------------------------------------------------------------------------------
def exposed_alts(html: Column) -> Column:
    """HTML in which images have given way to what their alternatives say, where that names something: three characters or more, and no mere kind of image.

    An entity counts as one character, a non-breaking space as a blank. Images without an alternative stay.
    """

    def shown(piece: Column) -> Column:
        image = F.regexp_extract(piece, vocab.IMAGE, 0)
        said = F.concat(F.regexp_extract(piece, vocab.IMAGE, 1), F.regexp_extract(piece, vocab.IMAGE, 2))
        plain = F.trim(F.regexp_replace(F.regexp_replace(said, "&nbsp;|&#160;|\u00a0", " "), "&#?\\w+;", "\u00a4"))
        named = (F.length(plain) >= 3) & ~F.lower(F.regexp_replace(plain, r"[\W_]+", "")).isin(*vocab.GENERIC_ALTS)
        rest = F.substring(piece, F.length(image) + 1, F.length(piece))
        return F.when(image == "", piece).otherwise(F.concat(F.when(named, F.concat(F.lit(" "), said, F.lit(" "))).otherwise(F.lit(" ")), rest))

    return F.array_join(F.transform(F.split(html, r"(?i)(?=<img\b)"), shown), "")
