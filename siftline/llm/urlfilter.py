"""URL filter with DataFrame operations alone: a blocked Bloom filter of the listed canonical URLs lets possible hits pass to an exact hash join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import materialise

#: (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Query parameters that only track a visit.
TRACKING = "utm_[a-z]*|ref|fbclid|gclid|session|sid"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8  # longs of a filter block: 512 bits


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without its last slash, and the query without tracking parameters; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")), "&")
    own = host(url)
    line = F.concat(F.regexp_replace(own, r"^www\.", ""), F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(own != "", line)


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does. The rules are a parameter, a short list."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    cases = [((host_ == h) | F.endswith(host_, F.lit(f".{h}"))) & F.startswith(path_, F.lit(p)) for h, p, _ in ordered]
    found = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered]
    return F.coalesce(*[F.when(c, s) for c, s in zip(cases, found, strict=True)]) if ordered else F.lit(None).cast("struct<rule: string, verdict: string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, *, blocks: int) -> DataFrame:
    """The filter as a table (block, w0 .. w7): in the key's block one bit of each long is set. At most ``blocks`` rows."""
    bits = keys.select(_block(F.col("key"), blocks).alias("block"), F.hash(F.lit(11), "key").alias("a"), F.hash(F.lit(23), "key").alias("b"))
    return bits.groupBy("block").agg(*[F.bit_or(_mask(i)).alias(f"w{i}") for i in range(LANES)])


def _mask(lane: int) -> Column:
    """Six bits of the pair of hashes for each lane choose one of 64."""
    return F.expr(f"shiftleft(1L, cast(shiftrightunsigned({'a' if lane < 4 else 'b'}, {6 * (lane % 4)}) & 63 AS int))")


def may_hold(keys: DataFrame, filter_: DataFrame, *, blocks: int) -> DataFrame:
    """``keys`` (key, ...) with a column ``maybe``: the key may be in the filter. None that is in it is denied; a null key is."""
    probe = keys.withColumns({"block": _block(F.col("key"), blocks), "a": F.hash(F.lit(11), "key"), "b": F.hash(F.lit(23), "key")})
    hit = reduce(lambda x, y: x & y, [F.col(f"w{i}").bitwiseAND(_mask(i)) != 0 for i in range(LANES)])
    found = probe.join(filter_, "block", "left").withColumn("maybe", F.coalesce(hit, F.lit(False)) & F.col("key").isNotNull())
    return found.drop("block", "a", "b", *[f"w{i}" for i in range(LANES)])


def listed(keys: DataFrame, list_: DataFrame, *, keys_per_block: int = 32, blocks: int | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``keys`` (key, ...) with a column ``hit``: the key is in ``list_`` (key).

    The filter, of 16 bits a key, is asked first, where the rows lie: it is broadcast if its blocks hold at most ``broadcast_bytes``,
    and else joined by block. Only possible hits are shuffled to the exact join; the others are settled. Null keys are never listed.
    """
    distinct = materialise(list_.where("key is not null").select("key").distinct(), "url-list")
    blocks = blocks or distinct.count() // keys_per_block + 1
    filter_ = materialise(bloom(distinct, blocks=blocks), "bloom")
    probed = may_hold(keys, F.broadcast(filter_) if blocks * 8 * (LANES + 1) <= broadcast_bytes else filter_, blocks=blocks)
    settled = probed.where("not maybe").withColumn("hit", F.lit(False))
    exact = probed.where("maybe").join(distinct.withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return settled.unionByName(exact).drop("maybe")


def repeated_urls(pages: DataFrame, *, url: str = "url") -> DataFrame:
    """(key): canonical URLs under which more than one page lies; the list that the query blocks."""
    return pages.select(canonical(F.col(url)).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")


def judge(pages: DataFrame, list_: DataFrame, *, page_id: str = "page_id", url: str = "url", rules=RULES, **options) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    A rule's verdict goes before the list's; a URL that no rule fits is blocked if its canonical form is listed. Null URLs and
    those without ``://`` have empty host and path, fit no rule, are not listed, and are allowed. Repeated rows are judged alike.
    """
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    own = own.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    own = own.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    own = own.withColumn("key", F.when(F.col("r").isNull(), F.col("key")))  # what a rule judges needs no list
    judged = listed(own, list_, **options)
    verdict = F.coalesce("r.verdict", F.when(F.col("hit"), F.lit("block")), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


ORACLE_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
keyed AS (
  SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING})(=|$)')), '&') AS kept FROM parts),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS key FROM keyed),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    count(key) OVER (PARTITION BY key) AS n FROM canon)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN key IS NOT NULL AND n > 1 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
