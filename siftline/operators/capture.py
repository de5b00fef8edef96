"""Captures and discovery: snapshots, robots rules, quality of searches, carried records, lane filters, query spaces."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import html as H
from siftline.functions import parse as P
from siftline.functions import urls as U
from siftline.functions.text import contains_any, normal, slug


def capture_time(stamp: Column) -> Column:
    """A timestamp of digits, perhaps cut short, as an ISO time; null if malformed."""
    start = F.lit("00000101000000")
    full = F.concat(stamp, F.substr(start, F.length(stamp) + 1, F.lit(14)))
    ok = stamp.rlike("^([0-9]{4}|[0-9]{6}|[0-9]{8}|[0-9]{10}|[0-9]{12}|[0-9]{14})$")
    return F.when(ok, F.date_format(F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")), "yyyy-MM-dd'T'HH:mm:ss"))


def pick_snapshots(captures: DataFrame, *, most: int, since: str = "", until: str = "9") -> DataFrame:
    """captures (url, stamp, status, size): the newest of each URL that answered 200, are no stubs (under 5,000 bytes) and lie in range."""
    good = captures.where((F.col("status") == 200) & ~((F.col("size") > 0) & (F.col("size") < 5000)) & (F.col("stamp") >= since) & (F.col("stamp") < until))
    newest = Window.partitionBy("url").orderBy(F.desc("stamp"), "size")
    return good.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)


def may_fetch(path: Column, rules: tuple[tuple[str, bool], ...]) -> Column:
    """Robots rules (prefix, allowed): the longest match decides, allow wins ties, no match allows."""
    reach = lambda wanted: F.greatest(F.lit(0), F.lit(0), *[F.when(F.startswith(path, F.lit(p)), F.lit(len(p))).otherwise(F.lit(0)) for p, a in rules if a == wanted])
    return reach(True) >= reach(False)


_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def origin(url: Column) -> Column:
    """Scheme and authority of an address in lower case: what a robots file is valid for. Empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.trim(url), F.lit("")), _ORIGIN, 1))


def robots_table(files: DataFrame, *, origin: str = "origin", text: str = "text", agent: str = "siftline") -> DataFrame:
    """Robots files as rules (origin, prefix, allowed), each prefix once; where a file both allows and denies one, it allows."""
    read = files.select(F.col(origin).alias("origin"), P.robots(F.col(text), agent).alias("r"))
    told = lambda kind, allowed: F.transform(f"r.{kind}", lambda p: F.struct(p.alias("prefix"), F.lit(allowed).alias("allowed")))
    each = read.select("origin", F.explode(F.concat(told("allow", True), told("disallow", False))).alias("rule"))
    return each.select("origin", "rule.*").groupBy("origin", "prefix").agg(F.bool_or("allowed").alias("allowed"))


def permitted(pages: DataFrame, rules: DataFrame, *, url: str = "url", into: str = "allowed") -> DataFrame:
    """``pages`` with whether their origin's rules let them be fetched: the rule of the longest prefix of the path decides; without one all is allowed.

    A prefix join by equality: of each distinct address' path the prefixes of those lengths that its origin's rules have are looked
    up. No address meets a rule that is not its own, and a frequent origin is no group of a task. Null addresses are allowed.
    """
    path = F.coalesce(F.nullif(F.regexp_extract(F.trim(url), _ORIGIN + "([^?#]*)", 2), F.lit("")), F.lit("/"))
    urls = pages.select(F.col(url).alias("address"), origin(F.col(url)).alias("origin"), path.alias("path")).where("address IS NOT NULL AND origin <> ''").distinct()
    lengths = rules.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    probes = urls.join(lengths, "origin").select("address", "origin", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    hits = probes.select("address", "origin", "n", F.substring("path", F.lit(1), F.col("n")).alias("prefix")).join(rules, ["origin", "prefix"])
    denied = hits.groupBy("address").agg(F.max(F.struct("n", "allowed")).alias("rule")).where(~F.col("rule.allowed")).select(F.col("address").alias("__denied"))
    return pages.join(denied, pages[url] == denied["__denied"], "left").withColumn(into, F.col("__denied").isNull()).drop("__denied")


def discovery_quality(hits: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """hits (backend, query, key, captured): per backend queries, hits, distinct results, captured and skipped ones, and whether the share is enough."""
    own = hits.groupBy("backend").agg(
        F.count_distinct("query").alias("queries"), F.count("*").alias("hits"), F.count_distinct("key").alias("unique"), F.count_if("captured").alias("captured"), F.count_if(~F.col("captured")).alias("skipped")
    )
    share = F.round(F.try_divide(F.col("captured"), F.col("captured") + F.col("skipped")), 3)
    return own.withColumn("share", share).withColumn("enough", F.coalesce(F.col("share") >= threshold, F.lit(False)))


def carried_first(carried: DataFrame, own: DataFrame, *, key: str, order: str) -> DataFrame:
    """Records of both, one for each key: a carried one before an own one, then by order. A minimum, not a window."""
    both = carried.withColumn("rank", F.lit(0)).unionByName(own.withColumn("rank", F.lit(1)))
    return both.groupBy(key).agg(F.min(F.struct("rank", order)).alias("first")).select(key, F.col("first.rank").alias("rank"), F.col(f"first.{order}").alias(order))


def lane_filter(text: Column, *, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Whether a title and text fit the lane: no excluded term, and an included one if any are asked."""
    flat = normal(F.coalesce(text, F.lit("")))
    wanted = contains_any(flat, include) if include else F.lit(True)
    return wanted & ~contains_any(flat, exclude)


def query_space(templates: tuple[str, ...], axes: dict[str, tuple[str, ...]]) -> list[str]:
    """Every template filled with every combination of its axes, each once, in order; one whose axis is unknown or empty is left out. Configuration, on the driver."""
    out: dict[str, None] = {}
    for template in templates:
        names = [n for n in axes if "{" + n + "}" in template]
        for values in product(*[axes[n] for n in names]):
            filled = template
            for n, v in zip(names, values, strict=True):
                filled = filled.replace("{" + n + "}", v)
            if "{" not in filled:
                out[filled] = None
    return list(out)


def snapshot_diff(old: DataFrame, new: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed between two snapshots; one aggregate over their union, equal rows say nothing."""
    both = old.select(key, F.col(value).alias("o"), F.lit(None).cast("string").alias("n")).unionByName(new.select(key, F.lit(None).cast("string").alias("o"), F.col(value).alias("n")))
    sides = both.groupBy(key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return sides.select(key, change.alias("change")).where("change IS NOT NULL")


def records(responses: DataFrame) -> DataFrame:
    """responses (url, content_type, body binary) -> item rows: item_id, text, title, source_uri, metadata.

    HTML gives its readable text, or the longest text of its JSON-LD where that is longer and the page gives under 200 characters;
    plain text is taken as it is. Other kinds and empty texts give no row. Metadata: evidence, kind, links' hosts, the page's own
    summary, the hiring firm, and what the address says if it is an archive's.
    """
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    own = responses.withColumn("kind", kind).withColumn("raw", P.body(F.col("body"), F.coalesce("content_type", F.lit(""))))
    page, plain = F.col("kind").isin("text/html", "application/xhtml+xml", ""), (F.col("kind") == "text/plain") | F.endswith("url", F.lit(".txt"))
    read = own.withColumn("readable", H.readable(F.when(page & ~plain, F.col("raw")))).withColumn("ld", P.ld(F.when(page & ~plain, F.col("raw"))))
    better = (F.length("readable") < 200) & (F.length("ld.description") > F.length("readable"))
    text = F.when(plain, F.trim("raw")).when(page, F.when(better, F.col("ld.description")).otherwise(F.col("readable")))
    title = F.coalesce(F.nullif(F.when(page & ~plain, H.title(F.col("raw"))), F.lit("")), U.host(F.col("url")))
    archived = P.capture_parts(F.col("url"))
    hosts = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(H.resolved_links(F.col("raw"), F.col("url")), U.host), lambda h: (h != "") & (h != U.host(F.col("url")))))), ",")
    facts = {
        "evidence": F.lit("fetched"), "content_type": F.when(page & ~plain, F.coalesce(F.nullif("kind", F.lit("")), F.lit("text/html"))), "outbound_hosts": F.when(page & ~plain, F.nullif(hosts, F.lit(""))),
        "meta_description": F.when(page & ~plain, F.nullif(H.description(F.col("raw")), F.lit(""))), "hiring_organization": F.nullif("ld.employer", F.lit("")),
        "original_url": archived["original"], "snapshot_timestamp": archived["timestamp"],
    }
    metadata = F.map_filter(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    made = read.select(U.record_id(F.col("url"), title, slug).alias("item_id"), text.alias("text"), title.alias("title"), F.col("url").alias("source_uri"), metadata.alias("metadata"))
    return made.where(F.coalesce(F.col("text"), F.lit("")) != "")


def resolved_domains(hits: DataFrame) -> DataFrame:
    """hits (name, url) -> (name, domain): the host most of a name's hits lie on, the shorter of equals; hosts of sources and such without a dot don't count."""
    own = hits.select("name", U.host(F.col("url")).alias("domain"))
    counts = own.where(F.contains("domain", F.lit(".")) & ~U.is_source_host(F.col("domain"))).groupBy("name", "domain").agg(F.count("*").alias("n"))
    return counts.groupBy("name").agg(F.min_by("domain", F.struct(-F.col("n"), F.length("domain"), "domain")).alias("domain"))


def entity_sources(items: DataFrame) -> DataFrame:
    """items (entity, uri, text, seq) -> (entity, uri, text): the last text of each source of an entity; an item without a source stands under its entity."""
    return items.groupBy("entity", F.coalesce(F.nullif("uri", F.lit("")), F.col("entity")).alias("uri")).agg(F.max_by("text", "seq").alias("text"))


def merged(items: DataFrame) -> DataFrame:
    """items (item_id, text, seq) -> one row for each id: its texts in order, parted by blank lines, empty ones left out, and how many rows more there were."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "text")))
    said = F.filter(F.transform(lines, lambda r: r.text), lambda x: x.isNotNull() & (x != ""))
    return items.groupBy("item_id").agg(F.array_join(said, "\n\n").alias("text"), (F.count("*") - 1).alias("extra"))


def firm_matches(company: dict[str, Column], *, words: tuple[str, ...] = (), batch: str = "", tags: tuple[str, ...] = ()) -> Column:
    """Whether a listed firm (status, batch, tags and industries as arrays, name, line, text) is active, of the batch, of one of the tags, and says all words."""
    have = F.transform(F.concat(company["tags"], company["industries"]), F.lower)
    said = F.lower(F.concat_ws(" ", company["name"], company["line"], company["text"], F.array_join(have, " ")))
    ok = F.coalesce(company["status"] == "Active", F.lit(True))
    if batch:
        ok &= F.lower(F.coalesce(company["batch"], F.lit(""))) == batch.lower()
    if tags:
        ok &= F.arrays_overlap(have, F.array(*[F.lit(t.lower()) for t in tags]))
    for word in words:
        ok &= F.contains(said, F.lit(word.lower()))
    return ok
