"""Queries over fetched pages: URLs, attribution, HTML, and the registry of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import html as H
from siftline.functions import text as T
from siftline.functions import urls as U
from siftline.operators import registry
from siftline.queries.base import Tables, query, quoted, sql_any

SURFACES = {"listing": ("/page",), "english": ("/en/",), "french": ("/fr/",), "german": ("/de/",), "spanish": ("/es/",)}

_HOST = r"coalesce(regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', ''), '')"
_PATH = r"coalesce(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '')"
_CANON = (
    r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || "
    rf"regexp_replace({_PATH.format('url')}, '/+$', '') || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), "
    rf"lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN ({', '.join(map(quoted, vocab.TRACKING_PARAMS))})), '&'), ''), '')"
)
#: Pages stand for records found on boards, registries, reviews, communities and firms' own sites: the host is made from the page.
_SLUG = "regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '[.].*$', '')"
_FOUND = {
    0: "'https://boards.greenhouse.io/' || {s} || '/jobs/' || page_id", 1: "'https://www.snowflake.com/partners/' || {s} || '-group'", 2: "'https://clutch.co/profile/' || {s}",
    3: "'https://careers.' || {s} || '.com/careers/senior-' || {s}", 4: "'https://www.' || {s} || '.com/case-studies/' || page_id", 5: "'https://' || {s} || '.io/services/'",
    6: "'https://www.reddit.com/r/' || {s} || '/comments/' || page_id", 7: "url",
}
_CASE = "CASE page_id % 8 " + " ".join(f"WHEN {k} THEN {v.format(s=_SLUG)}" for k, v in _FOUND.items()) + " END"


def _found(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.expr(_CASE).alias("src"))


@query(f"SELECT {_CANON} AS canonical, count(*)::BIGINT AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
def canonical_url_dedupe(t: Tables) -> DataFrame:
    return t.pages.groupBy(U.canonical(F.col("url")).alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"SELECT {_HOST.format('url')} AS host, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def url_host(t: Tables) -> DataFrame:
    return t.pages.groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


_PARTS = f"list_filter(string_split({_PATH.format('src')}, '/'), lambda p: p <> '')"
_NAMED = "(CASE WHEN contains(replace({0}, '-', '_'), '.') THEN replace({0}, '-', '_') ELSE replace({0}, '-', '_') || '.com' END)"
_LAST = "list_filter(parts, lambda p: p NOT IN ({0}))"


#: The entity of an address whose host is h and whose path has these parts.
_ENTITY = f"""CASE
  WHEN {sql_any("h", vocab.ATS_SLUG_HOSTS)} AND len(parts) > 0 THEN {_NAMED.format("parts[1]")}
  WHEN {sql_any("h", vocab.REGISTRY_HOSTS)} AND list_contains(parts, 'partners') THEN {_NAMED.format("(" + _LAST.format("'partners', 'en-us', 'marketplace'") + ")[-1]")}
  WHEN {sql_any("h", vocab.PLATFORM_HOSTS)} OR {sql_any("h", vocab.REGISTRY_HOSTS)} THEN h
  WHEN {sql_any("h", ("clutch.co", "g2.com"))} AND len({_LAST.format("'profile', 'it-services', 'products'")}) > 0 THEN {_NAMED.format("(" + _LAST.format("'profile', 'it-services', 'products'") + ")[-1]")}
  WHEN starts_with(h, 'careers.') AND len(h) - len(replace(h, '.', '')) >= 2 THEN substr(h, 9) ELSE h END"""


@query(f"""WITH f AS (SELECT page_id, lower({_CASE}) AS src FROM pages), p AS (SELECT *, {_HOST.format("src")} AS h, {_PARTS} AS parts FROM f) SELECT page_id, {_ENTITY} AS entity FROM p""")
def entity_key(t: Tables) -> DataFrame:
    return _found(t).select("page_id", U.entity(F.col("src")).alias("entity"))


_POSTING = rf"""(regexp_extract(src, '{vocab.POSTING_PATH}', 1) LIKE '%-%' AND NOT suffix(regexp_extract(src, '{vocab.POSTING_PATH}', 1), 'jobs')
  AND NOT regexp_matches(src, '{vocab.LISTING_PATH}') AND NOT regexp_matches(src, '{vocab.LISTING_QUERY}'))"""
_CATEGORY = f"""CASE
  WHEN {sql_any("src", vocab.REGISTRY_HOSTS)} AND ({sql_any("src", ("partner", "/customers", "/success"))} OR regexp_matches(src, '{vocab.CASE_STUDY_PATH}')) THEN 'vendor_registry'
  WHEN {sql_any("src", vocab.REVIEW_HOSTS)} THEN 'b2b_directory_audit' WHEN {sql_any("src", vocab.COMMUNITY_HOSTS)} THEN 'community_and_social'
  WHEN {sql_any(_HOST.format("src"), vocab.ATS_HOSTS)} OR {_POSTING} THEN 'ats_requisitions'
  WHEN regexp_matches(src, '{vocab.CASE_STUDY_PATH}') THEN 'first_party_case_study' WHEN regexp_matches(src, '{vocab.PRACTICE_PATH}') THEN 'first_party_practice' ELSE 'general_web' END"""


@query(f"WITH f AS (SELECT lower({_CASE}) AS src FROM pages) SELECT {_CATEGORY} AS category, count(*)::BIGINT AS n FROM f GROUP BY 1")
def source_category_counts(t: Tables) -> DataFrame:
    return _found(t).groupBy(U.category(F.col("src")).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH f AS (SELECT page_id, lower({_CASE}) AS src FROM pages) SELECT page_id, src FROM f WHERE {_POSTING}")
def posting_paths(t: Tables) -> DataFrame:
    return _found(t).select("page_id", F.lower("src").alias("src")).where(U.posting(F.col("src")))


_SURFACE = "coalesce(" + ", ".join(f"CASE WHEN {sql_any('lower(' + _PATH.format('url') + ')', p)} THEN '{n}' END" for n, p in SURFACES.items()) + ", '')"


@query(f"SELECT {_SURFACE} AS surface, count(*)::BIGINT AS n, min(url) AS first_url FROM pages GROUP BY 1")
def surface_classify(t: Tables) -> DataFrame:
    return t.pages.groupBy(U.surface(F.col("url"), SURFACES).alias("surface")).agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


@query(f"""
WITH s AS (SELECT {_HOST.format("url")} AS host, {_SURFACE} AS surface, page_id, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host, surface ORDER BY url, page_id) AS n FROM s WHERE surface <> '')
SELECT host, surface, count(*) FILTER (n <= 3)::BIGINT AS taken, count(*) FILTER (n > 3)::BIGINT AS trimmed FROM r GROUP BY 1, 2""")
def surface_budget(t: Tables) -> DataFrame:
    """At most three pages of each host's surface are read; the rest is counted."""
    own = t.pages.select(U.host(F.col("url")).alias("host"), U.surface(F.col("url"), SURFACES).alias("surface"), "page_id", "url").where("surface <> ''")
    ranked = own.withColumn("n", F.row_number().over(Window.partitionBy("host", "surface").orderBy("url", "page_id")))
    return ranked.groupBy("host", "surface").agg(F.count_if(F.col("n") <= 3).alias("taken"), F.count_if(F.col("n") > 3).alias("trimmed"))


@query(f"""
WITH d AS (SELECT page_id, url, len(regexp_replace({_PATH.format("url")}, '/+$', '')) - len(replace(regexp_replace({_PATH.format("url")}, '/+$', ''), '/', '')) AS depth FROM pages)
SELECT page_id, url, depth::INT AS depth, row_number() OVER (ORDER BY depth DESC, url, page_id)::INT AS place FROM d QUALIFY place <= 50""")
def deepest_first(t: Tables) -> DataFrame:
    """A report of the fifty deepest pages."""
    own = t.pages.select("page_id", "url", U.depth(F.col("url")).alias("depth")).orderBy(F.desc("depth"), "url", "page_id").limit(50)
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("depth"), "url", "page_id")))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.title(F.col("html")).alias("title"))


@query("""SELECT page_id, link, count(*)::BIGINT AS n FROM (SELECT DISTINCT page_id, unnest(list_filter(regexp_extract_all(html, '(?i)<a[^>]+href="([^"#]*)', 1), lambda x: x <> '')) AS link FROM pages) GROUP BY 1, 2""")
def page_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(H.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


#: Pages with some links more: relative ones, one up, one without scheme, one of another kind, one to another host.
_LINKED = "concat('<a href=\"/root/x\">a</a><a class=b href=\"next\">b</a><a href=\"//cdn.else.org/y?z=1\">c</a><a href=\"mailto:a@b.c\">d</a><a href=\"?q=2\">e</a><a href=\"https://partner', CAST(page_id % 5 AS VARCHAR(9)), '.com/p#f\">f</a>')"
_ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_FOLDER = f"CASE WHEN contains({_PATH.format('url')}, '/') THEN regexp_extract({_PATH.format('url')}, '^(.*/)[^/]*$', 1) ELSE '/' END"


@query(f"""SELECT page_id, unnest([{_ORIGIN} || '/root/x', {_ORIGIN} || {_FOLDER} || 'next', regexp_extract(url, '^([A-Za-z]+:)', 1) || '//cdn.else.org/y?z=1', {_ORIGIN} || {_PATH.format("url")} || '?q=2', 'https://partner' || (page_id % 5) || '.com/p']) AS link FROM pages""")
def resolved_links(t: Tables) -> DataFrame:
    """Links as addresses, whatever form they have in the page."""
    return t.pages.select("page_id", F.explode(H.resolved_links(F.expr(_LINKED), F.col("url"))).alias("link"))


@query(f"""WITH l AS (SELECT {_HOST.format("url")} AS own, unnest(['cdn.else.org', 'partner' || (page_id % 5) || '.com']) AS host FROM pages)
SELECT own, host, count(*)::BIGINT AS n FROM l WHERE host <> own GROUP BY 1, 2""")
def outbound_hosts(t: Tables) -> DataFrame:
    links = t.pages.select(U.host(F.col("url")).alias("own"), F.explode(H.resolved_links(F.expr(_LINKED), F.col("url"))).alias("link"))
    return links.select("own", U.host(F.col("link")).alias("host")).where("host <> own").groupBy("own", "host").agg(F.count("*").alias("n"))


_VISIBLE = "html"
for _tag in H.HIDDEN:
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"


@query(f"SELECT page_id, len({_VISIBLE})::INT AS size, md5({_VISIBLE}) AS visible FROM pages")
def hidden_block_strip(t: Tables) -> DataFrame:
    seen = H.visible(F.col("html"))
    return t.pages.select("page_id", F.length(seen).alias("size"), F.md5(seen.cast("binary")).alias("visible"))


@query()
def readable_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", H.readable(F.col("html")).alias("text"))


@query()
def density_gate(t: Tables) -> DataFrame:
    """A page of 200 words or more must give at least a fifth of them as readable text."""
    own = t.pages.select("page_id", F.size(T.words(H.stripped(F.col("html")))).alias("words"), H.readable(F.col("html")).alias("text"))
    return own.select("page_id", "words", F.size(T.words(F.col("text"))).alias("kept")).withColumn("dense", (F.col("words") < 200) | (F.col("kept") * 5 >= F.col("words")))


_SIGNALS = {"vendor_registry": ("partner", "certified", "the "), "b2b_directory_audit": ("review", "rating", "und "), "community_and_social": ("comments", "posted", "que ")}
_SIGHT = f"""WITH s AS (SELECT {_HOST.format("url")} AS domain, url, {", ".join(f"({' + '.join(f'contains(lower(html), {quoted(x)})::INT' for x in v)}) / {float(len(v))}::DOUBLE AS {k}" for k, v in _SIGNALS.items())} FROM pages),
d AS (SELECT domain, count(*)::BIGINT AS sightings, {", ".join(f"round(sum({k}), 6) AS {k}" for k in _SIGNALS)}, array_to_string(list_slice(list_sort(list(DISTINCT url)), 1, 5), ' ') AS samples FROM s GROUP BY 1)"""
_TOP = f"""r AS (SELECT d.*, greatest({", ".join(_SIGNALS)}) AS best, list_sort([{", ".join(_SIGNALS)}])[2] AS second,
  CASE {" ".join(f"WHEN {k} = greatest({', '.join(_SIGNALS)}) THEN '{k}'" for k in _SIGNALS)} END AS category FROM d),
p AS (SELECT domain, sightings, category, round(least(1, best / greatest(1, sightings / 2)), 6) AS confidence, best, second, samples FROM r)"""


@query(f"{_SIGHT}, {_TOP} SELECT domain, sightings, category, confidence, samples FROM p WHERE sightings >= {vocab.REGISTRY_SIGHTINGS}")
def registry_proposals(t: Tables) -> DataFrame:
    seen = registry.sightings(t.pages, url="url", text="html", signals=_SIGNALS)
    return registry.proposals(seen, _SIGNALS).select("domain", "sightings", "category", "confidence", "samples")


_PROVEN = "CASE WHEN contains(lower(samples), '/careers') OR contains(lower(samples), '/jobs') OR contains(lower(samples), 'jobposting') THEN 'ats_requisitions' WHEN contains(lower(samples), '/comments') OR contains(lower(samples), '/thread') THEN 'community_and_social' END"
_KEPT = f"""{_SIGHT}, {_TOP}, k AS (SELECT domain, coalesce({_PROVEN}, CASE WHEN confidence >= {vocab.REGISTRY_CONFIDENCE} AND best >= {vocab.REGISTRY_LEAD} * second THEN category END) AS category FROM p WHERE sightings >= {vocab.REGISTRY_SIGHTINGS})"""


def _promoted(t: Tables) -> DataFrame:
    return registry.promotions(registry.proposals(registry.sightings(t.pages, url="url", text="html", signals=_SIGNALS), _SIGNALS)).select("domain", "category")


@query(f"{_KEPT} SELECT domain, category FROM k WHERE category IS NOT NULL")
def registry_promotions(t: Tables) -> DataFrame:
    return _promoted(t)


@query(f"""{_KEPT}, old AS (SELECT DISTINCT domain, 'vendor_registry' AS category, 'manual' AS promoted_by FROM s WHERE len(domain) % 3 = 0),
g AS (SELECT * FROM old UNION ALL SELECT domain, category, 'auto' FROM k WHERE category IS NOT NULL AND domain NOT IN (SELECT domain FROM old))
SELECT domain, category, promoted_by FROM g WHERE len(domain) % 5 <> 0""")
def registry_growth(t: Tables) -> DataFrame:
    """The registry after a pass that promotes and demotes."""
    domains = t.pages.select(U.host(F.col("url")).alias("domain")).distinct()
    old = domains.where(F.length("domain") % 3 == 0).select("domain", F.lit("vendor_registry").alias("category"), F.lit("manual").alias("promoted_by"))
    return registry.grown(old, _promoted(t), domains.where(F.length("domain") % 5 == 0))
