"""Queries that parse small foreign texts, made from pages, orders and documents, and that attribute records to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import html as H
from siftline.functions import parse as P
from siftline.functions import text as T
from siftline.functions import urls as U
from siftline.operators import capture, runs
from siftline.queries.base import Tables, query, sql_any
from siftline.queries.pages import _ENTITY, _HOST, _PARTS, _PATH

_ROBOTS = "concat('User-agent: other\nDisallow: /hidden\n\n# all\nUser-Agent: *\nUser-agent: bot\nDisallow: /p', CAST(page_id % 7 AS VARCHAR(9)), ' # no\nAllow: /p', CAST(page_id % 7 AS VARCHAR(9)), '/open\nDisallow:\n', CASE WHEN page_id % 2 = 0 THEN 'User-agent: late\nDisallow: /late\n' ELSE 'Disallow: /more\n' END)"


@query("""SELECT page_id, '/p' || (page_id % 7) || '/open' AS allow, '/p' || (page_id % 7) || CASE WHEN page_id % 2 = 1 THEN ' /more' ELSE '' END AS disallow FROM pages""")
def robots_parse(t: Tables) -> DataFrame:
    """Rules for everyone in a robots text of several groups."""
    rules = t.pages.select("page_id", P.robots(F.expr(_ROBOTS)).alias("r"))
    return rules.select("page_id", F.array_join("r.allow", " ").alias("allow"), F.array_join("r.disallow", " ").alias("disallow"))


_MAP = """CASE WHEN page_id % 3 = 0 THEN concat('<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> ', url, '/map.xml </loc></sitemap><sitemap></sitemap></sitemapindex>')
  ELSE concat('<x:urlset xmlns:x="http://x"><x:url><x:loc>', url, '</x:loc><x:lastmod>2024-01-0', CAST(page_id % 9 + 1 AS VARCHAR(9)), '</x:lastmod></x:url><x:url>\n<x:loc>', url, '/b</x:loc></x:url><x:url><x:loc> </x:loc></x:url></x:urlset>') END"""


@query("""SELECT page_id, url || '/map.xml' AS loc, NULL::VARCHAR AS lastmod, true AS is_index FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, url, '2024-01-0' || (page_id % 9 + 1), false FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, url || '/b', NULL, false FROM pages WHERE page_id % 3 <> 0""")
def sitemap_parse(t: Tables) -> DataFrame:
    own = t.pages.select("page_id", P.sitemap(F.expr(_MAP)).alias("m"))
    files = own.select("page_id", F.explode("m.sitemaps").alias("loc")).select("page_id", "loc", F.lit(None).cast("string").alias("lastmod"), F.lit(True).alias("is_index"))
    return files.unionByName(own.select("page_id", F.explode("m.pages").alias("p")).select("page_id", "p.*", F.lit(False).alias("is_index")))


_INDEX = """CASE page_id % 3 WHEN 0 THEN concat('[["urlkey","timestamp","original","statuscode","length"],["k","2024010', CAST(page_id % 9 + 1 AS VARCHAR(9)), '","', url, '","200","12"],["k","","x","200","1"]]')
  WHEN 1 THEN concat('[["2023","', url, '"],["2022","',  url, '","404","7"]]') ELSE '{"rows": []}' END"""


@query("""SELECT page_id, '2024010' || (page_id % 9 + 1) AS timestamp, url AS original, '200' AS status, '12' AS length FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, '2023', url, '', '' FROM pages WHERE page_id % 3 = 1 UNION ALL SELECT page_id, '2022', url, '404', '7' FROM pages WHERE page_id % 3 = 1""")
def capture_index(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(P.captures(F.expr(_INDEX))).alias("c")).select("page_id", "c.*")


@query("SELECT page_id, 'https://web.archive.org/web/' || (20240101 + page_id % 28) || 'id_/' || url AS archived, url AS original, (20240101 + page_id % 28)::VARCHAR AS timestamp FROM pages")
def archive_metadata(t: Tables) -> DataFrame:
    """Addresses of captures, made and taken apart again."""
    own = t.pages.select("page_id", P.capture_url(F.col("url"), F.lit(20240101) + F.col("page_id") % 28).alias("archived"))
    return own.select("page_id", "archived", P.capture_parts(F.col("archived")).alias("c")).select("page_id", "archived", "c.*")


_TIMES = "CASE event_id % 4 WHEN 0 THEN concat(replace(CAST(date_trunc('second', ts) AS VARCHAR(32)), ' ', 'T'), 'Z') WHEN 1 THEN concat(CAST(date_trunc('second', ts) AS VARCHAR(32)), '+02:00') WHEN 2 THEN 'not a time' ELSE substr(CAST(ts AS VARCHAR(32)), 1, 10) END"


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts)) WHEN 1 THEN epoch(date_trunc('second', ts)) - 7200 WHEN 3 THEN epoch(date_trunc('day', ts)) END::DOUBLE AS seconds FROM events""")
def iso_epoch(t: Tables) -> DataFrame:
    return t.events.select("event_id", P.epoch(F.expr(_TIMES)).alias("seconds"))


def _ld_page(t: Tables) -> DataFrame:
    """Pages with JSON-LD made of their own titles, addresses and paragraphs: a broken block, then a graph in which a source's posting goes before the firm's."""
    title, told = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", "<p>([^<]{40,})", 1)
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), '(?s)^\\{"x":(.*)\\}$', 1)
    firm = F.when(F.col("page_id") % 3 == 0, F.to_json(F.struct(title.alias("name"), F.col("url").alias("sameAs")))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("["), F.to_json(F.struct(F.col("url"))), F.lit("]"))).otherwise(quoted(title))
    graph = F.concat(
        F.lit('{"@graph":[{"@type":"JobPosting","hiringOrganization":{"url":"https://www.linkedin.com/company/x"}},[{"@type":["Thing","JobPosting"],"hiringOrganization":'), firm, F.lit(',"description":'), quoted(title),
        F.lit('}],{"@type":"Article","articleBody":'), quoted(told), F.lit('},{"@type":"Person","text":'), quoted(F.repeat(told, 2)), F.lit("}]}"),
    )
    block = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    return t.pages.select("page_id", F.concat(block(F.lit("{broken")), block(graph), "html").alias("html"))


@query(rf"""WITH p AS (SELECT page_id, {_HOST.format("url")} AS host, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_extract(html, '<p>([^<]{{40,}})', 1), '\s+', ' ', 'g')) AS told FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 1 THEN '' ELSE title END AS employer, CASE WHEN page_id % 3 < 2 AND NOT ({sql_any("host", vocab.PLATFORM_HOSTS)}) THEN host ELSE '' END AS domain, CASE WHEN length(told) > length(title) THEN told ELSE title END AS description FROM p""")
def json_ld(t: Tables) -> DataFrame:
    """Who hires and what a page is about, from its JSON-LD; source hosts are no employer's, and a posting that names no firm is passed over."""
    return _ld_page(t).select("page_id", P.ld(F.col("html")).alias("d")).select("page_id", "d.*")


@query("""SELECT doc_id AS id, '{"chars":' || length(coalesce(text, '')) || ',"md5":"' || md5(coalesce(text, '')) || '"}' AS found FROM documents WHERE doc_id % 8 <> 7 UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id % 8 = 7""")
def answer_json(t: Tables) -> DataFrame:
    """The JSON inside answers whose prose is the documents' own: bare, fenced, after other brackets, with a spare comma, with a quote that is left open, or missing."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 8
    told = F.to_json(F.struct(F.length(text).alias("chars"), F.md5(text.cast("binary")).alias("md5")))
    spare = F.regexp_replace(told, r"\}$", ", }")
    prose = F.translate(text, "[]{}`", "()()'")
    answer = (
        F.when(kind == 0, told).when(kind == 1, F.concat(prose, F.lit("\n```json\n"), told, F.lit("\n```\n"), prose)).when(kind == 2, F.concat(F.lit("{not this} "), prose, told, F.lit(" or [1]")))
        .when(kind == 3, F.concat(prose, spare)).when(kind == 4, F.concat(F.lit('{ " '), prose, told, prose)).when(kind == 5, F.concat(F.lit("```\n"), spare, F.lit("```"))).when(kind == 6, F.concat(F.lit("[["), told, prose)).otherwise(prose)
    )
    return t.documents.select(F.col("doc_id").alias("id"), P.answer(answer).alias("found"))


@query("""SELECT o_orderkey AS id, sha256('{"custkey":' || o_custkey || ',"note":null,"status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def json_digest(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), T.digest(P.canonical_json({"status": F.col("o_orderstatus"), "custkey": F.col("o_custkey"), "note": F.lit(None).cast("string")})).alias("digest"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def body_decode(t: Tables) -> DataFrame:
    """All texts as bodies in UTF-8, Latin-1 or UTF-16, with and without saying so; only those that Latin-1 can write are sent in it."""
    text, kind = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    own = t.documents.select("doc_id", text.alias("text"), F.when(text.rlike("[^\\x00-\\x7F\\u00A0-\\u00FF]"), kind % 2).otherwise(kind).alias("kind"))
    raw = F.when(F.col("kind") == 0, F.encode("text", "UTF-8")).when(F.col("kind") == 1, F.encode("text", "UTF-16LE")).otherwise(F.encode("text", "ISO-8859-1"))
    said = F.when(F.col("kind") == 0, "text/plain; charset=no-such").when(F.col("kind") == 1, "text/plain; charset=utf-16-le").when(F.col("kind") == 2, "text/plain; charset=ISO-8859-1").otherwise("text/plain")
    return own.select("doc_id", F.md5(P.body(raw, said).cast("binary")).alias("text"))


_WORD = r"regexp_extract(html, '<title>\s*([^<\s&]*)', 1)"


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, {_WORD} AS word FROM pages)
SELECT page_id, '<p> ' || title || '  ' || '  ' || CASE WHEN length(word) >= 3 AND lower(regexp_replace(word, '[^A-Za-z0-9]+', '', 'g')) NOT IN ({", ".join(f"'{g}'" for g in vocab.GENERIC_ALTS)}) THEN ' ' || word || ' ' ELSE ' ' END || '<img src=x></p>' AS shown FROM p WHERE length(title) >= 5 AND NOT contains(title, '"')""")
def image_alts(t: Tables) -> DataFrame:
    """Images that pages' titles, a kind of image, an entity and single words of titles stand for."""
    title, word = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", r"<title>\s*([^<\s&]*)", 1)
    own = t.pages.select("page_id", title.alias("title"), word.alias("word")).where((F.length("title") >= 5) & ~F.contains("title", F.lit('"')))
    images = F.concat(F.lit('<p><img src=x alt="'), "title", F.lit('" w=1> <IMG ALT="Logo"><img alt=\'&amp;&#39;\'/><img alt="'), "word", F.lit('"><img src=x></p>'))
    return own.select("page_id", P.exposed_alts(images).alias("shown"))


# --- attribution --------------------------------------------------------------------------------------
#: Both engines read these. Records are made of the first two words of pages' titles, which also decide of what kind they are.
_W1 = "coalesce(nullif(lower(regexp_extract(html, '<title> *([A-Za-z]+)', 1)), ''), 'firm')"
_W2 = "coalesce(nullif(lower(regexp_extract(html, '<title> *[^ <]+ +([A-Za-z]+)', 1)), ''), 'other')"
_SRC = """CASE length(w1) % 8 WHEN 0 THEN concat('https://www.reddit.com/r/', w1, '-s/x') WHEN 1 THEN concat('https://www.', w1, '.com/case-studies/', w2, '.io') WHEN 2 THEN concat('https://x', w1, '.net/blog/', w2) WHEN 3 THEN concat('https://clutch.co/profile/', w1, '-', w2)
  WHEN 4 THEN concat('https://oup.com/', w1) WHEN 5 THEN concat('https://math.stackexchange.com/questions/', w2) WHEN 6 THEN concat('https://careers.', w1, '.com/jobs') ELSE url END"""
_SAYS = "CASE WHEN length(w2) % 3 = 0 THEN concat(w2, ' links to nobody') ELSE concat(w1, ': see https://www.', w1, '-', w2, '.com/a, https://github.com/', w2, ' and https://', w2, '.io.') END"
_OWN = "CASE WHEN length(w2) % 7 = 0 THEN concat(' ', w2, '.net ') ELSE '' END"
_NAME = "CASE length(w2) % 4 WHEN 0 THEN concat('https://www.', w1, w2, '.com/about') WHEN 1 THEN concat(w1, '.io') WHEN 2 THEN concat(w1, '.', w2, '. & co.') ELSE '' END"
_SOURCE_HOSTS = (*vocab.REGISTRY_HOSTS, *vocab.REVIEW_HOSTS, *vocab.COMMUNITY_HOSTS, *vocab.ATS_HOSTS, *vocab.PLATFORM_HOSTS, *vocab.JOB_BOARD_HOSTS)
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_LINKED = (
    r"list_filter(list_transform(regexp_extract_all(lower(text), 'https?://([a-z0-9][a-z0-9.-]{2,80})', 1), lambda x: regexp_replace(regexp_replace(x, '^www\.', ''), '[.-]+$', '')), lambda x: "
    + "(" + " OR ".join(f"ends_with(x, '{e}')" for e in vocab.ENTITY_SUFFIXES) + f") AND NOT {sql_any('x', _SOURCE_HOSTS)})"
)
_PLAIN = r"regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')"
_MADE = f"""w AS (SELECT page_id, url, {_W1} AS w1, {_W2} AS w2 FROM pages), m AS (SELECT page_id, {_SRC} AS src, {_SAYS} AS text, {_OWN} AS own, {_NAME} AS name, w1, w2 FROM w),
r AS (SELECT *, {_HOST.format("lower(src)")} AS h, {_PARTS.replace("src", "lower(src)")} AS parts, {_LINKED} AS every, CASE WHEN contains(name, '/') THEN {_HOST.format("name")} ELSE {_PLAIN} END AS key FROM m)"""
_TERMS = f"CASE WHEN trim(name) = '' THEN [] WHEN length(split_part(key, '.', 1)) >= {vocab.ATTRIBUTION_CHARS} AND split_part(key, '.', 1) <> key THEN [key, split_part(key, '.', 1)] ELSE [key] END"


def _records(t: Tables) -> DataFrame:
    words = t.pages.select("page_id", "url", F.expr(_W1).alias("w1"), F.expr(_W2).alias("w2"))
    return words.select("page_id", F.expr(_SRC).alias("src"), F.expr(_SAYS).alias("text"), F.expr(_OWN).alias("own"), F.expr(_NAME).alias("name"), "w1", "w2")


@query(f"""WITH {_MADE}, k AS (SELECT *, {_ENTITY} AS found FROM r)
SELECT page_id, CASE WHEN trim(own) <> '' THEN trim(own) WHEN NOT {sql_any("found", _SOURCE_HOSTS)} THEN found WHEN len(every) > 0 THEN every[1] WHEN {sql_any("found", (*vocab.PLATFORM_HOSTS, *vocab.JOB_BOARD_HOSTS, *vocab.REGISTRY_HOSTS))} THEN '' ELSE found END AS entity FROM k""")
def entity_attribution(t: Tables) -> DataFrame:
    """The entity that each record is filed under."""
    return _records(t).select("page_id", U.attributed_entity(F.col("src"), F.col("text"), F.col("own")).alias("entity"))


@query(f"""WITH {_MADE}, l AS (SELECT *, {_ONCE.format("every")} AS linked, lower(regexp_extract(src, '([^/?#]*)/*([?#].*)?$', 1)) AS slug FROM r),
c AS (SELECT page_id, CASE WHEN h = '' THEN [] WHEN {sql_any("h", _SOURCE_HOSTS)} THEN linked ELSE list_concat([h], CASE WHEN regexp_matches(array_to_string(list_concat([''], parts), '/'), '{vocab.CASE_STUDY_PATH}') THEN
  list_concat(linked, CASE WHEN length(slug) BETWEEN 3 AND 30 AND slug NOT IN ({", ".join(f"'{x}'" for x in vocab.SLUG_STOP)}) AND contains(slug, '.') AND NOT {sql_any("slug", _SOURCE_HOSTS)} THEN [slug] ELSE [] END) ELSE [] END) END AS e FROM l)
SELECT page_id, array_to_string({_ONCE.format("e")}, ' ') AS entities FROM c""")
def candidate_entities(t: Tables) -> DataFrame:
    return _records(t).select("page_id", F.array_join(U.candidate_entities(F.col("src"), F.col("text")), " ").alias("entities"))


@query(f"""WITH {_MADE} SELECT page_id, {sql_any("h", vocab.NOISE_HOSTS)} AS noise, regexp_matches({_PATH.format("src")}, '{vocab.CONTENT_PATH}') AS content,
  CASE {" ".join(f"WHEN h = '{k}' THEN '{v}'" for k, v in vocab.QUESTION_SITES.items())} WHEN ends_with(h, '.stackexchange.com') THEN left(h, length(h) - 18) END AS site, {sql_any("h", _SOURCE_HOSTS)} AS source_host FROM r""")
def host_rules(t: Tables) -> DataFrame:
    """Noise hosts, paths of articles, question sites, hosts of sources."""
    src = F.col("src")
    return _records(t).select("page_id", U.is_noise_host(U.host(src)).alias("noise"), U.is_content_path(src).alias("content"), U.question_site(src).alias("site"), U.is_source_host(U.host(src)).alias("source_host"))


@query(rf"""WITH {_MADE} SELECT page_id, CASE WHEN length(regexp_extract(trim(key, '.'), '^(.*)\.[^.]*$', 1)) >= 2 THEN trim(key, '.') ELSE '' END AS domain, array_to_string({_TERMS}, ' ') AS terms FROM r WHERE trim(name) <> ''
UNION ALL SELECT page_id, '', '' FROM r WHERE trim(name) = ''""")
def entity_domains(t: Tables) -> DataFrame:
    """Domains of entities, and what a page must say to be about them."""
    name = F.col("name")
    return _records(t).select("page_id", U.entity_domain(name).alias("domain"), F.array_join(U.attribution_terms(name), " ").alias("terms"))


@query(f"""WITH {_MADE} SELECT page_id, len(list_filter({_TERMS}, lambda x: contains(lower(src), x) OR CASE WHEN regexp_matches(x, '[0-9]') THEN regexp_matches(lower(text), '(^|[^a-z0-9_-])' || x || '($|[^a-z0-9_-])') ELSE contains(' ' || lower(text) || ' ', ' ' || x || ' ') END)) > 0 AS attributed FROM r""")
def attribution_filter(t: Tables) -> DataFrame:
    """Whether a record is about the entity that it was found for: by its address, or by a word of its text."""
    return _records(t).select("page_id", U.is_attributed(F.col("text"), F.col("src"), F.col("name")).alias("attributed"))


@query(f"WITH {_MADE} SELECT count(*) FILTER (h = '' OR NOT {sql_any('h', _SOURCE_HOSTS)})::BIGINT AS kept, count(*) FILTER ({sql_any('h', _SOURCE_HOSTS)})::BIGINT AS dropped, length(w1) % 8 AS kind FROM r GROUP BY 3")
def attribution_split(t: Tables) -> DataFrame:
    """How many records of each kind lie on hosts of firms, and how many are dropped as those of sources."""
    source = U.is_source_host(U.host(F.col("src")))
    return _records(t).groupBy((F.length("w1") % 8).cast("long").alias("kind")).agg(F.count_if(~source).alias("kept"), F.count_if(source).alias("dropped"))


@query(f"""WITH {_MADE}, k AS (SELECT *, CASE WHEN length(w2) % 3 = 0 THEN w1 ELSE h END AS own_key FROM r)
SELECT page_id, contains(own_key, '.') AND {sql_any("own_key", vocab.REVIEW_HOSTS)} AND NOT {sql_any("own_key", vocab.REGISTRY_HOSTS)} AS directory, {sql_any("lower(w1 || ' case study ' || text)", vocab.PRACTICE_SIGNALS)} AS practice FROM k""")
def directory_hosts(t: Tables) -> DataFrame:
    """Entities that are directories, and texts that speak of a practice."""
    key = F.when(F.length("w2") % 3 == 0, F.col("w1")).otherwise(U.host(F.col("src")))
    text = F.concat(F.col("w1"), F.lit(" case study "), F.col("text"))
    return _records(t).select("page_id", U.is_directory(key).alias("directory"), T.contains_any(F.lower(text), vocab.PRACTICE_SIGNALS).alias("practice"))


@query(f"SELECT page_id, {_HOST.format('url')} AS host FROM pages WHERE page_id % 5 <> 0 AND {sql_any(_HOST.format('url'), vocab.NOISE_HOSTS)} UNION ALL SELECT page_id, 'journals.' || (['oup.com', 'arxiv.org'])[page_id % 2 + 1] FROM pages WHERE page_id % 5 = 0")
def noise_hosts(t: Tables) -> DataFrame:
    """Pages of publishers; every fifth page stands for one."""
    h = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("journals."), F.when(F.col("page_id") % 2 == 0, "oup.com").otherwise("arxiv.org"))).otherwise(U.host(F.col("url")))
    return t.pages.select("page_id", h.alias("host")).where(U.is_noise_host(F.col("host")))


VENDORS = {"cloud": ("vendor.com", ("/customers/", "/stories/")), "data": ("data.io", ("/case/",))}
_STORY = "CASE s_suppkey % 5 WHEN 0 THEN concat('https://www.vendor.com/customers/Big-Firm-', CAST(s_suppkey % 8 + 1000 AS VARCHAR(9)), '/') WHEN 1 THEN 'https://eu.vendor.com/stories/small_co.html' WHEN 2 THEN 'https://data.io/case/ab' WHEN 3 THEN 'https://data.io/case/third-one/page' ELSE 'https://none.org/customers/x' END"


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'big_firm' WHEN 1 THEN 'small_co' WHEN 2 THEN '' WHEN 3 THEN 'third_one' END AS entity, CASE WHEN s_suppkey % 5 < 2 THEN 'cloud' WHEN s_suppkey % 5 < 4 THEN 'data' END AS vendor,
  s_suppkey % 5 = 0 AS could_be_big_firm FROM supplier""")
def story_entities(t: Tables) -> DataFrame:
    """Whose story a vendor's page tells, and whether it could be that of one firm."""
    own = t.supplier.select(F.col("s_suppkey").alias("id"), F.expr(_STORY).alias("url"))
    return own.select("id", U.story_entity(F.col("url"), VENDORS).alias("s"), U.could_name(F.col("url"), F.lit("bigfirm.com"), VENDORS).alias("could_be_big_firm")).select("id", "s.*", "could_be_big_firm")


@query("""SELECT s_suppkey AS id, u.u AS url FROM supplier, unnest(['https://f' || s_suppkey || '.com/about', 'https://f' || s_suppkey || '.com/company', 'https://boards.io/f' || s_suppkey || '?d=f' || s_suppkey || '.com']) AS u(u)""")
def surface_addresses(t: Tables) -> DataFrame:
    domain = F.concat(F.lit("f"), "s_suppkey", F.lit(".com"))
    paths, templates = {"about": ("/about", "/company")}, {"ats": ("https://boards.io/{slug}?d={domain}",)}
    made = F.concat(*[U.surface_urls(s, domain, paths, templates) for s in ("about", "ats", "none")])
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.explode(made).alias("url"))


@query(f"SELECT page_id, {_HOST.format('url')} || CASE WHEN page_id % 2 = 0 THEN '-One-two-three-4-5-6-7-8' ELSE '' END AS record_id FROM pages WHERE {_HOST.format('url')} <> '' AND NOT regexp_matches({_HOST.format('url')}, '[^A-Za-z0-9.-]')")
def record_ids(t: Tables) -> DataFrame:
    title = F.when(F.col("page_id") % 2 == 0, " One two  three 4 5 6 7 8 9 10")
    host = U.host(F.col("url"))
    return t.pages.where((host != "") & ~host.rlike("[^A-Za-z0-9.-]")).select("page_id", U.record_id(F.col("url"), title, T.slug).alias("record_id"))


# --- records from responses and lists -----------------------------------------------------------------
_LONG = "repeat('words of the posting ', 20)"
_BODY = f"""CASE page_id % 5 WHEN 0 THEN concat('<html><head><title> T', CAST(page_id AS VARCHAR(9)), ' </title><meta name="description" content="sum"></head><body><nav>menu</nav><p>Short page</p><a href="https://out.org/x">go</a></body></html>')
  WHEN 1 THEN concat('<script type="application/ld+json">{{"@type":"JobPosting","hiringOrganization":"Firm","description":"', {_LONG}, '"}}</script><p>tiny</p>') WHEN 2 THEN ' plain text ' WHEN 3 THEN '<nav>only chrome</nav>' ELSE 'binary' END"""
_KIND = "CASE page_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN '' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'text/html' ELSE 'image/png' END"
_FROM = "CASE WHEN page_id % 10 = 0 THEN concat('https://web.archive.org/web/20240102id_/https://a.com/p', CAST(page_id AS VARCHAR(9))) ELSE concat('https://a', CAST(page_id AS VARCHAR(9)), '.com/p') END"


@query(f"""WITH r AS (SELECT page_id, {_FROM} AS url FROM pages WHERE page_id % 5 < 3), h AS (SELECT *, regexp_extract(url, '://([^/]*)', 1) AS host FROM r)
SELECT url AS source_uri, CASE page_id % 5 WHEN 0 THEN 'Short page' || chr(10) || 'go' WHEN 1 THEN trim({_LONG}) ELSE 'plain text' END AS text, CASE WHEN page_id % 5 = 0 THEN 'T' || page_id ELSE host END AS title,
  host || '-' || CASE WHEN page_id % 5 = 0 THEN 'T' || page_id ELSE host END AS item_id,
  array_to_string(list_sort(list_filter(['evidence=fetched', CASE WHEN page_id % 5 < 2 THEN 'content_type=text/html' END, CASE WHEN page_id % 5 = 0 THEN 'outbound_hosts=out.org' END, CASE WHEN page_id % 5 = 0 THEN 'meta_description=sum' END,
    CASE WHEN page_id % 5 = 1 THEN 'hiring_organization=Firm' END, CASE WHEN page_id % 10 = 0 THEN 'original_url=https://a.com/p' || page_id END, CASE WHEN page_id % 10 = 0 THEN 'snapshot_timestamp=20240102' END], lambda x: x IS NOT NULL)), ' ') AS facts FROM h""")
def response_records(t: Tables) -> DataFrame:
    """Responses of several kinds, encodings and addresses as item rows."""
    own = capture.records(t.pages.select(F.expr(_FROM).alias("url"), F.expr(_KIND).alias("content_type"), F.expr(_BODY).cast("binary").alias("body")))
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e.key, F.lit("="), e.value))), " ")
    return own.select("source_uri", "text", "title", "item_id", facts.alias("facts"))


@query("""WITH h AS (SELECT o_custkey % 97 AS name, CASE o_orderkey % 5 WHEN 0 THEN 'firm' || (o_custkey % 7) || '.com' WHEN 1 THEN 'other.io' WHEN 2 THEN 'x.org' END AS domain FROM orders),
c AS (SELECT name, domain, count(*) AS n FROM h WHERE domain IS NOT NULL GROUP BY 1, 2) SELECT name, domain FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, len(domain), domain) = 1""")
def entity_resolution(t: Tables) -> DataFrame:
    """The domain of a name from search hits; social and code hosts don't count."""
    url = "CASE o_orderkey % 5 WHEN 0 THEN concat('https://www.firm', CAST(o_custkey % 7 AS VARCHAR(9)), '.com/a') WHEN 1 THEN 'https://other.io' WHEN 2 THEN 'https://x.org/b' WHEN 3 THEN 'https://github.com/c' ELSE 'https://localhost/d' END"
    return capture.resolved_domains(t.orders.select((F.col("o_custkey") % 97).alias("name"), F.expr(url).alias("url")))


@query("""WITH i AS (SELECT 'e' || (o_custkey % 50) AS entity, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'u' || (o_orderkey % 4) END AS uri, o_orderkey::VARCHAR AS text, o_orderkey AS seq FROM orders)
SELECT entity, coalesce(nullif(uri, ''), entity) AS uri, arg_max(text, seq) AS text FROM i GROUP BY 1, 2""")
def entity_sources(t: Tables) -> DataFrame:
    own = t.orders.select(F.concat(F.lit("e"), F.col("o_custkey") % 50).alias("entity"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("u"), F.col("o_orderkey") % 4)).alias("uri"), F.col("o_orderkey").cast("string").alias("text"), F.col("o_orderkey").alias("seq"))
    return capture.entity_sources(own)


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 1 AND p_partkey % 5 = 0 AND (p_partkey % 2 = 0 OR p_partkey % 7 = 0) AND contains(lower(p_name || ' ' || p_type), 'a')")
def firm_matches(t: Tables) -> DataFrame:
    """Listed firms that are active, of a batch, of a tag or industry, and say a word."""
    key, none = F.col("p_partkey"), F.array().cast("array<string>")
    firm = {
        "status": F.when(key % 3 == 0, "Active").when(key % 3 == 1, "Closed"), "batch": F.when(key % 5 == 0, "W24"), "tags": F.when(key % 2 == 0, F.array(F.lit("Data"))).otherwise(none),
        "industries": F.when(key % 7 == 0, F.array(F.lit("DATA"), F.lit("x"))).otherwise(none), "name": F.col("p_name"), "line": F.lit(None).cast("string"), "text": F.col("p_type"),
    }
    return t.part.where(capture.firm_matches(firm, batch="w24", tags=("data",)) & F.contains(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("a"))).select(key.alias("id"))


@query("""SELECT l_orderkey AS record, array_to_string(list_sort(list(DISTINCT 'q' || (l_linenumber % 3))), ',') AS backed FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY 1""")
def backed_items(t: Tables) -> DataFrame:
    """The checklist items that any quote of a record names in its support."""
    tags = F.when(F.col("l_linenumber") % 4 != 0, F.array(F.concat(F.lit("q"), F.col("l_linenumber") % 3))).otherwise(F.array().cast("array<string>"))
    return runs.backed(t.lineitem.select(F.col("l_orderkey").alias("record"), tags.alias("supports"))).select("record", F.array_join("backed", ",").alias("backed"))


@query("""SELECT s_suppkey AS item_id, CASE s_suppkey % 4 WHEN 0 THEN 'Named' WHEN 1 THEN 'dom.com' WHEN 2 THEN 'firm' || s_suppkey || '.com' ELSE s_suppkey::VARCHAR END AS candidate, CASE WHEN s_suppkey % 3 = 0 THEN 'first second' ELSE 'own text' END AS text FROM supplier""")
def candidate_names(t: Tables) -> DataFrame:
    """What a record is called, and what it says: its own text, or else its quotes."""
    key = F.col("s_suppkey")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    meta = F.when(key % 4 == 0, F.create_map(F.lit("entity"), F.lit(" Named "))).when(key % 4 == 1, F.create_map(F.lit("entity"), F.lit(" "), F.lit("domain"), F.lit("dom.com"))).otherwise(empty)
    uri = F.when(key % 4 == 2, F.concat(F.lit("https://www.firm"), key, F.lit(".com/x")))
    text = runs.record_text(F.when(key % 3 != 0, "own text").otherwise("  "), F.array(F.lit("first"), F.lit("second")))
    return t.supplier.select(key.alias("item_id"), runs.candidate_name(meta, uri, text, key.cast("string")).alias("candidate"), text.alias("text"))


@query("""SELECT o_orderkey % 2 = 0 AS exact, o_orderkey % 3 = 0 AS addressed, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'missing' WHEN 2 THEN 'unreachable' ELSE 'not_checked' END AS live, count(*)::BIGINT AS quotes, count(DISTINCT o_custkey)::BIGINT AS entities FROM orders GROUP BY 1, 2, 3""")
def truth_counts(t: Tables) -> DataFrame:
    """Sampled quotes by whether they are exact, speak to their claim, and still stand on the page."""
    page = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("so "), "o_orderpriority", F.lit(" it is"))).when(F.col("o_orderkey") % 4 == 1, "gone").when(F.col("o_orderkey") % 4 == 2, "")
    own = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("quote"), (F.col("o_orderkey") % 2 == 0).alias("exact"), (F.col("o_orderkey") % 3 == 0).alias("addressed"), page.alias("page"), (F.col("o_orderkey") % 4 != 3).alias("asked"))
    return runs.truth(own)
