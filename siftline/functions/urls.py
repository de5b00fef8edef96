"""URL functions, Column to Column: canonical form, attribution to an entity, and what kind of page it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions.text import any_of, contains_any, let


def host(url: Column) -> Column:
    """Lower-cased, with its port, without ``www.``; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, dropped: tuple[str, ...] = vocab.TRACKING_PARAMS) -> Column:
    """Lower-cased scheme and host, no trailing slash, no fragment, no tracking parameters."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    netloc = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*dropped)), "&")
    return F.concat(scheme, F.lit("://"), netloc, F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def posting(url: Column) -> Column:
    """Whether a URL names one posting: a posting path whose slug reads as a title, and no listing or search."""
    low = F.lower(url)
    name = F.regexp_extract(low, vocab.POSTING_PATH, 1)
    return (name != "") & F.contains(name, F.lit("-")) & ~F.endswith(name, F.lit("jobs")) & ~low.rlike(vocab.LISTING_PATH) & ~low.rlike(vocab.LISTING_QUERY)


def category(url: Column, promoted: Column | None = None) -> Column:
    """The evidence category of a page: what the registry promoted it to, else the first rule that fits."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    case_study = low.rlike(vocab.CASE_STUDY_PATH)
    rules = (
        F.when(low == "", "general_web")
        .when(contains_any(low, vocab.REGISTRY_HOSTS) & (contains_any(low, ("partner", "/customers", "/success")) | case_study), "vendor_registry")
        .when(contains_any(low, vocab.REVIEW_HOSTS), "b2b_directory_audit")
        .when(contains_any(low, vocab.COMMUNITY_HOSTS), "community_and_social")
        .when(contains_any(host(low), vocab.ATS_HOSTS) | posting(low), "ats_requisitions")
        .when(case_study, "first_party_case_study")
        .when(low.rlike(vocab.PRACTICE_PATH), "first_party_practice")
        .otherwise("general_web")
    )
    return rules if promoted is None else F.coalesce(promoted, rules)


def _named(slug: Column) -> Column:
    name = F.replace(slug, F.lit("-"), F.lit("_"))
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(name, F.lit(".com")))


def entity(url: Column) -> Column:
    """The entity a URL is about: a board's or registry's slug, a platform's host, a review's slug, else the host without service prefixes."""
    raw = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    full = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    h = host(full)
    parts = F.filter(F.split(path(full), "/"), lambda p: p != "")
    registry = F.filter(parts, lambda p: ~p.isin("partners", "en-us", "marketplace"))
    review = F.filter(parts, lambda p: ~p.isin("profile", "it-services", "products"))
    in_registry = contains_any(h, vocab.REGISTRY_HOSTS) & F.array_contains(parts, "partners") & (F.size(registry) > 0)
    bare = F.coalesce(*[F.when(F.startswith(h, F.lit(p)) & (F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) >= 2), F.substr(h, F.lit(len(p) + 1))) for p in vocab.SERVICE_PREFIXES], h)
    plain = F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9_.-]+", "_"), "^[_.]+|[_.]+$", "")
    is_url = F.contains(raw, F.lit("/"))
    return (
        F.when(raw == "", "unknown_entity")
        .when(is_url & contains_any(h, vocab.ATS_SLUG_HOSTS) & (F.size(parts) > 0), _named(F.get(parts, F.lit(0))))
        .when(is_url & in_registry, _named(F.element_at(registry, -1)))
        .when(is_url & contains_any(h, vocab.PLATFORM_HOSTS), h)
        .when(is_url & contains_any(h, vocab.REGISTRY_HOSTS), h)
        .when(is_url & contains_any(h, ("clutch.co", "g2.com")) & (F.size(review) > 0), _named(F.element_at(review, -1)))
        .when(is_url & (h != ""), bare)
        .otherwise(F.when(plain == "", "unknown_entity").otherwise(plain))
    )


def surface(url: Column, surfaces: dict[str, tuple[str, ...]]) -> Column:
    """The first surface one of whose patterns is in the path; empty if none."""
    p = F.lower(path(url))
    return F.coalesce(*[F.when(contains_any(p, patterns), F.lit(name)) for name, patterns in surfaces.items()], F.lit(""))


def depth(url: Column) -> Column:
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.length(trimmed) - F.length(F.replace(trimmed, F.lit("/"), F.lit("")))


def is_source_host(h: Column) -> Column:
    """Hosts that publish about entities and are none themselves."""
    return any_of([contains_any(h, group) for group in (vocab.REGISTRY_HOSTS, vocab.REVIEW_HOSTS, vocab.COMMUNITY_HOSTS, vocab.ATS_HOSTS, vocab.PLATFORM_HOSTS, vocab.JOB_BOARD_HOSTS)])


def linked_domains(text: Column) -> Column:
    """Firms' domains linked in a text, in order of appearance."""
    hosts = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"https?://([a-z0-9][a-z0-9.-]{2,80})"), F.lit(1)), lambda h: F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r"[.-]+$", ""))
    return F.array_distinct(F.filter(hosts, lambda h: any_of([F.endswith(h, F.lit(s)) for s in vocab.ENTITY_SUFFIXES]) & ~is_source_host(h)))


def is_noise_host(h: Column) -> Column:
    """Hosts of paper publishers, which are never evidence about a firm."""
    return contains_any(F.lower(F.coalesce(h, F.lit(""))), vocab.NOISE_HOSTS)


def is_content_path(url: Column) -> Column:
    """Whether a page lies in a section of articles, which a host publishes but which isn't about it."""
    return F.coalesce(path(url).rlike(vocab.CONTENT_PATH), F.lit(False))


def is_directory(key: Column) -> Column:
    """Whether an entity's own host is a directory of firms."""
    own = F.trim(F.coalesce(key, F.lit("")))
    return F.contains(own, F.lit(".")) & (category(F.concat(F.lit("https://"), own)) == "b2b_directory_audit")


def attributed_entity(url: Column, text: Column, explicit: Column) -> Column:
    """The entity a record is filed under: what it names itself, else its URL's; for a page of a source host the first firm it links, and none if there is none on platforms, boards and registries."""

    def placed(x: Column) -> Column:
        closed = any_of([contains_any(x["key"], g) for g in (vocab.PLATFORM_HOSTS, vocab.JOB_BOARD_HOSTS, vocab.REGISTRY_HOSTS)])
        return F.when(~is_source_host(x["key"]), x["key"]).when(x["named"].isNotNull(), x["named"]).when(closed, F.lit("")).otherwise(x["key"])

    found = let(F.struct(entity(url).alias("key"), F.get(linked_domains(F.coalesce(text, F.lit(""))), F.lit(0)).alias("named")), placed)
    return F.coalesce(F.nullif(F.trim(explicit), F.lit("")), found)


def candidate_entities(url: Column, text: Column) -> Column:
    """All entities that a page could be filed under: its host, or for source hosts and case studies the firms that it links; and a case study's last path part if that is a domain."""
    none = F.array().cast("array<string>")
    slug = F.lower(F.element_at(F.filter(F.split(path(url), "/"), lambda p: p != ""), -1))
    own = F.struct(
        host(F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))).alias("host"), linked_domains(F.coalesce(text, F.lit(""))).alias("linked"),
        F.lower(path(url)).rlike(vocab.CASE_STUDY_PATH).alias("study"), slug.alias("slug"),
    )

    def every(x: Column) -> Column:
        good = F.length(x["slug"]).between(3, 30) & ~x["slug"].isin(*vocab.SLUG_STOP) & F.contains(x["slug"], F.lit(".")) & ~is_source_host(x["slug"])
        more = F.when(x["study"], F.concat(x["linked"], F.when(F.coalesce(good, F.lit(False)), F.array(x["slug"])).otherwise(none))).otherwise(none)
        return F.when(x["host"] == "", none).when(is_source_host(x["host"]), x["linked"]).otherwise(F.concat(F.array(x["host"]), more))

    return F.array_distinct(let(own, every))


def entity_domain(name: Column) -> Column:
    """The host that an entity key is, if it has a label of two letters or more before its last dot; else empty."""
    h = F.trim(F.substring_index(entity(name), "/", 1), F.lit("."))
    return let(h, lambda x: F.when(F.length(F.regexp_extract(x, r"^(.*)\.[^.]*$", 1)) >= 2, x).otherwise(F.lit("")))


def attribution_terms(name: Column) -> Column:
    """What a page must say to be about an entity: its key, or its first label if that is long enough to be a name."""

    def terms(key: Column) -> Column:
        label = F.substring_index(key, ".", 1)
        return F.when((F.length(label) >= vocab.ATTRIBUTION_CHARS) & (label != key), F.array(key, label)).otherwise(F.array(key))

    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(let(F.lower(entity(name)), terms))


def is_attributed(text: Column, uri: Column, name: Column) -> Column:
    """Whether a record is about an entity: its address holds a term, or its text says one as a word (a term with digits: not inside other words)."""
    low, where = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(uri, F.lit("")))

    def said(term: Column) -> Column:
        exact = F.regexp_like(low, F.concat(F.lit(r"(?<![\w-])\Q"), term, F.lit(r"\E(?![\w-])")))
        return F.contains(where, term) | F.when(term.rlike("[0-9]"), exact).otherwise(F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" "))))

    return F.exists(attribution_terms(name), said)


def story_entity(url: Column, vendors: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    """(entity, vendor) of a vendor's customer story: the path part after one of the vendor's story paths, without endings and numbers; vendors: name -> host, story paths."""
    h, p = host(url), F.lower(path(url))
    found = F.lit(None).cast("struct<entity: string, vendor: string>")
    for vendor, (own, marks) in reversed(vendors.items()):
        slug = F.lit("")
        for mark in reversed(marks):
            tail = F.regexp_extract(p, rf"\Q{mark}\E/*([^/]*)", 1)
            bare = F.regexp_replace(F.regexp_replace(tail, r"\.(html?|php|aspx)$", ""), r"[-_](?:\d{4,}|[0-9a-f]{8,})$", "")
            slug = F.when(F.length(bare) >= 3, bare).otherwise(slug)
        found = F.when((h == own) | F.endswith(h, F.lit(f".{own}")), F.struct(F.replace(slug, F.lit("-"), F.lit("_")).alias("entity"), F.lit(vendor).alias("vendor"))).otherwise(found)
    return found


def could_name(url: Column, name: Column, vendors: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    """Whether a story's address could name an entity: its first label stands in the slug, path or host, as it is or without signs."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(story_entity(url, vendors)["entity"], F.lit("")), path(url), host(url)))
    squashed = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    own = F.struct(F.lower(F.substring_index(entity(name), ".", 1)).alias("label"), hay.alias("hay"))
    return let(own, lambda x: (x["label"] == "") | F.contains(x["hay"], x["label"]) | F.contains(squashed(x["hay"]), squashed(x["label"])))


def surface_urls(surface: str, domain: Column, paths: dict[str, tuple[str, ...]], templates: dict[str, tuple[str, ...]]) -> Column:
    """Addresses to try for a surface of a firm: paths on its own host, else templates of its domain, slug and origin."""
    values = {"domain": domain, "slug": F.substring_index(domain, ".", 1), "origin": F.concat(F.lit("https://"), domain)}

    def filled(template: str) -> Column:
        out = F.lit(template)
        for key, value in values.items():
            out = F.replace(out, F.lit(f"{{{key}}}"), value)
        return out

    made = [filled("https://{domain}" + p) for p in paths[surface]] if surface in paths else [filled(t) for t in templates.get(surface, ())]
    return F.array(*made) if made else F.array().cast("array<string>")


def question_site(url: Column) -> Column:
    """The site name of a question-and-answer host; null for others."""
    h = host(url)
    known = F.element_at(F.create_map(*[F.lit(x) for pair in vocab.QUESTION_SITES.items() for x in pair]), h)
    return F.coalesce(known, F.when(F.endswith(h, F.lit(".stackexchange.com")), F.regexp_replace(h, r"\.stackexchange\.com$", "")))


def record_id(uri: Column, title: Column, slug) -> Column:
    """An id from the host and up to eight words of the title; ``slug`` makes it fit."""
    base = F.coalesce(F.nullif(host(uri), F.lit("")), uri)
    words = F.slice(F.split(F.trim(F.regexp_replace(title, r"\s+", " ")), " "), 1, 8)
    return slug(F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat(base, F.lit("-"), F.array_join(words, "-"))).otherwise(base))
