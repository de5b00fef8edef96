"""Evidence read-outs: what kinds of proof a dossier's sections carry, and what they leave open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import text as T

KINDS = ("delivery_proof", "named_clients", "stack_delivery", "independent_validation", "delivery_hiring", "commercial_terms", "certification", "engineering_output", "growth_signal", "dated_events")
MARKER = vocab.SECTION_MARK


def technologies(text: Column) -> Column:
    """Capitalised words used inside sentences, without stop words and clients' names, sorted."""
    found = F.regexp_extract_all(text, F.lit(vocab.TECHNOLOGY), F.lit(1))
    clients = F.transform(F.regexp_extract_all(text, F.lit(vocab.CLIENT), F.lit(1)), lambda c: F.split(c, " ")[0])
    return F.array_sort(F.array_except(F.array_distinct(F.filter(found, lambda w: ~F.lower(w).isin(*vocab.NOT_TECHNOLOGIES))), clients))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(dossiers: DataFrame, *, entity: str = "entity", text: str = "text") -> DataFrame:
    """(entity, ord, category, uri, text) of each marked section; text before the first marker is PREAMBLE if it has prose lines."""
    heads = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    bodies = F.split(text, MARKER)
    lead = _strip(F.get(bodies, F.lit(0)))
    has_prose = F.exists(F.split(lead, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.ltrim(x), F.lit("#")))
    made = F.zip_with(heads, F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))), lambda h, b: F.struct(
        F.replace(F.trim(F.regexp_extract(h, MARKER, 1)), F.lit(" "), F.lit("_")).alias("category"), F.trim(F.regexp_extract(h, MARKER, 2)).alias("uri"), _strip(b).alias("text")))
    first = F.when((lead != "") & ((F.size(heads) == 0) | has_prose), F.array(F.struct(F.lit("PREAMBLE").alias("category"), F.lit("").alias("uri"), lead.alias("text"))))
    every = F.concat(F.coalesce(first, F.slice(made, 1, 0)), made)
    return dossiers.select(F.col(entity).alias("entity"), F.posexplode(every).alias("ord", "s")).select("entity", "ord", "s.category", "s.uri", "s.text")


def _signs() -> dict[str, Column]:
    """What one section (category, uri, text) shows."""
    t, c = F.col("text"), F.col("category")
    has = lambda pattern: F.coalesce(t.rlike(pattern), F.lit(False))
    outlet = (c == "COMMUNITY_AND_SOCIAL") | F.contains(F.col("uri"), F.lit("github.com")) | F.contains(F.col("uri"), F.lit("/blog"))
    spoken = c.isin(*vocab.INDEPENDENT) | (c == "ATS_REQUISITIONS") | outlet  # whose words are counted
    return {
        "words": F.when(spoken, T.prose_words(t)), "delivery": has(vocab.DELIVERY), "proof": has(vocab.DELIVERY) & has(vocab.OUTCOME), "client": has(vocab.CLIENT), "stack": F.when(c.isin(*vocab.FIRST_PARTY), F.size(technologies(t)) > 0),
        "terms": has(vocab.COMMERCIAL), "certified": has(vocab.CERTIFIED), "growth": has(vocab.GROWTH), "year": has(vocab.YEAR),
        "vouching": c.isin(*vocab.INDEPENDENT), "hiring": c == "ATS_REQUISITIONS", "outlet": outlet,
    }


def _any(condition: str | Column) -> Column:
    return F.coalesce(F.bool_or(F.col(condition) if isinstance(condition, str) else condition), F.lit(False))


def _kinds() -> list[Column]:
    """A flag for each kind, as aggregates of ``_signs``."""
    prose = F.col("words") >= 20
    return [
        _any("proof").alias("delivery_proof"), _any("client").alias("named_clients"), (_any("stack") & _any("delivery")).alias("stack_delivery"), _any(F.col("vouching") & prose).alias("independent_validation"),
        _any(F.col("hiring") & (F.col("words") >= 10)).alias("delivery_hiring"), _any("terms").alias("commercial_terms"), _any("certified").alias("certification"), _any(F.col("outlet") & prose).alias("engineering_output"),
        (_any("growth") & _any("year")).alias("growth_signal"), _any("year").alias("dated_events"),
    ]


def coverage(parts: DataFrame) -> DataFrame:
    """parts (entity, category, uri, text) -> one row per entity with a flag for each kind; one pass, partial aggregation.

    What a section shows is worked out once, in a generator, which keeps the optimizer from repeating it in each aggregate.
    """
    flags = parts.select("entity", F.inline(F.array(F.struct(*[v.alias(k) for k, v in _signs().items()]))))
    return flags.groupBy("entity").agg(*_kinds())


def missing(tier: str) -> Column:
    """The kinds a tier needs that the flags of ``coverage`` lack."""
    return F.array_compact(F.array(*[F.when(~F.col(k), F.lit(k)) for k in vocab.TIER_MINIMUMS[tier]]))


def capped_tier(tier: Column) -> Column:
    """The best tier not above the claimed one that the kinds support; the lowest tier if none does; other values stay."""
    order = list(vocab.TIER_MINIMUMS)
    ok = {name: reduce(lambda a, b: a & b, [F.col(k) for k in kinds]) for name, kinds in vocab.TIER_MINIMUMS.items()}
    out = tier
    for i, claimed in enumerate(order):
        best = F.coalesce(*[F.when(ok[n], F.lit(n)) for n in order[i:]], F.lit(order[-1]))
        out = F.when(tier == claimed, best).otherwise(out)
    return out


def tier_reasons(tier: str) -> Column:
    """What keeps a claimed tier from being supported, in words; empty if nothing does. The lowest tier's own gaps come last where not even it is supported."""
    need = lambda name: F.transform(missing(name), lambda k: F.concat(F.lit(f"{name} needs "), k))
    own, floor = need(tier), list(vocab.TIER_MINIMUMS)[-1]
    below = [name for name in list(vocab.TIER_MINIMUMS)[list(vocab.TIER_MINIMUMS).index(tier) + 1 :]]
    some = F.lit(False)
    for name in below:
        some = some | (F.size(missing(name)) == 0)
    return F.when(F.size(own) == 0, F.array().cast("array<string>")).when(some, own).otherwise(F.concat(own, need(floor)))


def nearest_bar(bar: str) -> Column:
    """The kinds that keep an entity from a lane's bar: none if it clears the bar or any tier above it, else those of the bar."""
    order = list(vocab.TIER_MINIMUMS)
    clears = [F.size(missing(name)) == 0 for name in order[: order.index(bar) + 1]]
    return F.when(reduce(lambda a, b: a | b, clears), F.array().cast("array<string>")).otherwise(missing(bar))


def claimed_technologies(parts: DataFrame) -> DataFrame:
    """(entity, tech): technologies of first-party sections that speak of delivery."""
    own = parts.where(F.col("category").isin(*vocab.FIRST_PARTY) & F.col("text").rlike(vocab.DELIVERY))
    return own.select("entity", F.explode(technologies(F.col("text"))).alias("tech")).distinct()


def _unheard(claimed: DataFrame, parts: DataFrame) -> DataFrame:
    """claimed (entity, tech) -> those that no corroborating source names, if there are such sources."""
    heard = parts.where(F.col("category").isin(*vocab.CORROBORATING)).select("entity", "text")
    return claimed.join(heard, "entity").groupBy("entity", "tech").agg(F.bool_or(F.contains("text", F.col("tech"))).alias("named")).where("not named")


def contradictions(parts: DataFrame) -> DataFrame:
    """(entity, kind, claim): what first parties claim and nobody else repeats.

    Technologies delivered that no corroborating source names (if there are such sources), certifications and commercial terms that
    no independent one repeats, and open roles that name technologies, but none of those claimed.
    """
    t, own, vouching = F.col("text"), F.col("category").isin(*vocab.FIRST_PARTY), F.col("category").isin(*vocab.INDEPENDENT)
    flags = parts.groupBy("entity").agg(*[F.bool_or(side & t.rlike(p)).alias(n) for n, side, p in (
        ("cert_own", own, vocab.CERTIFIED), ("cert_other", vouching, vocab.CERTIFIED), ("terms_own", own, vocab.COMMERCIAL), ("terms_other", vouching, vocab.COMMERCIAL))])
    finding = lambda kind, claim: F.struct(F.lit(kind).alias("kind"), F.lit(claim).alias("claim"))
    plain = F.array_compact(F.array(
        F.when(F.col("cert_own") & ~F.col("cert_other"), finding("certification_unverified", "a vendor certification or partner tier is claimed")),
        F.when(F.col("terms_own") & ~F.col("terms_other"), finding("commercial_terms_unverified", "commercial terms are stated")),
    ))
    listed = lambda names, most: F.array_join(F.slice(F.array_sort(F.collect_set(names)), 1, most), ", ")
    claimed = claimed_technologies(parts)
    alone = _unheard(claimed, parts).groupBy("entity").agg(F.concat(F.lit("first-party delivery of "), listed("tech", 6)).alias("claim"))
    roles = parts.where("category = 'ATS_REQUISITIONS'").select("entity", F.explode(technologies(t)).alias("tech")).distinct()
    both = claimed.withColumn("said", F.lit(1)).unionByName(roles.withColumn("said", F.lit(0))).groupBy("entity", "tech").agg(F.max("said").alias("said"), F.min("said").alias("role"))
    sides = both.groupBy("entity").agg(F.max("said").alias("any"), F.min("role").alias("roles"), F.bool_or((F.col("said") == 1) & (F.col("role") == 0)).alias("meet"), listed(F.when(F.col("said") == 1, F.col("tech")), 4).alias("names"))
    against = sides.where("any = 1 AND roles = 0 AND NOT meet").select("entity", F.concat(F.lit("delivery of "), "names").alias("claim"))
    return (
        flags.select("entity", F.explode(plain).alias("f")).select("entity", "f.kind", "f.claim")
        .unionByName(alone.select("entity", F.lit("stack_claim_uncorroborated").alias("kind"), "claim"))
        .unionByName(against.select("entity", F.lit("hiring_contradicts_claimed_stack").alias("kind"), "claim"))
    )


def confidences(parts: DataFrame) -> DataFrame:
    """(entity, kind, confidence, weight, category): each kind an entity has, and the section that carries it, an independent one before others.

    parts as for ``coverage``, with ``ord``. A kind without a section that may carry it is unsupported.
    """
    first = parts.groupBy("entity").agg(*_first())
    found = coverage(parts).join(first, "entity").select("entity", F.explode(_carried()).alias("k"))
    return found.select("entity", "k.kind", _level(F.col("k")).alias("confidence"), _weight(F.col("k")).alias("weight"), F.coalesce("k.category", F.lit("unlabelled")).alias("category"))


def _first() -> list[Column]:
    """The categories of an entity's first sections, as aggregates."""
    c, at = F.col("category"), lambda condition, name: F.min_by(F.when(condition, F.col("category")), F.when(condition, F.col("ord"))).alias(name)
    return [at(c.isin(*vocab.INDEPENDENT), "first_vouching"), at(c == "ATS_REQUISITIONS", "first_hiring"), at(c.isin(*vocab.FIRST_PARTY), "first_own"), at(F.lit(True), "first_any")]


def _carried() -> Column:
    """(kind, category) of the kinds an entity has, by the flags and first sections."""
    carrier = {"independent_validation": F.col("first_vouching"), "delivery_hiring": F.col("first_hiring")} | {k: F.coalesce("first_vouching", "first_own") for k in ("delivery_proof", "stack_delivery")}
    return F.array_compact(F.array(*[F.when(F.col(k), F.struct(F.lit(k).alias("kind"), carrier.get(k, F.coalesce("first_vouching", "first_any")).alias("category"))) for k in KINDS]))


def _level(carried: Column) -> Column:
    return F.when(carried["category"].isNull(), "unsupported").otherwise("reported")


def _weight(carried: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in vocab.CONFIDENCE.items() for x in pair]), _level(carried))


def read_out(parts: DataFrame, tier: str) -> DataFrame:
    """One row per entity: what it lacks for a claimed tier, the tier supported, why, its contradictions, and its weakest kind."""
    # One pass over the sections, each read once; a section has another row for each technology that it claims or asks for.
    own, hiring = F.col("category").isin(*vocab.FIRST_PARTY), F.col("category") == "ATS_REQUISITIONS"
    signs = {k: v for k, v in _signs().items() if k not in ("stack", "proof")} | {"outcome": F.coalesce(F.col("text").rlike(vocab.OUTCOME), F.lit(False)), "own": own, "techs": F.when(own | hiring, technologies(F.col("text")))}
    read = parts.select("entity", "ord", "category", F.inline(F.array(F.struct(*[v.alias(k) for k, v in signs.items()])))).withColumns({"stack": F.when(F.col("own"), F.size("techs") > 0), "proof": F.col("delivery") & F.col("outcome")})
    claims = F.col("own") & F.col("delivery")
    named = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(F.when(claims | F.col("hiring"), F.col("techs")), F.array().cast("array<string>")))
    every = read.withColumn("claims", claims).withColumn("tech", F.explode(named)).drop("techs")
    dossiers = every.groupBy("entity").agg(
        *_kinds(), *_first(), F.count_if(F.col("tech").isNull()).alias("sections"),
        (_any(F.col("own") & F.col("certified")) & ~_any(F.col("vouching") & F.col("certified"))).alias("cert_alone"), (_any(F.col("own") & F.col("terms")) & ~_any(F.col("vouching") & F.col("terms"))).alias("terms_alone"),
        F.collect_set(F.when(F.col("claims"), F.col("tech"))).alias("claimed"), F.collect_set(F.when(F.col("hiring"), F.col("tech"))).alias("roles"),
    )
    alone = _unheard(claimed_technologies(parts), parts).select("entity").distinct().withColumn("alone", F.lit(True))
    against = (F.size("claimed") > 0) & (F.size("roles") > 0) & ~F.arrays_overlap("claimed", "roles")
    many = sum((F.coalesce(x, F.lit(False)).cast("long") for x in (F.col("cert_alone"), F.col("terms_alone"), F.col("alone"), against)), F.lit(0).cast("long"))
    weakest = F.coalesce(F.array_min(F.transform(_carried(), _weight)), F.lit(0.0))
    joined = dossiers.where("entity IS NOT NULL").join(alone, "entity", "left")
    judged = joined.select("entity", missing(tier).alias("missing"), capped_tier(F.lit(tier)).alias("supported"), tier_reasons(tier).alias("reasons"), many.alias("contradictions"), weakest.alias("weakest"), "sections")
    return judged.select("entity", "missing", "supported", (F.col("supported") != tier).alias("capped"), "reasons", "contradictions", "weakest", "sections")


def document_sections(parts: DataFrame, source_category: Column) -> DataFrame:
    """parts (entity, ord, category, uri, text, source_uri): a document without marked sections, but of a known source, is one section of that source's category."""
    plain = F.bool_and(F.col("category") == "PREAMBLE").over(Window.partitionBy("entity")) & (F.coalesce("source_uri", F.lit("")) != "")
    return parts.select("entity", "ord", F.when(plain, F.upper(source_category)).otherwise(F.col("category")).alias("category"), F.when(plain, F.col("source_uri")).otherwise(F.col("uri")).alias("uri"), "text")


def bounds(dossiers: DataFrame, *, entity: str = "entity", text: str = "text") -> DataFrame:
    """(entity, category, uri, start, end): where the body of each marked section lies in its dossier."""
    heads = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    pieces = F.zip_with(heads, F.slice(F.split(text, MARKER), 1, F.size(heads)), lambda h, b: F.struct(h.alias("head"), F.length(b).alias("gap")))
    each = dossiers.select(F.col(entity).alias("entity"), F.length(text).alias("size"), F.posexplode(pieces).alias("n", "p"))
    order = Window.partitionBy("entity").orderBy("n")
    own = each.withColumn("start", F.sum(F.col("p.gap") + F.length("p.head")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    after = F.lead(F.col("start") - F.length("p.head")).over(order)
    head = lambda n: F.trim(F.regexp_extract("p.head", MARKER, n))
    return own.select("entity", F.upper(head(1)).alias("category"), head(2).alias("uri"), "start", F.coalesce(after, F.col("size")).cast("int").alias("end"))


def at_offsets(quotes: DataFrame, where: DataFrame) -> DataFrame:
    """quotes (entity, offset, ...) with the category and uri of the section that each offset lies in; empty outside any."""
    own = where.withColumnRenamed("entity", "__entity")
    inside = (F.col("entity") == F.col("__entity")) & (F.col("start") <= F.col("offset")) & (F.col("offset") < F.col("end"))
    found = quotes.join(own, inside, "left")
    return found.select(*quotes.columns, F.coalesce("category", F.lit("")).alias("category"), F.coalesce("uri", F.lit("")).alias("uri"))


def gap_queries(entity: Column, kinds: Column, most: int = 3) -> Column:
    """Searches for the kinds an entity lacks, the first ``most`` that have a template."""
    known = F.create_map(*[F.lit(x) for pair in vocab.KIND_QUERIES.items() for x in pair])
    return F.slice(F.transform(F.filter(kinds, lambda k: F.map_contains_key(known, k)), lambda k: F.replace(F.element_at(known, k), F.lit("{entity}"), entity)), 1, most)


def surfaces(kinds: Column) -> Column:
    """The surfaces that carry the kinds, each once, in order."""
    known = F.create_map(*[x for k, v in vocab.KIND_SURFACES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(F.filter(kinds, lambda k: F.map_contains_key(known, k)), lambda k: F.element_at(known, k))))


def addresses(item: str, quote: Column, category: Column, terms: tuple[str, ...] = ()) -> Column:
    """Whether a quote may carry the claim of a checklist item: it must state what the concept requires, from a party that may say so."""
    concept = vocab.concept(item)
    states = {
        "stack_delivery": T.any_of([quote.rlike(rf"(?i)(?<![\w.])\Q{t}\E(?!\w)") for t in terms]), "billable_delivery": quote.rlike(vocab.OUTCOME) & quote.rlike(vocab.DELIVERY),
        "delivery_proof": quote.rlike(vocab.OUTCOME) & quote.rlike(vocab.DELIVERY), "client_outcome": quote.rlike(vocab.OUTCOME),
        "delivery_hiring": (category == "ATS_REQUISITIONS") | quote.rlike(vocab.HIRING), "independent_validation": quote.rlike(vocab.DELIVERY) | quote.rlike(vocab.OUTCOME),
        "growth_signal": quote.rlike(vocab.GROWTH), "certification": quote.rlike(vocab.CERTIFIED), "commercial_scale": quote.rlike(vocab.COMMERCIAL),
        "vendor_alliance": quote.rlike(vocab.CERTIFIED) | quote.rlike(vocab.PARTNERSHIP), "published_engineering": quote.rlike(vocab.PUBLISHED),
    }
    if concept not in states:
        return F.lit(True)
    return F.coalesce(states[concept] & _may_speak(concept, category), F.lit(False))


def _may_speak(concept: str, category: Column) -> Column:
    return (category == "") | category.isin(*vocab.INDEPENDENT) if concept == "independent_validation" else F.lit(True)


def refusal(item: str, quote: Column, category: Column, terms: tuple[str, ...] = ()) -> Column:
    """Why a quote can't carry an item's claim; null where it can."""
    concept = vocab.concept(item)
    if not concept:
        return F.lit(None).cast("string")
    party = F.concat(F.lit("quote must come from a third party, not "), F.replace(F.lower(category), F.lit("_"), F.lit(" ")))
    return F.when(~_may_speak(concept, category), party).when(~addresses(item, quote, category, terms), F.lit(f"quote does not state {vocab.REQUIREMENTS[concept]}"))


def qualifies(item: str, category: Column) -> Column:
    """Whether a source of this category may carry the item's claim; text of unknown origin speaks only for first-party claims."""
    allowed = vocab.QUALIFYING.get(vocab.CONCEPT_KINDS.get(vocab.concept(item), ""), vocab.QUALIFYING[""])
    return F.when(F.coalesce(category, F.lit("")) == "", F.lit(bool(set(allowed) & set(vocab.FIRST_PARTY)))).otherwise(F.upper(category).isin(*allowed))
