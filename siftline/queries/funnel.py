"""Queries over candidates: suppliers described in words, judged by gates and by their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import text as T
from siftline.operators import evidence, gates, runs
from siftline.queries.base import Tables, query, quoted, sql_any, sql_matches, sql_says

PROFILE = gates.Profile(size_min=20, size_max=800, locations=("united kingdom", "germany"), verticals=("fintech", "retail"))
#: A description of each supplier, the same expression for Spark and for SQL.
_TEXT = """concat(s_name, CASE s_suppkey % 7 WHEN 0 THEN ' is a consultancy of systems integrators' WHEN 1 THEN ' sells saas with a free trial on our platform' WHEN 2 THEN ' keeps a directory of firms, view profile'
  WHEN 3 THEN ' offers managed services and implementation' WHEN 4 THEN ' runs a therapy practice' WHEN 5 THEN ', an advisory with professional services. Book a demo' ELSE ' helps you find a way to migrate' END,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('. A team of ', CAST(s_suppkey % 900 AS VARCHAR(20))) ELSE concat('. ', CAST(s_suppkey % 1500 AS VARCHAR(20)), ' employees') END,
  CASE s_nationkey % 6 WHEN 0 THEN ' based in London, serving ' WHEN 1 THEN ', people in Berlin, serving ' WHEN 2 THEN ' with offices in Lisbon and serving ' WHEN 3 THEN ' in Toronto for ' ELSE ' for ' END,
  CASE s_suppkey % 4 WHEN 0 THEN 'banking clients' WHEN 1 THEN 'freight and logistics firms' WHEN 2 THEN 'e-commerce' ELSE 'everyone' END, '.')"""
_GRADE = "CASE WHEN s_suppkey % 2 = 0 THEN 'fetched' ELSE 'snippet' END"
_CAND = f"c AS (SELECT s_suppkey AS item_id, s_name AS candidate, {_TEXT} AS text, {_GRADE} AS evidence FROM supplier)"


def candidates(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("candidate"), F.expr(_TEXT).alias("text"), F.expr(_GRADE).alias("evidence"))


def _n(terms: tuple[str, ...]) -> str:
    return f"len({sql_matches('text', terms)})"


_KIND = f"""CASE WHEN {_n(vocab.HARD_DIRECTORY_TERMS)} > 0 OR ({_n(vocab.SOFT_DIRECTORY_TERMS)} > 0 AND {_n(vocab.PRIMARY_SERVICES_TERMS)} = 0) THEN 'directory'
  WHEN {_n(vocab.SOFTWARE_TERMS)} > 0 AND (({_n(vocab.HARD_SOFTWARE_TERMS)} > 0 AND NOT ({_n(vocab.PRIMARY_SERVICES_TERMS)} >= 2 AND {_n(vocab.SERVICES_TERMS)} > {_n(vocab.SOFTWARE_TERMS)}))
    OR {_n(vocab.PRIMARY_SERVICES_TERMS)} = 0 OR {_n(vocab.SOFTWARE_TERMS)} > {_n(vocab.SERVICES_TERMS)}) THEN 'software' WHEN {_n(vocab.SERVICES_TERMS)} > 0 THEN 'services' ELSE '' END"""
_SIZE = "coalesce(" + ", ".join(f"try_cast(replace(nullif(regexp_extract(text, {quoted(p)}, 1), ''), ',', '') AS INT)" for p in vocab.SIZE_PATTERNS) + ")"
_PLACE = "coalesce(nullif(regexp_replace(trim(regexp_extract(text, {p}, 1)), ',$', ''), ''), {names}, '')".format(
    p=quoted(vocab.LOCATION_PATTERN), names=", ".join(f"CASE WHEN contains(lower(text), {quoted(v)}) THEN {quoted(v.title())} END" for place in vocab.PLACES for v in vocab.variants(place))
)
_INSIDE = "(" + " OR ".join(sql_says("place", x) for x in PROFILE.locations) + ")"
_READ = f"""{_CAND}, r AS (SELECT *, {_KIND} AS kind, {_SIZE} AS size, {_PLACE} AS place, {sql_matches("text", vocab.VERTICALS)} AS verticals, {_n(vocab.DELIVERY_TERMS)} AS delivery FROM c),
v AS (SELECT *, CASE WHEN evidence = 'fetched' THEN array_to_string(verticals, ', ') ELSE '' END AS named FROM r),
g AS (SELECT *, CASE WHEN kind IN ('software', 'directory') THEN 'fail' WHEN kind = 'services' THEN CASE WHEN evidence = 'fetched' THEN 'pass' ELSE 'unknown' END
    WHEN evidence = 'fetched' AND trim(text) <> '' AND delivery = 0 THEN 'fail' ELSE 'unknown' END AS o_kind,
  CASE WHEN size IS NULL THEN 'unknown' WHEN size < {PROFILE.size_min} OR size > {PROFILE.size_max} THEN 'fail' ELSE 'pass' END AS o_size,
  CASE WHEN place = '' THEN 'unknown' WHEN {_INSIDE} THEN 'pass' ELSE 'fail' END AS o_place,
  CASE WHEN named = '' THEN 'unknown' WHEN {" OR ".join(sql_says("named", x) for x in PROFILE.verticals)} THEN 'pass' ELSE 'fail' END AS o_vertical FROM v),
x AS (SELECT *, [o_kind, o_size, o_place, o_vertical] AS every, list_position([o_kind, o_size, o_place, o_vertical], 'fail') AS stop FROM g),
y AS (SELECT *, CASE WHEN stop > 0 THEN list_slice(every, 1, stop) ELSE every END AS trace FROM x),
z AS (SELECT *, CASE WHEN stop > 0 THEN 'eliminated' WHEN len(list_filter(trace, lambda o: o <> 'pass')) = 0 THEN 'qualified' ELSE 'lead' END AS verdict,
  array_to_string(list_filter([CASE WHEN len(trace) >= 1 AND o_kind = 'unknown' THEN 'kind' END, CASE WHEN len(trace) >= 2 AND o_size = 'unknown' THEN 'size' END,
    CASE WHEN len(trace) >= 3 AND o_place = 'unknown' THEN 'location' END, CASE WHEN len(trace) >= 4 AND o_vertical = 'unknown' THEN 'vertical' END], lambda o: o IS NOT NULL), ',') AS open FROM y),
e AS (SELECT *, CASE WHEN verdict = 'eliminated' THEN '' WHEN evidence = 'snippet' AND regexp_matches(open, 'kind|size|location') THEN 'surface' WHEN contains(open, 'vertical') THEN 'stories' ELSE '' END AS earned FROM z)"""


@query(f"WITH {_READ} SELECT item_id, kind, o_kind AS outcome FROM g")
def gate_kind(t: Tables) -> DataFrame:
    own = gates.readings(candidates(t))
    return own.select("item_id", "kind", gates.check_kind(F.col("text"), F.col("evidence"))["outcome"].alias("outcome"))


@query(f"WITH {_READ} SELECT item_id, size, o_size AS outcome FROM g")
def gate_size(t: Tables) -> DataFrame:
    return gates.readings(candidates(t)).select("item_id", "size", gates.check_size(PROFILE, F.col("evidence"))["outcome"].alias("outcome"))


@query(f"WITH {_READ} SELECT item_id, place, o_place AS outcome FROM g")
def gate_location(t: Tables) -> DataFrame:
    return gates.readings(candidates(t)).select("item_id", "place", gates.check_location(PROFILE, F.col("evidence"))["outcome"].alias("outcome"))


@query(f"WITH {_READ} SELECT item_id, array_to_string(verticals, ', ') AS industries, o_vertical AS outcome FROM g")
def gate_vertical(t: Tables) -> DataFrame:
    return gates.readings(candidates(t)).select("item_id", F.array_join("verticals", ", ").alias("industries"), gates.check_vertical(PROFILE, F.col("evidence"))["outcome"].alias("outcome"))


@query(f"WITH {_READ} SELECT item_id, array_to_string(trace, ',') AS trace, verdict FROM z")
def funnel_verdict(t: Tables) -> DataFrame:
    own = gates.funnel(candidates(t), PROFILE)
    return own.select("item_id", F.array_join(F.transform("results", lambda r: r.outcome), ",").alias("trace"), gates.verdict(F.col("results")).alias("verdict"))


@query(f"""WITH {_READ} SELECT item_id, CASE
  WHEN o_kind = 'fail' THEN CASE kind WHEN 'software' THEN 'reads as a product company, not a delivery firm' WHEN 'directory' THEN 'reads as a directory of companies'
    ELSE 'nothing on the page reads as a delivery firm: no services, no clients, no delivery language at all' END
  WHEN o_size = 'fail' THEN size || ' people is ' || CASE WHEN size < {PROFILE.size_min} THEN 'below the profile''s floor of {PROFILE.size_min}' ELSE 'above the profile''s ceiling of {PROFILE.size_max}' END
  WHEN o_place = 'fail' THEN place || ' is outside the profile''s territory'
  WHEN o_vertical = 'fail' THEN 'serves ' || array_to_string(list_sort(verticals), ', ') || ' and none of the profile''s verticals'
  WHEN open <> '' THEN 'unresolved: ' || replace(open, ',', ', ') ELSE '' END AS because FROM z""")
def funnel_because(t: Tables) -> DataFrame:
    return gates.funnel(candidates(t), PROFILE).select("item_id", gates.because(F.col("results")).alias("because"))


@query(f"WITH {_READ} SELECT item_id, earned, verdict <> 'eliminated' AND earned <> '' AS advances FROM e")
def earned_rung(t: Tables) -> DataFrame:
    return gates.rung_rows(candidates(t), PROFILE).select("item_id", "earned", "advances")


@query(f"WITH {_READ} SELECT evidence, verdict, count(*)::BIGINT AS n, count(*) FILTER (earned <> '')::BIGINT AS needing_retrieval FROM e GROUP BY 1, 2")
def rung_counts(t: Tables) -> DataFrame:
    return gates.rung_rows(candidates(t), PROFILE).groupBy("evidence", "verdict").agg(F.count("*").alias("n"), F.count_if(F.col("earned") != "").alias("needing_retrieval"))


@query(f"WITH {_READ} SELECT (['kind', 'size', 'location', 'vertical'])[stop] AS gate, count(*)::BIGINT AS n FROM z WHERE stop > 0 GROUP BY 1")
def elimination_by_gate(t: Tables) -> DataFrame:
    own = gates.funnel(candidates(t), PROFILE).select(F.element_at("results", -1).alias("r")).select(F.when(F.col("r.outcome") == "fail", F.col("r.gate")).alias("gate"))
    return own.groupBy("gate").agg(F.count("gate").alias("n")).where("n > 0")  # on the count: a filter on the gate would move below and repeat the whole funnel


@query(f"WITH {_READ} SELECT gate, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(open, ',')) AS gate FROM z WHERE verdict <> 'eliminated' AND open <> '') GROUP BY 1")
def open_gate_counts(t: Tables) -> DataFrame:
    standing = F.when(F.col("verdict") != "eliminated", F.filter(F.split("open", ","), lambda g: g != ""))
    return gates.rung_rows(candidates(t), PROFILE).select(F.explode(standing).alias("gate")).groupBy("gate").agg(F.count("*").alias("n"))


@query(f"""WITH {_READ}, b AS (SELECT kind = 'services' AS said, item_id % 7 IN (0, 3, 5) AS truth FROM g), m AS (
  SELECT count(*) FILTER (said AND truth)::BIGINT AS tp, count(*) FILTER (said AND NOT truth)::BIGINT AS fp, count(*) FILTER (NOT said AND truth)::BIGINT AS fn, count(*) FILTER (NOT said AND NOT truth)::BIGINT AS tn FROM b)
SELECT *, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 4) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS recall FROM m""")
def gate_benchmark(t: Tables) -> DataFrame:
    """The kind gate against what each description was written to be."""
    own = gates.readings(candidates(t)).select((F.col("kind") == "services").alias("said"), (F.col("item_id") % 7).isin(0, 3, 5).alias("truth"))
    tally = own.agg(*[F.count_if((F.col("said") == F.lit(s)) & (F.col("truth") == F.lit(y))).alias(n) for n, s, y in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    share = lambda a, b: F.round(F.try_divide(a, b), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return tally.select("*", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


# --- evidence: each customer's orders are its dossier's sections ------------------------------------
_CATEGORY = "CASE o_orderkey % 6 WHEN 0 THEN 'VENDOR_REGISTRY' WHEN 1 THEN 'B2B_DIRECTORY_AUDIT' WHEN 2 THEN 'FIRST_PARTY_CASE_STUDY' WHEN 3 THEN 'FIRST_PARTY_PRACTICE' WHEN 4 THEN 'ATS_REQUISITIONS' ELSE 'COMMUNITY_AND_SOCIAL' END"
_BODY = """concat(CASE o_orderkey % 11 WHEN 0 THEN 'The team migrated Kafka and cut cost by 40% ' WHEN 1 THEN 'A certified partner with blended rate plans ' WHEN 2 THEN 'Raised funding in 2021 and expanded '
  WHEN 3 THEN 'Delivered a platform for Acme Corp on Terraform ' WHEN 4 THEN 'Copyright and privacy policy ' WHEN 5 THEN 'We are hiring engineers, apply now ' ELSE 'Nothing much to say here ' END,
  CASE WHEN o_orderkey % 3 = 0 THEN repeat('and more words follow here ', 5) ELSE '' END, lower(o_orderpriority))"""
_URI = "CASE WHEN o_orderkey % 4 = 0 THEN concat('https://firm.com/blog/', CAST(o_orderkey AS VARCHAR(20))) ELSE 'https://firm.com/' END"
_PARTS = f"p AS (SELECT concat('firm_', CAST(o_custkey AS VARCHAR(20))) AS entity, o_orderkey AS ord, {_CATEGORY} AS category, {_URI} AS uri, {_BODY} AS text FROM orders)"


def parts(t: Tables) -> DataFrame:
    return t.orders.select(F.expr("concat('firm_', CAST(o_custkey AS VARCHAR(20)))").alias("entity"), F.col("o_orderkey").alias("ord"), F.expr(_CATEGORY).alias("category"), F.expr(_URI).alias("uri"), F.expr(_BODY).alias("text"))


_OWN, _VOUCH = "category IN ('FIRST_PARTY_CASE_STUDY', 'FIRST_PARTY_PRACTICE')", "category IN ('VENDOR_REGISTRY', 'B2B_DIRECTORY_AUDIT', 'COMMUNITY_AND_SOCIAL')"
_WORDS = f"len(list_filter(regexp_split_to_array(regexp_replace(text, {quoted(vocab.BOILERPLATE)}, ' ', 'g'), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''))"
#: RE2 has no lookbehind; in these texts the words that count as technologies are these.
_TECH = "regexp_matches(text, '(Kafka|Terraform|Raised|Delivered|Copyright|Nothing)')"


def _has(pattern: str) -> str:
    return f"regexp_matches(text, {quoted(pattern)})"


_COVER = f"""{_PARTS}, k AS (SELECT entity, bool_or({_has(vocab.OUTCOME)} AND {_has(vocab.DELIVERY)}) AS delivery_proof, bool_or({_has(vocab.CLIENT)}) AS named_clients,
  bool_or({_OWN} AND {_TECH}) AND bool_or({_has(vocab.DELIVERY)}) AS stack_delivery, bool_or({_VOUCH} AND {_WORDS} >= 20) AS independent_validation,
  bool_or(category = 'ATS_REQUISITIONS' AND {_WORDS} >= 10) AS delivery_hiring, bool_or({_has(vocab.COMMERCIAL)}) AS commercial_terms, bool_or({_has(vocab.CERTIFIED)}) AS certification,
  bool_or({_WORDS} >= 20 AND (category = 'COMMUNITY_AND_SOCIAL' OR contains(uri, 'github.com') OR contains(uri, '/blog'))) AS engineering_output,
  bool_or({_has(vocab.GROWTH)}) AND bool_or({_has(vocab.YEAR)}) AS growth_signal, bool_or({_has(vocab.YEAR)}) AS dated_events FROM p GROUP BY 1)"""


@query(f"WITH {_COVER} SELECT * FROM k")
def coverage_kinds(t: Tables) -> DataFrame:
    return evidence.coverage(parts(t))


@query(f"WITH {_COVER} SELECT {', '.join(f'count(*) FILTER ({k})::BIGINT AS {k}' for k in evidence.KINDS)}, count(*)::BIGINT AS entities FROM k")
def coverage_totals(t: Tables) -> DataFrame:
    return evidence.coverage(parts(t)).agg(*[F.count_if(F.col(k)).alias(k) for k in evidence.KINDS], F.count("*").alias("entities"))


_CAPPED = "CASE WHEN delivery_proof AND independent_validation AND stack_delivery THEN 'tier_1' WHEN delivery_proof AND stack_delivery THEN 'tier_2' ELSE 'tier_3' END"


@query(f"WITH {_COVER} SELECT entity, {_CAPPED} AS tier FROM k")
def tier_cap(t: Tables) -> DataFrame:
    return evidence.coverage(parts(t)).select("entity", evidence.capped_tier(F.lit("tier_1")).alias("tier"))


_LACKING = "list_filter([CASE WHEN NOT delivery_proof THEN 'delivery_proof' END, CASE WHEN NOT independent_validation THEN 'independent_validation' END, CASE WHEN NOT stack_delivery THEN 'stack_delivery' END], lambda x: x IS NOT NULL)"


@query(f"WITH {_COVER} SELECT entity, array_to_string({_LACKING}, ',') AS missing FROM k WHERE len({_LACKING}) > 0")
def evidence_gaps(t: Tables) -> DataFrame:
    lacking = evidence.missing("tier_1")
    return evidence.coverage(parts(t)).select("entity", F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


@query(f"WITH {_COVER} SELECT entity, array_to_string(list_filter([CASE WHEN NOT named_clients THEN 'named_clients' END, CASE WHEN NOT dated_events THEN 'dated_events' END], lambda x: x IS NOT NULL), ',') AS missing FROM k WHERE NOT (named_clients AND dated_events)")
def required_kinds(t: Tables) -> DataFrame:
    """Entities that lack a kind which a run requires."""
    return runs.lacking_required(evidence.coverage(parts(t)), ("named_clients", "dated_events")).withColumn("missing", F.array_join("missing", ","))


_ASK = " ".join(f"WHEN {quoted(k)} THEN replace({quoted(v)}, '{{entity}}', entity)" for k, v in vocab.KIND_QUERIES.items())


@query(f"WITH {_COVER}, m AS (SELECT entity, unnest({_LACKING}) AS kind FROM k) SELECT entity, CASE kind {_ASK} END AS question FROM m")
def gap_queries(t: Tables) -> DataFrame:
    own = evidence.coverage(parts(t)).select("entity", evidence.missing("tier_1").alias("kinds"))
    return own.select("entity", F.explode(evidence.gap_queries(F.col("entity"), F.col("kinds"))).alias("question"))


#: The technologies of each of the texts above.
_NAMED = "CASE ord % 11 WHEN 0 THEN ['Kafka'] WHEN 2 THEN ['Raised'] WHEN 3 THEN ['Corp', 'Delivered', 'Terraform'] WHEN 4 THEN ['Copyright'] WHEN 1 THEN [] WHEN 5 THEN [] ELSE ['Nothing'] END"
_AGAINST = f"""f AS (SELECT entity, bool_or({_OWN} AND {_has(vocab.CERTIFIED)}) AS co, bool_or({_VOUCH} AND {_has(vocab.CERTIFIED)}) AS cv, bool_or({_OWN} AND {_has(vocab.COMMERCIAL)}) AS mo,
  bool_or({_VOUCH} AND {_has(vocab.COMMERCIAL)}) AS mv FROM p GROUP BY 1),
tc AS (SELECT DISTINCT entity, unnest({_NAMED}) AS tech FROM p WHERE {_OWN} AND {_has(vocab.DELIVERY)}),
tr AS (SELECT DISTINCT entity, unnest({_NAMED}) AS tech FROM p WHERE category = 'ATS_REQUISITIONS'),
tn AS (SELECT tc.entity, tc.tech FROM tc JOIN p ON tc.entity = p.entity WHERE {_VOUCH.replace("category", "p.category")} OR p.category = 'ATS_REQUISITIONS' GROUP BY 1, 2 HAVING NOT bool_or(contains(p.text, tc.tech))),
cl AS (SELECT entity, list_sort(list(tech)) AS techs FROM tc GROUP BY 1), ro AS (SELECT entity, list(tech) AS techs FROM tr GROUP BY 1),
found AS (
  SELECT entity, 'certification_unverified' AS kind, 'a vendor certification or partner tier is claimed' AS claim FROM f WHERE co AND NOT cv
  UNION ALL SELECT entity, 'commercial_terms_unverified', 'commercial terms are stated' FROM f WHERE mo AND NOT mv
  UNION ALL SELECT entity, 'stack_claim_uncorroborated', 'first-party delivery of ' || array_to_string(list_slice(list_sort(list(tech)), 1, 6), ', ') FROM tn GROUP BY 1
  UNION ALL SELECT cl.entity, 'hiring_contradicts_claimed_stack', 'delivery of ' || array_to_string(list_slice(cl.techs, 1, 4), ', ') FROM cl JOIN ro ON cl.entity = ro.entity WHERE NOT list_has_any(cl.techs, ro.techs))"""


@query(f"WITH {_PARTS}, {_AGAINST} SELECT entity, kind, claim FROM found")
def contradictions(t: Tables) -> DataFrame:
    return evidence.contradictions(parts(t))


_REASONS = f"""CASE WHEN len({_LACKING}) = 0 THEN '' ELSE array_to_string(list_concat(list_transform({_LACKING}, lambda k: 'tier_1 needs ' || k), CASE WHEN stack_delivery THEN [] ELSE ['tier_3 needs stack_delivery'] END), '; ') END"""


@query(f"WITH {_COVER} SELECT entity, {_REASONS} AS reasons FROM k")
def tier_reasons(t: Tables) -> DataFrame:
    return evidence.coverage(parts(t)).select("entity", F.array_join(evidence.tier_reasons("tier_1"), "; ").alias("reasons"))


@query(f"WITH {_COVER} SELECT entity, CASE WHEN delivery_proof AND stack_delivery THEN '' ELSE array_to_string(list_filter({_LACKING}, lambda k: k <> 'independent_validation'), ',') END AS lacking FROM k")
def nearest_tier_bar(t: Tables) -> DataFrame:
    return evidence.coverage(parts(t)).select("entity", F.array_join(evidence.nearest_bar("tier_2"), ",").alias("lacking"))


_CARRIED = {"independent_validation": "vouching", "delivery_hiring": "hiring", "delivery_proof": "coalesce(vouching, own)", "stack_delivery": "coalesce(vouching, own)"}
_FIRST = f"""w AS (SELECT entity, arg_min(category, ord) FILTER ({_VOUCH}) AS vouching, arg_min(category, ord) FILTER (category = 'ATS_REQUISITIONS') AS hiring, arg_min(category, ord) FILTER ({_OWN}) AS own, arg_min(category, ord) AS every FROM p GROUP BY 1),
cf AS ({" UNION ALL ".join(f"SELECT k.entity, '{x}' AS kind, {_CARRIED.get(x, 'coalesce(vouching, every)')} AS c FROM k JOIN w ON k.entity = w.entity WHERE k.{x}" for x in evidence.KINDS)})"""


@query(f"WITH {_COVER}, {_FIRST} SELECT entity, kind, CASE WHEN c IS NULL THEN 'unsupported' ELSE 'reported' END AS confidence, CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, coalesce(c, 'unlabelled') AS category FROM cf")
def claim_confidence(t: Tables) -> DataFrame:
    return evidence.confidences(parts(t))


@query(f"""WITH {_COVER}, {_AGAINST}, {_FIRST}, n AS (SELECT entity, count(*)::BIGINT AS sections FROM p GROUP BY 1), a AS (SELECT entity, count(*)::BIGINT AS contradictions FROM found GROUP BY 1),
wk AS (SELECT entity, min(CASE WHEN c IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS weakest FROM cf GROUP BY 1)
SELECT k.entity, array_to_string({_LACKING}, ',') AS missing, {_CAPPED} AS supported, {_CAPPED} <> 'tier_1' AS capped, {_REASONS} AS reasons, coalesce(contradictions, 0) AS contradictions, coalesce(weakest, 0.0::DOUBLE) AS weakest, sections
FROM k JOIN n ON k.entity = n.entity LEFT JOIN a ON k.entity = a.entity LEFT JOIN wk ON k.entity = wk.entity""")
def entity_evidence(t: Tables) -> DataFrame:
    own = evidence.read_out(parts(t), "tier_1")
    return own.withColumns({"missing": F.array_join("missing", ","), "reasons": F.array_join("reasons", "; ")})


_STATES = {
    "stack_delivery": "regexp_matches(text, '(?i)(kafka|terraform)')", "billable_delivery": f"{_has(vocab.OUTCOME)} AND {_has(vocab.DELIVERY)}", "delivery_proof": f"{_has(vocab.OUTCOME)} AND {_has(vocab.DELIVERY)}",
    "client_outcome": _has(vocab.OUTCOME), "delivery_hiring": f"category = 'ATS_REQUISITIONS' OR {_has(vocab.HIRING)}", "independent_validation": f"({_has(vocab.DELIVERY)} OR {_has(vocab.OUTCOME)}) AND {_VOUCH}",
    "growth_signal": _has(vocab.GROWTH), "certification": _has(vocab.CERTIFIED), "commercial_scale": _has(vocab.COMMERCIAL), "vendor_alliance": f"{_has(vocab.CERTIFIED)} OR {_has(vocab.PARTNERSHIP)}",
    "published_engineering": _has(vocab.PUBLISHED),
}
STACK = ("Kafka", "Terraform")


@query(f"WITH {_PARTS} SELECT category, " + ", ".join(f"count(*) FILTER ({v})::BIGINT AS {k}" for k, v in _STATES.items()) + ", count(*)::BIGINT AS quotes FROM p GROUP BY 1")
def claim_addressing(t: Tables) -> DataFrame:
    count = lambda item: F.count_if(evidence.addresses(item, F.col("text"), F.col("category"), STACK)).alias(item)
    return parts(t).groupBy("category").agg(*map(count, _STATES), F.count("*").alias("quotes"))


_REFUSED = " ".join(
    f"WHEN '{k}' THEN CASE " + (f"WHEN NOT {_VOUCH} THEN 'quote must come from a third party, not ' || replace(lower(category), '_', ' ') " if k == "independent_validation" else "")
    + f"WHEN NOT ({v}) THEN {quoted(f'quote does not state {vocab.REQUIREMENTS[k]}')} END" for k, v in _STATES.items()
)


@query(f"WITH {_PARTS}, i AS (SELECT unnest([{', '.join(quoted(k) for k in _STATES)}]) AS item), r AS (SELECT item, category, CASE item {_REFUSED} END AS note FROM p CROSS JOIN i) SELECT item, note, count(*)::BIGINT AS n FROM r WHERE note IS NOT NULL GROUP BY 1, 2")
def support_notes(t: Tables) -> DataFrame:
    """Why each section's text cannot carry each concept's claim, counted."""
    notes = F.array(*[F.struct(F.lit(k).alias("item"), evidence.refusal(k, F.col("text"), F.col("category"), STACK).alias("note")) for k in _STATES])
    return parts(t).select(F.explode(notes).alias("x")).select("x.*").groupBy("item", "note").agg(F.count("*").alias("n")).where("note IS NOT NULL")


def _marked(t: Tables) -> DataFrame:
    """Dossiers with section markers; a marker's category has letters, blanks and underscores only."""
    marked = F.concat(F.lit("=== SECTION: "), F.replace("category", F.lit("B2B_"), F.lit("")), F.lit(" (URI: "), "uri", F.lit(") ===\n"), "text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", marked.alias("x")))), lambda r: r.x)
    return parts(t).groupBy("entity").agg(F.array_join(lines, "\n").alias("text"))


@query(f"WITH {_PARTS} SELECT entity, replace(category, 'B2B_', '') AS category, count(*)::BIGINT AS n, sum(len(trim(text)))::BIGINT AS chars FROM p GROUP BY 1, 2")
def section_lookup(t: Tables) -> DataFrame:
    """Dossiers are written with section markers and parsed again."""
    return evidence.sections(_marked(t)).groupBy("entity", "category").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_LAID = f"""{_PARTS}, l AS (SELECT entity, ord, replace(category, 'B2B_', '') AS category, uri, len('=== SECTION: ' || replace(category, 'B2B_', '') || ' (URI: ' || uri || ') ===') AS head, len(text) AS body FROM p),
b AS (SELECT *, sum(head + 1 + body + 1) OVER (PARTITION BY entity ORDER BY ord) - (head + 1 + body + 1) + head AS start, lead(ord) OVER (PARTITION BY entity ORDER BY ord) IS NULL AS ends FROM l),
x AS (SELECT entity, category, uri, start, start + 1 + body + CASE WHEN ends THEN 0 ELSE 1 END AS stop FROM b),
q AS (SELECT entity, ord AS quote, (ord * 37) % 900 AS "offset" FROM p)"""


@query(f"""WITH {_LAID} SELECT q.entity, q.quote, coalesce(x.category, '') AS category, coalesce(x.uri, '') AS uri FROM q LEFT JOIN x ON q.entity = x.entity AND x.start <= q."offset" AND q."offset" < x.stop""")
def section_at_offset(t: Tables) -> DataFrame:
    """Offsets of quotes in dossiers, and the section that each lies in: a range join inside each entity."""
    quotes = parts(t).select("entity", F.col("ord").alias("quote"), (F.col("ord") * 37 % 900).cast("int").alias("offset"))
    return evidence.at_offsets(quotes, evidence.bounds(_marked(t))).select("entity", "quote", "category", "uri")


@query(f"SELECT s_suppkey, CASE WHEN {sql_any('t', ('directory',))} THEN 'excluded' WHEN {sql_any('t', ('implementation', 'consultancy'))} THEN 'matched' ELSE 'missing' END AS signal FROM (SELECT s_suppkey, lower({_TEXT}) AS t FROM supplier)")
def stack_signal(t: Tables) -> DataFrame:
    return candidates(t).select(F.col("item_id").alias("s_suppkey"), T.stack_signal(F.col("text"), ("implementation", "consultancy"), ("directory",)).alias("signal"))
