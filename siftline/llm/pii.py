"""Personal data with DataFrame operations alone: fixed patterns, and information-theoretic sanitisation on top.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity. For every
term the corpus tells how many documents hold it, and how many hold it together with an entity. A term discloses an entity if
seeing it makes the entity nearly certain: PMI(term; entity) reaches a share of the entity's information -log2 P(entity), and
P(entity | term) reaches a floor, over enough documents. Such terms become spans of their own and are removed or generalised
wherever they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import SPACE, WORD, doc_key, materialise, single

#: Kind, pattern, and what a text must hold for it to be worth looking; in the order in which equal starts are listed.
KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    ("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9]([\x20-]?[0-9]){11}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
#: The same patterns for Java: a match may begin only where its first run of characters begins or where the last match ended,
#: and repeats don't give back, which changes no match but spares deep recursion and repeated starts within one long run.
JAVA = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
_MARK = "\uffff"
SPLIT = rf"[{SPACE}]+"
ORDER = {kind: i for i, kind in enumerate([*[k for k, _, _ in KINDS], TERM])}


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass Luhn's test."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weighed(i: Column) -> Column:
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), lambda s, i: s + weighed(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(found)).between(12, 19) & luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str) -> Column:
    """Matches with the text before each: array of (gap, found). Java's split keeps what regexp_extract_all leaves."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.zip_with(F.slice(F.split(text, pattern), 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("found")))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (id, tkey, text), each pair of keys once -> (id, tkey, kind, start, end, value) of the pattern kinds; code points, end exclusive."""
    some = docs.where(F.col("text").rlike("[@0-9]"))
    kinds = [
        F.struct(F.lit(kind).alias("kind"), F.when(F.instr("text", "@") > 0 if hint == "@" else F.col("text").rlike(hint), _pieces(F.col("text"), JAVA[kind])).alias("pieces"))
        for kind, _, hint in KINDS
    ]
    each = some.select("id", "tkey", F.explode(F.array(*kinds)).alias("k")).select("id", "tkey", "k.kind", F.posexplode("k.pieces").alias("n", "p"))
    so_far = Window.partitionBy("id", "tkey", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("p.gap") + F.length("p.found")).over(so_far))
    placed = placed.select("id", "tkey", "kind", (F.col("end") - F.length("p.found")).alias("start"), "end", F.col("p.found").alias("value"))
    valid = reduce(lambda a, b: a | b, [(F.col("kind") == kind) & _valid(kind, F.col("value")) for kind, _, _ in KINDS])
    return placed.where(valid)


def _term(word: Column) -> Column:
    """A word in lower case without outer punctuation."""
    return F.regexp_replace(F.lower(word), r"^[\p{Punct}]+|[\p{Punct}]+$", "")


def _small(df: DataFrame, most: int = 48 << 20) -> DataFrame:
    """A written table, broadcast if its rows hold at most ``most`` bytes (as JSON, and 32 more each); else the planner joins by shuffle."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 32)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def _terms(text: str = "text") -> Column:
    return F.array_distinct(F.transform(F.split(text, SPLIT), _term))


def _free_terms(text: Column, at: Column) -> Column:
    """Terms of the words that overlap none of the spans ``at``: these are overlaid by a code point that is no character."""
    size = lambda s: (s["end"] - s["start"]).cast("int")
    marked = F.aggregate(at, text, lambda t, s: F.overlay(t, F.repeat(F.lit(_MARK), size(s)), s["start"].cast("int") + 1, size(s)))
    return F.array_distinct(F.transform(F.filter(F.split(marked, SPLIT), lambda w: ~F.contains(w, F.lit(_MARK))), _term))


def _signed(of: str) -> list[Column]:
    """A signature of the set of texts that a row of ``of`` stands in: equal sets have equal ones (128 bits)."""
    return [F.bit_xor(F.xxhash64("tkey")).alias(f"{of}0"), F.bit_xor(F.xxhash64(F.lit(1), "tkey")).alias(f"{of}1")]


def disclosing(docs: DataFrame, spans: DataFrame, *, least_docs: int = 3, floor: float = 0.5, share: float = 0.8) -> DataFrame:
    """(term_hash): terms that disclose an entity. docs (id, tkey, text), each pair of keys once, and spans (id, tkey, kind, value).

    The share of a term's documents that hold the entity is taken over all documents. How often an entity occurs, and with how
    many texts a term must support it, counts distinct texts: copies tell nothing new. Words that overlap a span of the patterns
    are no candidates; all others are, whatever their length and characters. An entity of fewer than ``least_docs`` distinct texts
    discloses nothing here: what names it stays in the texts, the price of not taking chance neighbours for its names.

    Entities that stand in the same texts have the same counts, and so have terms; each such class is one row. So the pairs of a
    text that lists very many values and names are those of classes.
    """
    every = docs.select("tkey").distinct().count()
    entities = materialise(spans.select("tkey", F.xxhash64("kind", "value").alias("entity")).distinct(), "entities")
    held = entities.groupBy("entity").agg(F.count("*").alias("n_e"), *_signed("e")).where(F.col("n_e") >= least_docs)
    shown = materialise(entities.join(held, "entity").select("tkey", "e0", "e1", "n_e").distinct(), "shown")
    # Words of the texts that hold an entity of at least least_docs texts, each word once a text.
    holders = materialise(shown.select("tkey").distinct(), "holders")
    near_spans = spans.join(_small(holders), "tkey", "left_semi").groupBy("tkey").agg(F.collect_set(F.struct("start", "end")).alias("at"))  # bounded by a text's length
    copies = docs.join(_small(holders), "tkey", "left_semi").groupBy("tkey").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    chosen = materialise(near_spans.join(copies, "tkey"), "holders-spans")
    near = docs.join(_small(chosen), ["id", "tkey"]).select("tkey", "copies", F.explode(_free_terms(F.col("text"), F.col("at"))).alias("term"))
    near = materialise(near.where("term <> ''").select("tkey", "copies", F.xxhash64("term").alias("term")), "near-terms")
    # A term stands in at least the documents seen here, so P(entity | term) is bounded by them: common words go before the corpus is counted.
    terms = near.groupBy("term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_near"), *_signed("t")).where(F.col("texts") >= least_docs)
    terms = materialise(terms, "terms-classes")
    kinds = near.join(terms.select("term", "t0", "t1", "n_near"), "term").select("tkey", "copies", "t0", "t1", "n_near").distinct()
    both = kinds.join(_small(shown), "tkey").groupBy("t0", "t1", "n_near", "e0", "e1", "n_e").agg(F.sum("copies").alias("n_te"), F.count("*").alias("support"))
    both = both.where((F.col("support") >= least_docs) & (F.col("n_te") >= floor * F.col("n_near"))).select("t0", "t1", "n_e", "n_te").distinct()
    both = materialise(both.join(terms.select("term", "t0", "t1"), ["t0", "t1"]).select("term", "n_e", "n_te"), "term-entity")
    asked = materialise(both.select("term").distinct(), "asked-terms")
    words = docs.select(F.explode(_terms()).alias("term")).select(F.xxhash64("term").alias("term"))
    counted = words.join(_small(asked), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    given = F.col("n_te") / F.col("n_t")
    information = -F.log2(F.col("n_e") / F.lit(float(every or 1)))
    disclosed = (F.log2(given) + information) / information
    return both.join(counted, "term").where((given >= floor) & (information > 0) & (disclosed >= share)).select(F.col("term").alias("term_hash")).distinct()


def term_spans(docs: DataFrame, terms: DataFrame, base: DataFrame) -> DataFrame:
    """(id, tkey, kind, start, end, value) of words whose term is in ``terms`` and that lie in no base span. docs as for ``base_spans``.

    Hashes of terms meet the list first; the texts that hold some are then read with just these, and their words placed in one pass.
    """
    words = docs.select("id", "tkey", F.explode(F.transform(_terms(), lambda t: F.xxhash64(t))).alias("term_hash"))
    holders = words.join(_small(terms), "term_hash", "left_semi").groupBy("id", "tkey").agg(F.collect_set("term_hash").alias("own"))  # bounded by a text's length
    holders = materialise(holders, "term-holders")
    none = F.array().cast("array<struct<start: int, value: string>>")

    def step(at: Column, p: Column) -> Column:
        start = at["pos"] + p["gap"]
        listed = F.array_contains(F.col("own"), F.xxhash64(_term(p["found"])))
        found = F.when(listed, F.concat(at["found"], F.array(F.struct(start.alias("start"), p["found"].alias("value"))))).otherwise(at["found"])
        return F.struct((start + F.length(p["found"])).alias("pos"), found.alias("found"))

    placed = F.aggregate(_pieces(F.col("text"), WORD), F.struct(F.lit(0).alias("pos"), none.alias("found")), step)["found"]
    each = docs.join(_small(holders), ["id", "tkey"]).select("id", "tkey", F.explode(placed).alias("s")).select("id", "tkey", "s.*")
    chosen = each.select("id", "tkey", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("value")).cast("long").alias("end"), "value")
    other = base.select("id", "tkey", F.col("start").alias("s"), F.col("end").alias("e"))
    free = chosen.join(other, (chosen.id == other.id) & (chosen.tkey == other.tkey) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_anti")
    return free.select("id", "tkey", F.lit(TERM).alias("kind"), "start", "end", "value")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """Rows of docs as (doc_id, id, tkey, text), and the spans of its distinct rows (id, tkey, kind, start, end, value)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key, tkey = doc_key(F.col("doc_id"), F.col("text"))
    own = own.withColumns({"id": key, "tkey": tkey})
    rows = single(own.select("id", "tkey", "text"))
    base = materialise(base_spans(rows), "base-spans")
    terms = materialise(disclosing(rows, base, **options), "terms")
    if terms.isEmpty():
        return own, base
    return own, materialise(base.unionByName(term_spans(rows, terms, base)), "spans")


def _listed(spans: DataFrame) -> DataFrame:
    """(id, tkey, n_email, n_ip, n_card, n_phone, base, spans); the lists are bounded by a document's length."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), F.col("kind"))
    item = F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("line"))
    line = lambda condition: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, item))), lambda x: x.line), ",")
    counts = [F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind, _, _ in KINDS]
    return spans.groupBy("id", "tkey").agg(*counts, line(F.col("kind") != TERM).alias("base"), line(F.lit(True)).alias("spans"))


def digest(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts by kind, base_sha256, spans.

    Null and empty texts have no spans. Repeated rows (same id and text) share their spans.
    """
    own, spans = find(docs, **options)
    found = own.select("doc_id", "id", "tkey").join(_listed(spans), ["id", "tkey"], "left")
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind, _, _ in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", generalise: bool = True, **options) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in brackets (``generalise``) or removed; overlapping spans go as one."""
    own, spans = find(docs, doc_id=doc_id, text=text, **options)
    by = Window.partitionBy("id", "tkey").orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    joined = spans.withColumn("group", F.sum(F.when(reach > F.col("start"), 0).otherwise(1)).over(by))
    merged = joined.groupBy("id", "tkey", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end")).alias("kind"))
    mark = F.concat(F.lit("["), F.upper("kind"), F.lit("]")) if generalise else F.lit("")
    before = F.coalesce(F.lag("end").over(Window.partitionBy("id", "tkey").orderBy("start")), F.lit(0))
    cuts = merged.withColumns({"from": before, "mark": mark}).groupBy("id", "tkey").agg(F.array_sort(F.collect_list(F.struct("start", "from", "end", "mark"))).alias("cuts"))
    out = own.join(cuts, ["id", "tkey"], "left")
    pieces = F.transform("cuts", lambda c: F.concat(F.substr(F.col("text"), c["from"].cast("int") + 1, (c["start"] - c["from"]).cast("int")), c["mark"]))
    rest = F.substr(F.col("text"), F.element_at("cuts", -1)["end"].cast("int") + 1, F.length("text"))
    return out.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest)).alias("text"))
