"""Queries over input items: validation, ids, dossiers, slices, spans, grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import vocab
from siftline.functions import text as T
from siftline.operators import batches as B
from siftline.operators import capture
from siftline.operators import grounding as G
from siftline.operators import items as I
from siftline.queries.base import Tables, query

#: Some ids are blank or hold characters that ids must not have.
_ID = "CASE doc_id % 11 WHEN 0 THEN concat('doc ', CAST(doc_id AS VARCHAR(20))) WHEN 1 THEN '' ELSE concat('doc_', CAST(doc_id AS VARCHAR(20))) END"
_ITEMS = f"i AS (SELECT {_ID} AS item_id, doc_id, coalesce(text, '') AS text, source FROM documents)"
_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\x{FFFD}]"
_GARBAGE = f"(len(text) >= 100 AND ((len(text) - len(regexp_replace(text, '{_CONTROL}', '', 'g'))) / len(text) > 0.05))"


def items(t: Tables) -> DataFrame:
    return t.documents.select(F.expr(_ID).alias("item_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


@query(f"""WITH {_ITEMS} SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(item_id, '{I.ID}') THEN 'id' END, CASE WHEN trim(text) = '' THEN 'blank' END,
  CASE WHEN {_GARBAGE} THEN 'garbage' END], lambda x: x IS NOT NULL), ',') AS violations FROM i""")
def ingest_validate(t: Tables) -> DataFrame:
    return items(t).select("doc_id", F.array_join(I.violations(F.col("item_id"), F.col("text")), ",").alias("violations"))


@query(f"WITH {_ITEMS} SELECT source, count(*) FILTER ({_GARBAGE})::BIGINT AS garbage, count(*)::BIGINT AS n FROM i GROUP BY 1")
def text_garbage_gate(t: Tables) -> DataFrame:
    return items(t).groupBy("source").agg(F.count_if(T.garbage(F.col("text"))).alias("garbage"), F.count("*").alias("n"))


@query(f"WITH {_ITEMS} SELECT item_id, doc_id FROM i WHERE item_id IN (SELECT DISTINCT concat('doc_', CAST(doc_id AS VARCHAR(20))) FROM labels WHERE quality = 1)")
def ingest_allowlist_semi(t: Tables) -> DataFrame:
    listed = t.labels.where("quality = 1").select(F.expr("concat('doc_', CAST(doc_id AS VARCHAR(20)))").alias("item_id"))
    return I.by_ids(items(t).select("item_id", "doc_id"), listed)


@query(f"WITH {_ITEMS} SELECT item_id, doc_id FROM i WHERE replace(item_id, '_', ' ') IN (SELECT DISTINCT concat('doc ', CAST(doc_id AS VARCHAR(20))) FROM labels WHERE quality = 1)")
def ingest_fuzzy_ids(t: Tables) -> DataFrame:
    listed = t.labels.where("quality = 1").select(F.expr("concat('doc_', CAST(doc_id AS VARCHAR(20)))").alias("item_id"))
    return I.by_ids(items(t).select("item_id", "doc_id"), listed, fuzzy=True)


@query(f"WITH {_ITEMS} SELECT doc_id, sha256(text) AS digest, len(text)::INT AS chars FROM i")
def item_digest(t: Tables) -> DataFrame:
    return items(t).select("doc_id", T.digest(F.col("text")).alias("digest"), F.length("text").alias("chars"))


@query(f"WITH {_ITEMS} SELECT source, count(*) FILTER (len(text) >= 200)::BIGINT AS kept, sum(least(len(text), 6000)) FILTER (len(text) >= 200)::BIGINT AS chars, count(*) FILTER (len(text) < 200)::BIGINT AS dropped FROM i GROUP BY 1")
def item_quality_gates(t: Tables) -> DataFrame:
    """Records long enough are kept, and cut at the slice budget for a worker's request; both are counted."""
    long = F.length("text") >= 200
    return items(t).groupBy("source").agg(F.count_if(long).alias("kept"), F.sum(F.when(long, F.least(F.length("text"), F.lit(6000)))).alias("chars"), F.count_if(~long).alias("dropped"))


@query(f"""WITH {_ITEMS}, s AS (SELECT source AS item_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM i)
SELECT doc_id, CASE WHEN place > 1 THEN item_id || '_' || substr(sha256(doc_id::VARCHAR), 1, 8) ELSE item_id END AS item_id FROM s""")
def id_decollision(t: Tables) -> DataFrame:
    return I.distinct_ids(items(t).select(F.col("source").alias("item_id"), "doc_id"), order="doc_id").select("doc_id", "item_id")


_FLAT = "regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g')"


@query(f"SELECT page_id, CASE WHEN len({_FLAT}) > 40 THEN substr({_FLAT}, 1, 27) || '_' || substr(sha256(url), 1, 12) ELSE {_FLAT} END AS slug FROM pages")
def slugify_ids(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.slug(F.col("url"), 40).alias("slug"))


# --- dossiers of conversations ------------------------------------------------------------------------
_LINE = "'=== SECTION: ' || upper(role) || ' (URI: turn/' || turn || ') ===' || chr(10) || text"
_DOSSIER = f"d AS (SELECT conv_id AS entity, string_agg({_LINE}, chr(10) ORDER BY turn, role, text) AS text, arg_min('turn/' || turn, (turn, role, text)) AS source_uri, array_to_string(list_sort(list(DISTINCT upper(role))), ',') AS categories, count(*)::BIGINT AS source_count FROM conversations GROUP BY 1)"


def records(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("entity"), F.struct("turn", "role", "text").alias("ord"), F.upper("role").alias("category"), F.concat(F.lit("turn/"), "turn").alias("uri"), "text")


@query(f"WITH {_DOSSIER} SELECT entity, md5(text) AS text, source_uri, categories, source_count FROM d")
def bundle_dossiers(t: Tables) -> DataFrame:
    return I.bundle(records(t)).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(f"WITH {_DOSSIER} SELECT entity, source_uri, categories, source_count FROM d WHERE source_count >= 3")
def bundle_min_sources(t: Tables) -> DataFrame:
    return I.bundle(records(t), least_sources=3).drop("text")


@query("""SELECT conv_id AS item_id, md5(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY turn, text)) AS text, (count(*) - 1)::BIGINT AS extra FROM conversations GROUP BY 1""")
def merge_candidates(t: Tables) -> DataFrame:
    """Records of one id as one: their texts in order, and how many were merged into the first."""
    own = capture.merged(t.conversations.select(F.col("conv_id").alias("item_id"), "text", F.struct("turn", "text").alias("seq")))
    return own.withColumn("text", F.md5(F.nullif("text", F.lit("")).cast("binary")))


_STATEMENTS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""WITH s AS (SELECT DISTINCT conv_id, turn // 2 AS snap, unnest({_STATEMENTS}) AS sentence FROM conversations),
p AS (SELECT conv_id, snap AS exchange, sentence, 1 AS new, 0 AS old FROM s UNION ALL SELECT conv_id, snap + 1, sentence, 0, 1 FROM s),
m AS (SELECT conv_id, exchange, sentence, max(new) AS new, max(old) AS old FROM p GROUP BY 1, 2, 3)
SELECT conv_id, exchange, count(*) FILTER (old = 0)::BIGINT AS added, count(*) FILTER (new = 0)::BIGINT AS removed FROM m GROUP BY 1, 2 HAVING max(new) = 1 AND max(old) = 1""")
def sentence_diff(t: Tables) -> DataFrame:
    """Sentences that came and went between each exchange and the next, where both say something: one aggregate instead of a full outer join."""
    own = t.conversations.select("conv_id", F.floor(F.col("turn") / 2).alias("snap"), F.explode(I.statements(F.col("text"))).alias("sentence"))
    sides = F.explode(F.array(F.struct(F.col("snap").alias("exchange"), F.lit(1).alias("new"), F.lit(0).alias("old")), F.struct((F.col("snap") + 1).alias("exchange"), F.lit(0).alias("new"), F.lit(1).alias("old"))))
    seen = own.select("conv_id", "sentence", sides.alias("s")).groupBy("conv_id", "s.exchange", "sentence").agg(F.max("s.new").alias("new"), F.max("s.old").alias("old"))
    each = seen.groupBy("conv_id", "exchange").agg(F.count_if(F.col("old") == 0).alias("added"), F.count_if(F.col("new") == 0).alias("removed"), F.max("new").alias("new"), F.max("old").alias("old"))
    return each.where("new = 1 AND old = 1").select("conv_id", "exchange", "added", "removed")


# --- slices and spans ---------------------------------------------------------------------------------
@query()
def slice_partition(t: Tables) -> DataFrame:
    return I.slices(t.documents, item_id="doc_id", text="text")


@query("SELECT doc_id AS item_id, len(text)::BIGINT AS covered, 0::BIGINT AS over_budget FROM documents WHERE len(text) > 0")
def slice_invariants(t: Tables) -> DataFrame:
    """Each document's slices cover it without overlap and within the budget."""
    size = F.col("end") - F.col("start")
    return I.slices(t.documents, item_id="doc_id", text="text").groupBy("item_id").agg(F.sum(size).alias("covered"), F.count_if(size > vocab.SLICE_CHARS).alias("over_budget"))


@query("SELECT doc_id, start::INT AS start, least(start + 6000, len(text))::INT AS stop FROM documents, unnest(range(0, len(text), 6000)) AS r(start)")
def hard_windows(t: Tables) -> DataFrame:
    own = t.documents.select("doc_id", F.explode(I.windows(F.col("text"), 6000)).alias("start"), F.length("text").alias("size"))
    return own.select("doc_id", "start", F.least(F.col("start") + 6000, F.col("size")).alias("stop"))


TERMS = ("the", "und", "que", "les", "tion")


_SPANS = rf"""s AS (SELECT doc_id AS item_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]?(?:\s|$)'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS every FROM documents),
e AS (SELECT item_id, i::INT AS place, every[i + 1] AS sentence FROM s, unnest(range(0, len(every))) AS r(i)),
h AS (SELECT *, ({" + ".join(f"contains(lower(sentence), '{x}')::INT" for x in TERMS)}) AS hits FROM e WHERE len(sentence) BETWEEN 15 AND 300),
b AS (SELECT * FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, place) <= 5)"""


def _spans(t: Tables) -> DataFrame:
    return I.spans(t.documents, TERMS, item_id="doc_id", text="text", most=5)


@query(f"WITH {_SPANS} SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY place) - 1)::INT AS candidate_id, hits, sentence FROM b")
def span_rank_topn(t: Tables) -> DataFrame:
    return _spans(t).drop("start", "end")


@query(f"WITH {_SPANS} SELECT item_id, count(*)::BIGINT AS spans, count(*)::BIGINT AS verbatim FROM b GROUP BY 1")
def attach_spans(t: Tables) -> DataFrame:
    """The spans as they are attached to items, and how many of them stand in the text at the places that they name."""
    own = _spans(t).join(t.documents.select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    there = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("sentence")
    return own.groupBy("item_id").agg(F.count("*").alias("spans"), F.count_if(there).alias("verbatim"))


@query("""WITH n AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 6 AS batch FROM documents)
SELECT source, batch::INT AS batch, count(*)::BIGINT AS items, substr(sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 16) AS batch_id FROM n GROUP BY 1, 2""")
def batch_pack(t: Tables) -> DataFrame:
    """Batches of six of a source's items, each named by a digest of its ids."""
    own = I.numbered(t.documents.select("source", "doc_id"), by="source", order="doc_id").withColumn("batch", F.floor(F.col("place") / vocab.BATCH_ITEMS).cast("int"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return own.groupBy("source", "batch").agg(F.count("*").alias("items"), F.substring(T.digest(ids), 1, 16).alias("batch_id"))


@query("""WITH RECURSIVE n AS (SELECT source, doc_id, length(coalesce(text, ''))::BIGINT AS c, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
r AS (SELECT source, doc_id, p, c, 0::BIGINT AS batch, 1 AS items, c AS chars FROM n WHERE p = 1
  UNION ALL SELECT n.source, n.doc_id, n.p, n.c, CASE WHEN r.items < 6 AND r.chars + n.c <= 6000 THEN r.batch ELSE r.batch + 1 END, CASE WHEN r.items < 6 AND r.chars + n.c <= 6000 THEN r.items + 1 ELSE 1 END,
  CASE WHEN r.items < 6 AND r.chars + n.c <= 6000 THEN r.chars + n.c ELSE n.c END FROM r JOIN n ON n.source IS NOT DISTINCT FROM r.source AND n.p = r.p + 1)
SELECT source, batch, count(*)::BIGINT AS items, sum(c)::BIGINT AS chars, substr(sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)), 1, 16) AS batch_id FROM r GROUP BY 1, 2""")
def batch_budget(t: Tables) -> DataFrame:
    """Batches of at most six of a source's items and 6,000 characters; a longer item is a batch of its own."""
    own = t.documents.select("source", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    return B.batch_ids(B.packed(own, by="source", order="doc_id", size="size", most_items=vocab.BATCH_ITEMS, most_chars=6000), by="source", order="doc_id", digest=T.digest)


# --- grounding: benchmark items are the quotes ----------------------------------------------------------
_HITS = "h AS (SELECT d.doc_id, b.item_id AS quote_id, instr(d.text, b.text) AS first, b.text AS quote, d.text FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE len(b.text) >= 15)"


def _quotes(t: Tables, quote: str = "text") -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("quote_id"), F.expr(quote).alias("quote"))


def _texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text")


@query(f"WITH {_HITS} SELECT doc_id, quote_id, (first - 1)::INT AS start, (first - 1 + len(quote))::INT AS \"end\" FROM h")
def ground_exact(t: Tables) -> DataFrame:
    return G.mentions(_quotes(t), _texts(t)).drop("times")


@query(f"WITH {_HITS} SELECT count(*)::BIGINT AS quotes, count(*) FILTER (contains(substr(text, first + 1), quote))::BIGINT AS ambiguous FROM h")
def ground_ambiguous(t: Tables) -> DataFrame:
    return G.mentions(_quotes(t), _texts(t)).agg(F.count("*").alias("quotes"), F.count_if(F.col("times") > 1).alias("ambiguous"))


@query("SELECT item_id AS quote_id FROM benchmark WHERE item_id NOT IN (SELECT b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))")
def ground_missing_anti(t: Tables) -> DataFrame:
    """Quotes that stand nowhere; here short ones are searched too, so that none is called missing unsearched."""
    return _quotes(t).join(G.mentions(_quotes(t), _texts(t), least=1), "quote_id", "left_anti").select("quote_id")


@query(f"WITH {_HITS} SELECT doc_id, quote_id, substr(text, first, len(quote)) = quote AS verified FROM h")
def verify_offsets(t: Tables) -> DataFrame:
    own = G.mentions(_quotes(t), _texts(t)).join(_texts(t), "doc_id").join(_quotes(t), "quote_id")
    return own.select("doc_id", "quote_id", (F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("quote")).alias("verified"))


#: Quotes as a careless hand copies them: no-break spaces, doubled blanks, a line end for the first blank.
_LOOSE = "concat(replace(replace(text, ', ', concat(',', chr(160))), '. ', '.  '), ' ')"
_NORMAL = r"trim(regexp_replace(replace(replace({0}, chr(160), ' '), '…', '...'), '\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {_NORMAL.format("text")} AS plain FROM documents), q AS (SELECT item_id AS quote_id, {_NORMAL.format(_LOOSE)} AS wanted, {_LOOSE} AS quote FROM benchmark)
SELECT doc_id, quote_id, contains(substr(plain, instr(plain, wanted) + 1), wanted) AS ambiguous, wanted AS normal_form FROM d JOIN q ON contains(plain, wanted) WHERE len(quote) >= 15""")
def ground_normalized(t: Tables) -> DataFrame:
    """Quotes with other blanks than the text has, found by normal forms; the normal form of what stands at the place found is the quote's."""
    own = G.mentions(_quotes(t, _LOOSE), _texts(t), normalised=True).join(_texts(t), "doc_id")
    there = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    plain = F.trim(F.regexp_replace(F.replace(F.replace(there, F.lit("\u00a0"), F.lit(" ")), F.lit("…"), F.lit("...")), r"\s+", " "))
    return own.select("doc_id", "quote_id", (F.col("times") > 1).alias("ambiguous"), plain.alias("normal_form"))


#: Quotes with one sign in their middle changed: they stand nowhere exactly.
_ALTERED = "concat(substr(text, 1, CAST(length(text) / 2 AS INT)), '#', substr(text, CAST(length(text) / 2 AS INT) + 2))"


@query()
def ground_fuzzy(t: Tables) -> DataFrame:
    """Quotes with a slip that stand in documents nearly: every pair in which the best window reaches the ratio."""
    return G.fuzzy(G.near(_quotes(t, _ALTERED), _texts(t)))


#: The first third of the quotes as they are, the second loosely copied, the last with a slip.
_EVERY = f"CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN {_LOOSE} ELSE {_ALTERED} END"


@query()
def ground_ladder(t: Tables) -> DataFrame:
    """On which rung each quote stands in each text that can hold it: exact, normalized, fuzzy, ambiguous or missing."""
    return G.ladder(G.near(_quotes(t, _EVERY), _texts(t)))


_SLICED = "s AS (SELECT doc_id AS item_id, 's' || CAST(start // 6000 + 1 AS VARCHAR) AS slice_id, start, least(start + 6000, len(text)) AS stop, substr(text, start + 1, 6000) AS text FROM documents, unnest(range(0, len(text), 6000)) AS r(start))"


@query(f"""WITH {_SLICED}, q AS (SELECT item_id, CASE WHEN item_id % 11 = 0 THEN 's99' ELSE slice_id END AS slice_id, start + item_id % 7 * 10 - CASE WHEN item_id % 13 = 0 THEN 200 ELSE 0 END AS start, item_id % 17 = 0 AS odd,
  start + item_id % 7 * 10 + 40 - CASE WHEN item_id % 13 = 0 THEN 200 ELSE 0 END AS stop, substr(text, item_id % 7 * 10 + 1, CASE WHEN item_id % 5 = 0 THEN 12 ELSE 40 END) AS quote FROM s)
SELECT q.item_id, q.slice_id, CASE WHEN len(quote) < 15 THEN 'short' WHEN s.item_id IS NULL THEN 'unknown slice' WHEN q.start < s.start OR q.stop > s.stop THEN 'outside' WHEN q.stop - q.start <> len(quote) THEN 'length'
  WHEN substr(s.text, q.start - s.start + 1, q.stop - q.start) <> CASE WHEN odd THEN reverse(quote) ELSE quote END THEN 'text' END AS wrong
FROM q LEFT JOIN s ON q.item_id = s.item_id AND q.slice_id = s.slice_id""")
def verify_grounding(t: Tables) -> DataFrame:
    """Cited offsets, some of them wrong in each way there is, against the windows of the documents."""
    cut = t.documents.select(F.col("doc_id").alias("item_id"), F.explode(I.windows(F.col("text"), 6000)).alias("start"), "text")
    slices = cut.select("item_id", F.concat(F.lit("s"), (F.floor(F.col("start") / 6000) + 1).cast("string")).alias("slice_id"), "start", F.least(F.col("start") + 6000, F.length("text")).alias("end"), F.substr("text", F.col("start") + 1, F.lit(6000)).alias("text"))
    at = F.col("start") + F.col("item_id") % 7 * 10 - F.when(F.col("item_id") % 13 == 0, 200).otherwise(0)
    said = F.substr("text", (F.col("item_id") % 7 * 10 + 1).cast("int"), F.when(F.col("item_id") % 5 == 0, 12).otherwise(40))
    own = slices.select("item_id", F.when(F.col("item_id") % 11 == 0, "s99").otherwise(F.col("slice_id")).alias("slice_id"), at.cast("int").alias("start"), (at + 40).cast("int").alias("end"), F.when(F.col("item_id") % 17 == 0, F.reverse(said)).otherwise(said).alias("quote"))
    return G.verify(own, slices).select("item_id", "slice_id", "wrong")


@query("SELECT l.doc_id, d.source, l.quality FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def lineage_join(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id", "left").select("doc_id", "source", "quality")


@query("SELECT doc_id, md5(doc_id::VARCHAR || ':7') AS drawn FROM documents ORDER BY drawn, doc_id LIMIT 25")
def truth_sample(t: Tables) -> DataFrame:
    """Twenty-five documents in the order of a digest: a sample that any run repeats."""
    return t.documents.select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")).cast("binary")).alias("drawn")).orderBy("drawn", "doc_id").limit(25)


@query()
def truth_sample_seeded(t: Tables) -> DataFrame:
    """Twenty-five documents as a seeded generator draws them from all, in its order."""
    return I.seeded_sample(t.documents.select("doc_id", "source"), order="doc_id", size=25, seed=7)


@query("SELECT n_name, count(*)::BIGINT AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def pointer_join(t: Tables) -> DataFrame:
    own = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return own.groupBy("n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))
