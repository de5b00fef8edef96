"""Queries over captures, discovery, lanes and windows of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import html as H
from siftline.functions import urls as U
from siftline.operators import capture, evidence, scoring
from siftline.queries import events, funnel, scores
from siftline.queries.base import Tables, query, quoted, sql_any

_STAMP = "substr(strftime(ts, '%Y%m%d%H%M%S'), 1, ([4, 6, 8, 10, 12, 14, 5])[(event_id % 7 + 1)::INT])"


@query(f"""WITH s AS (SELECT event_id, {_STAMP} AS stamp FROM events)
SELECT event_id, CASE WHEN len(stamp) IN (4, 6, 8, 10, 12, 14) THEN strftime(strptime(stamp || substr('00000101000000', len(stamp) + 1), '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%S') END AS captured_at FROM s""")
def capture_time(t: Tables) -> DataFrame:
    sizes = F.array(*map(F.lit, (4, 6, 8, 10, 12, 14, 5)))
    stamp = F.substr(F.date_format("ts", "yyyyMMddHHmmss"), F.lit(1), F.element_at(sizes, (F.col("event_id") % 7 + 1).cast("int")))
    return t.events.select("event_id", capture.capture_time(stamp).alias("captured_at"))


@query("""WITH c AS (SELECT 'https://firm.com/' || user_id AS url, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, (value * 200)::INT AS size FROM events)
SELECT url, stamp, size FROM c WHERE status = 200 AND NOT (size > 0 AND size < 5000) AND stamp >= '20240105' AND stamp < '20240125' QUALIFY row_number() OVER (PARTITION BY url ORDER BY stamp DESC, size) <= 3""")
def snapshot_pick(t: Tables) -> DataFrame:
    own = t.events.select(
        F.concat(F.lit("https://firm.com/"), "user_id").alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"), F.round(F.col("value") * 200).cast("int").alias("size"),
    )
    return capture.pick_snapshots(own, most=3, since="20240105", until="20240125").select("url", "stamp", "size")


_RULES = (("/en/", False), ("/en/1", True), ("/fr/", False), ("/fr/8", True), ("/de/2", False))
_REACH = {a: "greatest(0, " + ", ".join(f"CASE WHEN starts_with(path, {quoted(p)}) THEN {len(p)} ELSE 0 END" for p, w in _RULES if w == a) + ")" for a in (True, False)}


@query(f"WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT page_id, {_REACH[True]} >= {_REACH[False]} AS allowed FROM p")
def robots_rules(t: Tables) -> DataFrame:
    return t.pages.select("page_id", capture.may_fetch(U.path(F.col("url")), _RULES).alias("allowed"))


_FILES = r"""f AS (SELECT lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS origin, max(coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')) AS most FROM pages GROUP BY 1)"""


@query(rf"""WITH {_FILES},
r AS (SELECT origin, regexp_extract(most, '^(/[^/]*)', 1) AS prefix, false AS allowed FROM f WHERE origin <> '' UNION ALL SELECT origin, most, true FROM f WHERE origin <> '' UNION ALL SELECT origin, '/en/1', false FROM f WHERE origin <> ''),
p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS origin, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM pages)
SELECT p.page_id, p.url, coalesce(max(CASE WHEN r.allowed THEN length(r.prefix) END), -1) >= coalesce(max(CASE WHEN NOT r.allowed THEN length(r.prefix) END), -1) AS allowed
FROM p LEFT JOIN r ON r.origin = p.origin AND starts_with(p.path, r.prefix) GROUP BY 1, 2""")
def robots_pages(t: Tables) -> DataFrame:
    """All pages against the robots files of their origins, which deny the first folder of an origin's last path and one more, and allow that path."""
    path = F.coalesce(F.nullif(U.path(F.col("url")), F.lit("")), F.lit("/"))
    last = t.pages.groupBy(capture.origin(F.col("url")).alias("origin")).agg(F.max(path).alias("most"))
    lines = (F.lit("User-agent: other\nDisallow: /\n\nUSER-AGENT: *\nDisallow: "), F.regexp_extract("most", "^(/[^/]*)", 1), F.lit(" # folder\nAllow: "), F.col("most"), F.lit("\nDisallow: /en/1\nDisallow:\nUser-agent: late\nDisallow: /fr"))
    rules = capture.robots_table(last.where("origin <> ''").select("origin", F.concat(*lines).alias("text")))
    return capture.permitted(t.pages.select("page_id", "url"), rules)


@query("""WITH h AS (SELECT role AS backend, conv_id AS query, md5(text) AS key, len(text) > 100 AS captured FROM conversations),
q AS (SELECT backend, count(DISTINCT query)::BIGINT AS queries, count(*)::BIGINT AS hits, count(DISTINCT key)::BIGINT AS "unique", count(*) FILTER (captured)::BIGINT AS captured, count(*) FILTER (NOT captured)::BIGINT AS skipped FROM h GROUP BY 1)
SELECT *, round(captured / (captured + skipped)::DOUBLE, 3) AS share, round(captured / (captured + skipped)::DOUBLE, 3) >= 0.5 AS enough FROM q""")
def discovery_quality(t: Tables) -> DataFrame:
    hits = t.conversations.select(F.col("role").alias("backend"), F.col("conv_id").alias("query"), F.md5(F.col("text").cast("binary")).alias("key"), (F.length("text") > 100).alias("captured"))
    return capture.discovery_quality(hits)


@query("""WITH b AS (SELECT md5(text) AS key, doc_id, CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE 1 END AS rank FROM documents)
SELECT key, arg_min(rank, (rank, doc_id))::INT AS rank, arg_min(doc_id, (rank, doc_id)) AS doc_id FROM b GROUP BY 1""")
def carried_first(t: Tables) -> DataFrame:
    """Texts of carried sources keep their record; others give theirs to the first."""
    own = t.documents.select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id", F.col("source").isin("src0", "src1").alias("carried"))
    return capture.carried_first(own.where("carried").drop("carried"), own.where("NOT carried").drop("carried"), key="key", order="doc_id")


_TITLE = "lower(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"WITH p AS (SELECT {_TITLE} AS title FROM pages) SELECT {sql_any('title', ('the', 'und', 'que'))} AND NOT {sql_any('title', ('###', '$$$'))} AS kept, count(*)::BIGINT AS n FROM p GROUP BY 1")
def lane_item_filter(t: Tables) -> DataFrame:
    fits = capture.lane_filter(H.title(F.col("html")), include=("the", "und", "que"), exclude=("###", "$$$"))
    return t.pages.select(fits.alias("kept")).groupBy("kept").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT conv_id || ':' || role || ':' || (turn // 2) AS key, md5(string_agg(text, ' ' ORDER BY turn, text)) AS v FROM conversations GROUP BY 1),
a AS (SELECT * FROM s WHERE right(key, 1)::INT % 2 = 0 OR key LIKE '%user%'), b AS (SELECT key, CASE WHEN key LIKE '%1%' THEN v || '.' ELSE v END AS v FROM s WHERE key NOT LIKE '%system%')
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.key = b.key WHERE a.v IS DISTINCT FROM b.v""")
def snapshot_diff(t: Tables) -> DataFrame:
    """Two captures of what each role said in each exchange: one without some exchanges, one without the system's and with others edited."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r.text), " ")
    key = F.concat_ws(":", "conv_id", "role", F.floor(F.col("turn") / 2).cast("string"))
    state = t.conversations.groupBy(key.alias("key")).agg(F.md5(said.cast("binary")).alias("v"))
    old = state.where((F.right("key", F.lit(1)).cast("int") % 2 == 0) | F.contains("key", F.lit("user")))
    new = state.where(~F.contains("key", F.lit("system"))).withColumn("v", F.when(F.contains("key", F.lit("1")), F.concat("v", F.lit("."))).otherwise(F.col("v")))
    return capture.snapshot_diff(old, new, key="key", value="v")


@query(f"WITH {funnel._COVER} SELECT count(*)::BIGINT AS entities, count(*) FILTER (stack_delivery)::BIGINT AS meeting, round(count(*) FILTER (stack_delivery) / count(*)::DOUBLE, 4) AS share FROM k")
def lane_coverage_share(t: Tables) -> DataFrame:
    meeting = F.count_if(F.size(evidence.missing("tier_3")) == 0)
    return evidence.coverage(funnel.parts(t)).agg(F.count("*").alias("entities"), meeting.alias("meeting"), F.round(meeting / F.count("*"), 4).alias("share"))


@query(f"WITH {scores._S} SELECT item, count(*) FILTER (strength > 0)::BIGINT AS supported, count(*) FILTER (strength = 0)::BIGINT AS refused FROM s GROUP BY 1")
def lane_support(t: Tables) -> DataFrame:
    return scores.strengths(t).groupBy("item").agg(F.count_if(F.col("strength") > 0).alias("supported"), F.count_if(F.col("strength") == 0).alias("refused"))


@query(f"WITH {events._ATTEMPTS} SELECT date_trunc('hour', created_at) AS start, provider, count(*)::BIGINT AS attempts, count(*) FILTER (outcome = 'verified')::BIGINT AS verified, round(sum(cost), 6) AS cost FROM a GROUP BY 1, 2")
def attempt_windows(t: Tables) -> DataFrame:
    """Hourly windows of attempts; the stream of the same name adds a watermark."""
    own = events.attempts(t).groupBy(F.window("created_at", "1 hour").alias("w"), "provider").agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "verified").alias("verified"), F.round(F.sum("cost"), 6).alias("cost"))
    return own.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "provider", "attempts", "verified", "cost")


@query("SELECT 'quality' AS name, count(quality)::BIGINT AS filled, count(DISTINCT quality)::BIGINT AS kinds, CASE WHEN min(quality) >= 0 AND max(quality) <= 1 THEN 'boolean' ELSE 'integer' END AS type FROM labels UNION ALL SELECT 'toxic', count(toxic)::BIGINT, count(DISTINCT toxic)::BIGINT, CASE WHEN min(toxic) >= 0 AND max(toxic) <= 1 THEN 'boolean' ELSE 'integer' END FROM labels")
def label_schema_inference(t: Tables) -> DataFrame:
    """What each label column holds, all columns in one pass."""
    names = ("quality", "toxic")
    wide = t.labels.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])).alias("c")).select("c.name", "c.v")
    kind = F.when((F.min("v") >= 0) & (F.max("v") <= 1), "boolean").otherwise("integer")
    return wide.groupBy("name").agg(F.count("v").alias("filled"), F.count_distinct("v").alias("kinds"), kind.alias("type"))


@query(f"WITH {scores._C}, t AS (SELECT {scores._TIER} AS tier, score FROM c) SELECT tier, max(score) AS best, CASE WHEN 50 - max(score) <= 5 THEN 'near' ELSE 'far' END AS reach FROM t WHERE score < 50 GROUP BY 1")
def below_bar(t: Tables) -> DataFrame:
    """The best record below the lowest tier's bar, and whether it is within reach."""
    own = scores.scores(t).select("score", scoring.tier(F.col("score")).alias("tier"))
    best = F.max(F.when(F.col("score") < 50, F.col("score")))
    return own.groupBy("tier").agg(best.alias("best"), F.when(50 - best <= 5, "near").otherwise("far").alias("reach")).where("best IS NOT NULL")
