"""Queries over JSON claims made from orders, conversations, events and documents: checked by a schema, and schemas inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import schema as S
from siftline.queries.base import Tables, query, quoted

ORDER_SCHEMA = {
    "type": "object", "required": ["score", "status", "meta"], "additionalProperties": False,
    "properties": {
        "score": {"type": "integer", "minimum": 0, "maximum": 100}, "status": {"enum": ["O", "F", 1]}, "priority": {"type": "string", "pattern": "^[1-5]-[A-Z]", "maxLength": 8},
        "price": {"anyOf": [{"type": "number", "exclusiveMinimum": 1000}, {"type": "null"}]},
        "meta": {"type": "object", "required": ["tags", "customer"], "properties": {"customer": {"type": "integer", "multipleOf": 2}, "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"type": "string", "minLength": 2}}}, "additionalProperties": {"type": "string"}},
    },
}
TURN_SCHEMA = {
    "type": "object", "required": ["role", "words"], "not": {"required": ["secret"]},
    "properties": {
        "role": {"const": "assistant"}, "turn": {"type": ["integer", "null"], "maximum": 3}, "words": {"type": "array", "maxItems": 3, "items": {"type": "string", "minLength": 3, "pattern": "^[a-n]"}},
        "first": {"type": "boolean"}, "more": {"type": "array", "items": {"type": "array", "items": {"type": "number"}}},
    },
}

#: Both engines read these: claims of orders and of turns as JSON text.
_ORDER = """concat('{"score":', CASE WHEN o_orderstatus = 'P' THEN '"high"' WHEN o_custkey % 10 = 0 THEN concat(CAST(o_custkey % 90 AS VARCHAR(9)), '.0') WHEN o_custkey % 10 = 1 THEN '7.5' ELSE CAST(o_custkey % 140 - 5 AS VARCHAR(9)) END, ',"status":"', o_orderstatus, '","price":',
  CASE WHEN o_totalprice < 30000 THEN 'null' WHEN o_totalprice < 60000 THEN '"cheap"' ELSE CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS VARCHAR(20)) END, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat(',"priority":"', o_orderpriority, '"') END,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat(',"meta":{"customer":', CAST(o_custkey AS VARCHAR(9)), ',"tags":', CASE o_custkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN '["aa","b","aa"]' WHEN 2 THEN '"none"' ELSE concat('["', o_orderpriority, '",', CAST(o_custkey AS VARCHAR(9)), ']') END,
  CASE WHEN o_custkey % 7 = 0 THEN ',"note":5' ELSE ',"note":"x"' END, '}') END, CASE WHEN o_custkey % 11 = 0 THEN ',"extra":1}' WHEN o_custkey % 11 = 1 THEN ',' ELSE '}' END)"""
_TURN = """concat('{"role":"', role, '","turn":', CASE WHEN turn = 0 THEN 'null' ELSE CAST(turn AS VARCHAR(9)) END, ',"words":', {words}, CASE WHEN turn = 1 THEN ',"secret":true' ELSE '' END, ',"first":', CASE WHEN turn = 0 THEN 'true' ELSE CAST(turn AS VARCHAR(9)) END,
  CASE WHEN turn % 2 = 0 THEN concat(',"more":[[1,2.5],[', CAST(turn AS VARCHAR(9)), ',"', role, '"],3]') ELSE '' END, '}')"""
_SPARK_WORDS = "to_json(slice(split(trim(regexp_replace(lower(text), '[^a-z]+', ' ')), ' '), 1, cast(2 + turn % 3 as int)))"
_DUCK_WORDS = "to_json(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')[1:2 + turn % 3])::VARCHAR"

_DUCK_TYPES = {"null": "t = 'NULL'", "boolean": "t = 'BOOLEAN'", "string": "t = 'VARCHAR'", "array": "t = 'ARRAY'", "object": "t = 'OBJECT'", "number": "t IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')", "integer": "(t IN ('UBIGINT', 'BIGINT') OR t = 'DOUBLE' AND TRY_CAST({v} AS DOUBLE) = floor(TRY_CAST({v} AS DOUBLE)))"}


def _duck_is(v: str, kind: str) -> str:
    return "(" + _DUCK_TYPES[kind].replace("t ", f"json_type({v}) ", 2).format(v=v) + ")"


def sql_violations(v: str, schema: dict, at: str, depth: int = 0) -> str:
    """DuckDB's list of violations of the JSON value ``v`` at the place that the SQL ``at`` tells: told from the standard's words, apart from the compiler."""
    x, i = f"x{depth}", f"i{depth}"
    is_ = lambda kind: _duck_is(v, kind)
    string = f"({v} ->> '$')"
    told = []

    def rule(word: str, broken: str) -> None:
        told.append(f"CASE WHEN coalesce({broken}, false) THEN [{at} || ': {word}'] ELSE [] END")

    for word, said in schema.items():
        if word == "type":
            rule(word, "NOT (" + " OR ".join(is_(k) for k in ([said] if isinstance(said, str) else said)) + ")")
        elif word in ("enum", "const"):
            same = [f"({is_('string')} AND {string} = {quoted(w)})" if isinstance(w, str) else f"(CASE WHEN {is_('number')} THEN TRY_CAST({v} AS DOUBLE) = {w} ELSE false END)" for w in (said if word == "enum" else [said])]
            rule(word, "NOT (" + " OR ".join(same) + ")")
        elif word in ("minimum", "maximum", "exclusiveMinimum", "multipleOf"):
            sign = {"minimum": f"< {said}", "maximum": f"> {said}", "exclusiveMinimum": f"<= {said}", "multipleOf": f"% {said} <> 0"}[word]
            rule(word, f"CASE WHEN {is_('number')} THEN TRY_CAST({v} AS DOUBLE) {sign} ELSE false END")
        elif word in ("minLength", "maxLength"):
            rule(word, f"{is_('string')} AND length({string}) {'<' if word == 'minLength' else '>'} {said}")
        elif word == "pattern":
            rule(word, f"{is_('string')} AND NOT regexp_matches({string}, {quoted(said)})")
        elif word in ("minItems", "maxItems"):
            rule(word, f"{is_('array')} AND json_array_length({v}) {'<' if word == 'minItems' else '>'} {said}")
        elif word == "uniqueItems":
            rule(word, f"CASE WHEN {is_('array')} THEN len(list_distinct(TRY_CAST({v} AS JSON[]))) < json_array_length({v}) ELSE false END")
        elif word == "required":
            told += [f"CASE WHEN {is_('object')} AND NOT list_contains(json_keys({v}), '{n}') THEN [{at} || '.{n}: required'] ELSE [] END" for n in said]
        elif word == "properties":
            told += [f"CASE WHEN {is_('object')} AND list_contains(json_keys({v}), '{n}') THEN {sql_violations(f'json_extract({v}, {quoted(chr(36) + chr(46) + n)})', s, f'{at} || {quoted(chr(46) + n)}', depth + 1)} ELSE [] END" for n, s in said.items()]
        elif word == "additionalProperties":
            known = ", ".join(map(quoted, schema["properties"]))
            one = f"[{at} || '.' || {x} || ': additional']" if said is False else sql_violations(f"json_extract({v}, '$.' || {x})", said, f"{at} || '.' || {x}", depth + 1)
            told.append(f"CASE WHEN {is_('object')} THEN flatten(list_transform(list_filter(json_keys({v}), lambda k: k NOT IN ({known})), lambda {x}: {one})) ELSE [] END")
        elif word == "items":
            one = sql_violations(f"json_extract({v}, '$[' || {i} || ']')", said, f"{at} || '[' || {i} || ']'", depth + 1)
            told.append(f"CASE WHEN {is_('array')} THEN flatten(list_transform(range(json_array_length({v})::BIGINT), lambda {i}: {one})) ELSE [] END")
        elif word in ("anyOf", "not"):
            good = [f"len({sql_violations(v, s, at, depth + 1)}) = 0" for s in (said if word == "anyOf" else [said])]
            rule(word, " OR ".join(good) if word == "not" else f"NOT ({' OR '.join(good)})")
    return "(" + " || ".join(told) + ")"


def _checked_sql(table: str, key: str, claims: str, schema: dict) -> str:
    return f"""WITH c AS (SELECT {key} AS id, {claims} AS claims FROM {table}), v AS (SELECT id, CASE WHEN json_valid(claims) THEN claims::JSON END AS c FROM c)
SELECT id, array_to_string(list_sort(CASE WHEN c IS NULL THEN ['$: json'] ELSE {sql_violations("c", schema, "'$'")} END), '; ') AS violations FROM v"""


@query(_checked_sql("orders", "o_orderkey", _ORDER, ORDER_SCHEMA))
def claims_schema_orders(t: Tables) -> DataFrame:
    """Claims of orders against a schema of nested objects, lists, bounds, patterns and alternatives."""
    own = S.checked(t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_ORDER).alias("claims")), "claims", ORDER_SCHEMA)
    return own.select("id", F.array_join("violations", "; ").alias("violations"))


@query(_checked_sql("conversations", "conv_id * 1000 + turn", _TURN.replace("{words}", _DUCK_WORDS), TURN_SCHEMA))
def claims_schema_turns(t: Tables) -> DataFrame:
    """Turns of conversations against a schema of constants, several types, lists of lists and words that may not be there."""
    own = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(_TURN.replace("{words}", _SPARK_WORDS)).alias("claims"))
    return S.checked(own, "claims", TURN_SCHEMA).select("id", F.array_join("violations", "; ").alias("violations"))


_SOURCES = {
    "orders": _ORDER,
    "events": """concat('{"user":', CAST(user_id AS VARCHAR(20)), ',"value":', CASE WHEN event_type = 'error' THEN 'null' WHEN event_type = 'signup' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)) ELSE concat(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(20)), '.5') END, ',"props":', props,
  CASE WHEN event_type = 'click' THEN ',"tags":["a",1,{"deep":[true,null]}]' WHEN event_type = 'view' THEN ',"tags":[]' ELSE '' END, '}')""",
    "documents": """concat('{"doc":', CAST(doc_id AS VARCHAR(20)), CASE WHEN lang IS NULL THEN '' ELSE concat(',"lang":"', lang, '"') END, ',"size":', CASE WHEN text IS NULL THEN 'null' WHEN length(text) < 100 THEN concat('"', CAST(length(text) AS VARCHAR(20)), '"') WHEN length(text) < 1000 THEN CAST(length(text) AS VARCHAR(20)) ELSE '{"k":1}' END, CASE WHEN doc_id % 50 = 0 THEN '' ELSE '}' END)""",
    "conversations": """concat('{"first":', CASE WHEN turn = 0 THEN 'true' ELSE CAST(turn AS VARCHAR(9)) END, ',"by":{"', role, '":', CAST(length(text) AS VARCHAR(9)), '}}')""",
}
_BITS = "bit_or(CASE type WHEN 'NULL' THEN 1 WHEN 'BOOLEAN' THEN 2 WHEN 'UBIGINT' THEN 4 WHEN 'BIGINT' THEN 4 WHEN 'DOUBLE' THEN 8 WHEN 'VARCHAR' THEN 16 WHEN 'ARRAY' THEN 32 ELSE 64 END)"


@query(f"""WITH j AS ({" UNION ALL ".join(f"SELECT '{n}' AS source, {e} AS j FROM {n}" for n, e in _SOURCES.items())}),
v AS MATERIALIZED (SELECT source, j FROM j WHERE json_valid(j)),
n AS (SELECT v.source, regexp_replace(e.fullkey, '\\[\\d+\\]', '[]', 'g') AS place, e.type FROM v, json_tree(v.j) e),
p AS (SELECT source, place, {_BITS} AS bits, count(*)::BIGINT AS seen, count(*) FILTER (type = 'OBJECT') AS objects FROM n GROUP BY ALL)
SELECT p.source, p.place, CASE WHEN p.bits <= 1 THEN 'null' WHEN p.bits & ~1 = 64 THEN 'object' WHEN p.bits & ~1 = 32 THEN 'array' WHEN p.bits & (16 | 32 | 64) <> 0 THEN 'string' WHEN p.bits & 8 <> 0 THEN 'number' WHEN p.bits & 4 <> 0 THEN 'integer' ELSE 'boolean' END AS type,
  p.seen, p.bits & 1 = 1 AS nulls_too, ends_with(p.place, '[]') OR p.place = '$' OR p.seen = u.objects AS required
FROM p LEFT JOIN p AS u ON u.source = p.source AND u.place = regexp_replace(p.place, '(\\[\\]|\\.[^.\\[]*)$', '')""")
def schema_inference(t: Tables) -> DataFrame:
    """The least schema of JSON texts of four tables, with places that mix types, are missing, or hold nothing but nulls."""
    each = [S.inferred(getattr(t, name).select(F.expr(e).alias("j")), "j").select(F.lit(name).alias("source"), "*") for name, e in _SOURCES.items()]
    return reduce(DataFrame.unionByName, each)
