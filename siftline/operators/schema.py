"""JSON by schema: a schema compiled to one Column of violations, and a schema inferred from what a table holds.

Both work on JSON text in a column. The compiler makes an expression over variants, so that claims are checked inside a scan; the
inference merges types in a lattice that each task folds for itself before anything is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import let

#: Words of a schema that say nothing about a value.
SILENT = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format"}
#: Kinds of numbers among variants.
NUMBERS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DOUBLE")


def _read(value: Column) -> Column:
    """A variant with its kind, which is worked out once for all that is asked about it."""
    return F.struct(value.alias("v"), F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).alias("kind"))


def _number(x: Column) -> Column:
    return F.try_variant_get(x["v"], "$", "double")


def _is(x: Column, kind: str) -> Column:
    if kind in ("number", "integer"):
        return x["kind"].isin(*NUMBERS) if kind == "number" else x["kind"].isin(*NUMBERS) & (_number(x) % 1 == 0)
    names = {"null": "VOID", "boolean": "BOOLEAN", "string": "STRING", "array": "ARRAY", "object": "OBJECT"}
    if kind not in names:
        raise ValueError(f"no JSON type: {kind!r}")
    return x["kind"] == names[kind]


def _equals(x: Column, wanted) -> Column:
    if wanted is None:
        return _is(x, "null")
    if isinstance(wanted, bool):
        return _is(x, "boolean") & (F.try_variant_get(x["v"], "$", "boolean") == wanted)
    if isinstance(wanted, int | float):
        return _is(x, "number") & (_number(x) == float(wanted))
    if isinstance(wanted, str):
        return _is(x, "string") & (F.try_variant_get(x["v"], "$", "string") == wanted)
    raise ValueError(f"only plain values can be listed: {wanted!r}")


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _part(value: Column, name: str) -> Column:
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a property's name may not hold both kinds of quotes: {name!r}")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def violations(value: Column, schema: dict | bool, at: Column | None = None) -> Column:
    """What is wrong with a variant by a JSON schema, as ``place: word`` (``$.tags[1]: type``), in no certain order; empty for a good one.

    Known words: type, enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength, maxLength, pattern,
    properties, required, additionalProperties, items, minItems, maxItems, uniqueItems, anyOf, allOf, not; others raise ValueError
    when the schema is compiled. As in the standard, a word about another type than the value's says nothing. Patterns are Java's.
    Null (no JSON at all) is one violation of ``json``.
    """
    place = F.lit("$") if at is None else at
    none = F.array().cast("array<string>")
    if isinstance(schema, bool):
        return none if schema else F.array(F.concat(place, F.lit(": false")))
    found = let(_read(value), lambda x: _broken(x, schema, place))
    return found if at is not None else F.when(value.isNull(), F.array(F.concat(place, F.lit(": json")))).otherwise(found)


def _broken(x: Column, schema: dict, place: Column) -> Column:
    """The violations of a value that ``_read`` gave."""
    value, none = x["v"], F.array().cast("array<string>")
    rules: list[tuple[str, Column]] = []  # word, and when it is violated
    deeper: list[Column] = []
    number, string, array, object_ = (_is(x, k) for k in ("number", "string", "array", "object"))
    text, items = F.try_variant_get(value, "$", "string"), _list(value)
    for word, said in schema.items():
        if word in SILENT:
            continue
        if word == "type":
            kinds = [said] if isinstance(said, str) else said
            one = _is(x, kinds[0])
            for k in kinds[1:]:
                one = one | _is(x, k)
            rules.append((word, ~one))
        elif word in ("enum", "const"):
            listed = said if word == "enum" else [said]
            one = F.lit(False)
            for w in listed:
                one = one | _equals(x, w)
            rules.append((word, ~one))
        elif word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            n, limit = _number(x), float(said)
            rules.append((word, number & {"minimum": n < limit, "maximum": n > limit, "exclusiveMinimum": n <= limit, "exclusiveMaximum": n >= limit, "multipleOf": n % limit != 0}[word]))
        elif word in ("minLength", "maxLength"):
            rules.append((word, string & (F.length(text) < said if word == "minLength" else F.length(text) > said)))
        elif word == "pattern":
            rules.append((word, string & ~text.rlike(said)))
        elif word in ("minItems", "maxItems"):
            rules.append((word, array & (F.size(items) < said if word == "minItems" else F.size(items) > said)))
        elif word == "uniqueItems":
            told = F.transform(items, lambda i: F.to_json(i))
            rules.append((word, array & F.lit(bool(said)) & (F.size(F.array_distinct(told)) < F.size(told))))
        elif word == "required":
            missing = F.filter(F.array(*(F.when(_part(value, name).isNull(), F.concat(place, F.lit(f".{name}: required"))) for name in said)), lambda x: x.isNotNull())
            deeper.append(F.when(object_, missing).otherwise(none) if said else none)
        elif word == "properties":
            for name, sub in said.items():
                held = let(_part(value, name), lambda p: F.when(p.isNotNull(), violations(p, sub, F.concat(place, F.lit(f".{name}")))).otherwise(none))  # noqa: B023
                deeper.append(F.when(object_, held).otherwise(none))
        elif word == "additionalProperties":
            known = F.array(*map(F.lit, schema.get("properties", {}))) if schema.get("properties") else none
            others = F.filter(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: ~F.array_contains(known, e["key"]))
            found = F.flatten(F.transform(others, lambda e: F.array(F.concat(place, F.lit("."), e["key"], F.lit(": additional"))) if said is False else violations(e["value"], said, F.concat(place, F.lit("."), e["key"]))))
            deeper.append(F.when(object_, found).otherwise(none))
        elif word == "items":
            found = F.flatten(F.transform(items, lambda item, i: violations(item, said, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")))))
            deeper.append(F.when(array, found).otherwise(none))
        elif word == "allOf":
            deeper += [violations(value, sub, place) for sub in said]
        elif word in ("anyOf", "not"):
            good = [F.size(violations(value, sub, place)) == 0 for sub in (said if word == "anyOf" else [said])]
            one = good[0]
            for g in good[1:]:
                one = one | g
            rules.append((word, one if word == "not" else ~one))
        else:
            raise ValueError(f"not a known word of a schema: {word!r}")
    own = F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.concat(place, F.lit(f": {word}"))) for word, broken in rules)), lambda x: x.isNotNull()) if rules else none
    return F.concat(own, *deeper) if deeper else own


def checked(rows: DataFrame, claims: str, schema: dict, *, into: str = "violations") -> DataFrame:
    """The rows with the sorted violations of their JSON text ``claims``. Text that is no JSON, or names a key twice, violates ``json``."""
    return rows.withColumn(into, F.array_sort(let(F.try_parse_json(claims), lambda v: violations(v, schema))))


# --- inference --------------------------------------------------------------------------------------
#: The lattice: bits of what a place has held. Scalars rise from null to string; a list or an object meets others in string, as its text.
KINDS = ("null", "boolean", "integer", "number", "string", "array", "object")
#: Places of which a task holds counts before it hands them on.
PLACES = 50_000


def _walk(value, found: dict[str, list]) -> None:
    """Adds the kinds of a value and of all inside it to the place's bits and counts."""
    todo = [("$", "", value)]
    while todo:
        place, parent, v = todo.pop()
        kind = 0 if v is None else 1 if isinstance(v, bool) else 2 if isinstance(v, int) else 3 if isinstance(v, float) else 4 if isinstance(v, str) else 5 if isinstance(v, list) else 6
        at = found.setdefault(place, [parent, 0, 0, 0])
        at[1] |= 1 << kind
        at[2] += 1
        at[3] += kind == 6
        if kind == 5:
            todo.extend((f"{place}[]", place, x) for x in v)
        elif kind == 6:
            todo.extend((f"{place}.{k}", place, x) for k, x in v.items())


def inferred(rows: DataFrame, column: str) -> DataFrame:
    """(place, type, seen, nulls_too, required) of the JSON texts of a column: the least type of the lattice that holds all values of a place.

    ``$.tags[]`` stands for all items of a list. A place is required if each object that could hold it does. Texts that are null or no
    JSON are left out; a place that held nothing but nulls has the type null.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def told() -> pa.RecordBatch:
            columns = list(zip(*((place, *at) for place, at in found.items()), strict=True)) or [(), (), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["place", "parent", "bits", "seen", "objects"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    value = json.loads(text or "")
                except (ValueError, RecursionError):
                    continue
                _walk(value, found)
                if len(found) > PLACES:
                    yield told()
                    found = {}
        yield told()

    each = rows.select(F.col(column).cast("string")).mapInArrow(fold, "place string, parent string, bits int, seen long, objects long")
    own = each.groupBy("place", "parent").agg(F.bit_or("bits").alias("bits"), F.sum("seen").alias("seen"), F.sum("objects").alias("objects"))
    above = own.select(F.col("place").alias("parent"), F.col("objects").alias("holders"))
    bits = F.col("bits").bitwiseAND(F.lit(~1))
    kind = F.when(bits == 0, "null")
    for n in (6, 5):
        kind = kind.when(bits == 1 << n, KINDS[n])
    for n in (4, 3, 2, 1):
        kind = kind.when(bits.bitwiseAND(F.lit(1 << 5 | 1 << 6 | 1 << n)) != 0 if n == 4 else bits.bitwiseAND(F.lit(1 << n)) != 0, KINDS[n])
    item = F.endswith("place", F.lit("[]"))
    required = F.when(item | (F.col("parent") == ""), F.lit(True)).otherwise(F.col("seen") == F.col("holders"))
    return own.join(above, "parent", "left").select("place", kind.alias("type"), "seen", (F.col("bits").bitwiseAND(F.lit(1)) != 0).alias("nulls_too"), required.alias("required"))


def as_schema(places: list[tuple[str, str, bool, bool]]) -> dict:
    """A JSON schema of inferred places (place, type, nulls_too, required), which ``violations`` takes; for what a driver can hold."""
    made: dict[str, dict] = {}
    for place, kind, nulls, _ in places:
        made[place] = {"type": [kind, "null"] if nulls and kind != "null" else kind}
    for place, _, _, required in sorted(places):
        if place.endswith("[]"):
            made[place[:-2]]["items"] = made[place]
        elif place != "$":
            parent, _, name = place.rpartition(".")
            made[parent].setdefault("properties", {})[name] = made[place]
            if required:
                made[parent].setdefault("required", []).append(name)
    return made.get("$", {})
