"""Schemas compiled to Columns, and inferred ones, on hand-made values."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import schema as S


def found(spark, schema, *texts):
    table = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "n int, claims string, at string")
    return [r.violations for r in S.checked(table, "claims", schema).orderBy("n").collect()]


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": "integer"}, ["1", "-3", "1.0", "1e3", "12345678901234567890"], ["1.5", '"1"', "true", "null", "[1]"]),
        ({"type": ["string", "null"]}, ['"a"', "null"], ["0", "{}"]),
        ({"type": "number", "exclusiveMaximum": 5, "minimum": -1}, ["4.99", "-1"], ["5", "-1.01"]),
        ({"minimum": 3}, ['"a"', "[]", "3"], ["2"]),
        ({"enum": ["a", 1, None, True]}, ['"a"', "1.0", "null", "true"], ['"b"', "0", "false", '"1"']),
        ({"const": 2}, ["2"], ["3", '"2"']),
        ({"multipleOf": 0.5}, ["2.5", '"x"'], ["2.3"]),
        ({"minLength": 2, "maxLength": 3, "pattern": "^é"}, ['"éa"', "7"], ['"é"', '"éabc"', '"ab"']),
        ({"type": "array", "items": {"type": "integer"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, ["[1]", "[1,2]"], ["[]", "[1,2,3]", "[1,1]", '["a"]']),
        ({"required": ["a b", "c"]}, ['{"a b":null,"c":1}', "5"], ['{"c":1}', "{}"]),
        ({"properties": {"a": {"type": "object", "properties": {"b": {"type": "boolean"}}}}}, ['{"a":{"b":true}}', '{"a":{}}', "{}"], ['{"a":{"b":1}}', '{"a":[]}', '{"a":null}']),
        ({"properties": {"a": {}}, "additionalProperties": False}, ['{"a":1}', "{}", "[]"], ['{"b":1}', '{"a":1,"c":null}']),
        ({"additionalProperties": {"type": "string"}}, ['{"x":"y"}'], ['{"x":1}']),
        ({"anyOf": [{"type": "string"}, {"minimum": 3, "type": "number"}]}, ['"a"', "3"], ["2", "null"]),
        ({"allOf": [{"minimum": 3}, {"maximum": 4}]}, ["3"], ["2", "5"]),
        ({"not": {"type": "null"}, "title": "ignored"}, ["1"], ["null"]),
        ({"items": {"items": {"type": "array", "items": {"const": 1}}}}, ["[[[1]],[]]"], ["[[[1],[2]]]", "[[1]]"]),
        ({"properties": {"a": False, "b": True}}, ['{"b":1}'], ['{"a":1}']),
    ],
)
def test_words_of_schemas(spark, schema, good, bad):
    assert all(v == [] for v in found(spark, schema, *good)) and all(found(spark, schema, *bad))


def test_places_are_told(spark):
    schema = {"type": "object", "required": ["z"], "properties": {"a": {"items": {"properties": {"b": {"maximum": 1}}}}}, "additionalProperties": False}
    assert found(spark, schema, '{"a":[{"b":0},{"b":2}],"y":1}', None, "{", '{"z":1,"z":2}', "[" * 100_000, "3") == [["$.a[1].b: maximum", "$.y: additional", "$.z: required"], ["$: json"], ["$: json"], ["$: json"], ["$: json"], ["$: type"]]
    for wrong in ({"$ref": "#"}, {"type": "text"}, {"enum": [[1]]}, {"properties": {"'\"": {"type": "null"}}}):
        with pytest.raises(ValueError):
            S.violations(F.try_parse_json(F.lit("1")), wrong)


def test_inferred_lattice(spark):
    texts = ['{"a":null,"m":1,"l":[1,2.5],"o":{"x":1},"t":true}', '{"a":null,"m":2.0,"l":[null],"o":{"x":"s","y":[]},"t":3}', '{"a":null,"m":[1],"l":[],"t":null}', "no json", None, "", "[" * 100_000, '{"m":{"q":1},"a":null,"l":[],"t":1}']
    table = spark.createDataFrame([(t, "x") for t in texts], "claims string, place string").repartition(3)
    got = {r.place: (r.type, r.seen, r.nulls_too, r.required) for r in S.inferred(table, "claims").collect()}
    assert got == {
        "$": ("object", 4, False, True), "$.a": ("null", 4, True, True), "$.m": ("string", 4, False, True), "$.m[]": ("integer", 1, False, True), "$.m.q": ("integer", 1, False, True), "$.l": ("array", 4, False, True),
        "$.l[]": ("number", 3, True, True), "$.o": ("object", 2, False, False), "$.o.x": ("string", 2, False, True), "$.o.y": ("array", 1, False, False), "$.t": ("integer", 4, True, True),
    }
    assert S.inferred(table.where("false"), "claims").collect() == []


def test_inferred_schema_holds_its_own_table(spark):
    texts = ['{"a":1,"b":["x",null],"c":{"d":1.5}}', '{"a":null,"b":[],"c":{"d":2}}', '{"b":["y"],"c":{"d":3,"e":false}}']
    table = spark.createDataFrame([(t,) for t in texts], "claims string")
    made = S.as_schema([(r.place, r.type, r.nulls_too, r.required) for r in S.inferred(table, "claims").collect()])
    assert json.loads(json.dumps(made)) == made and made["required"] == ["b", "c"]
    assert found(spark, made, *texts) == [[], [], []] and found(spark, made, '{"a":"s","b":[1],"c":{}}') == [["$.a: type", "$.b[0]: type", "$.c.d: required"]]
