"""Compiled schemas against cases worked out by hand, and against a plain recursive check of random documents."""

import json
import random
import re

import pytest

from attest.plans.schema import schema_violations

IDENTITY = {"type": "object", "properties": {"traits": {
    "type": "object", "properties": {"email": {"type": "string", "format": "email", "title": "mail", "maxLength": 254}},
    "required": ["email"], "additionalProperties": False}}}


def found(spark, schema, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return sorted((r["i"], r["path"], r["keyword"]) for r in schema_violations(df, "t", schema, ["i"]).collect())


def test_nested_identity(spark):
    texts = ['{"traits": {"email": "a@b.cd"}}', '{"traits": {"email": "a@b.cd", "x": 1}}', '{"traits": {}}', '{"traits": {"email": "nope"}}',
             '{"traits": {"email": 7}}', '{"traits": []}', "{}", "nope", None, '{"traits": {"email": "%s@b.cd"}}' % ("a" * 254), "[]"]
    got = [v for v in found(spark, IDENTITY, texts) if v[0] != 9]
    assert got == [(1, "$.traits.x", "additionalProperties"), (2, "$.traits.email", "required"), (3, "$.traits.email", "format"),
                   (4, "$.traits.email", "type"), (5, "$.traits", "type"), (7, "$", "json"), (8, "$", "json"), (10, "$", "type")]
    assert (9, "$.traits.email", "maxLength") in found(spark, IDENTITY, texts)


@pytest.mark.parametrize("schema, good, bad", [
    ({"type": "integer"}, ["1", "1.0", "-3"], ["1.5", '"1"', "true", "null"]),
    ({"type": ["string", "null"]}, ['"a"', "null"], ["1", "{}"]),
    ({"enum": ["a", 1, None, True]}, ['"a"', "1", "1.0", "null", "true"], ['"b"', "2", "false", "[]"]),
    ({"const": 0}, ["0", "0.0"], ["false", '"0"', "null"]),
    ({"exclusiveMinimum": 1, "maximum": 2}, ["2", "1.5", '"text"', "null"], ["1", "2.5"]),
    ({"minLength": 2, "pattern": "b"}, ['"ab"', "1", "[]"], ['"b"', '"aa"']),
    ({"minItems": 1, "items": {"type": "array", "items": {"maximum": 3}}}, ["[[]]", "[[1, 3]]", "1"], ["[]", "[[1, 4]]", "[1]"]),
    ({"additionalProperties": {"type": "number"}}, ["{}", '{"a": 1}', '[]'], ['{"a": 1, "b": "x"}']),
    ({"allOf": [{"type": "string"}, {"maxLength": 1}]}, ['"a"'], ['"ab"', "1"]),
    ({"properties": {"a": False}, "unheard of": 1}, ["{}", '{"b": 1}'], ['{"a": null}']),
    ({"$ref": "#/definitions/n", "definitions": {"n": {"type": "null"}}}, ["null"], ["0"]),
    (True, ["1", "{}"], []),
])
def test_keywords(spark, schema, good, bad):
    wrapped = {"properties": {"v": schema}, **({"definitions": schema["definitions"]} if schema is not True and "definitions" in schema else {})}
    texts = ['{"v": %s}' % t for t in [*good, *bad]]
    assert {v[0] for v in found(spark, wrapped, texts)} == set(range(len(good), len(texts)))


@pytest.mark.parametrize("schema", [
    {"anyOf": [{}]}, {"$ref": "#/definitions/a", "definitions": {"a": {"properties": {"b": {"$ref": "#/definitions/a"}}}}},
    {"$ref": "other.json"}, {"$ref": "#/definitions/none"}, {"type": "date"}, {"enum": [[1]]},
])
def test_what_is_not_compiled_is_refused(spark, schema):
    with pytest.raises(ValueError):
        found(spark, schema, ["1"])


SCHEMA = {"type": "object", "required": ["a", "b"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 2}, "b": {"type": "array", "maxItems": 2, "items": {
        "type": "object", "required": ["c"], "properties": {"c": {"type": "string", "maxLength": 1}}}},
    "d": {"type": ["null", "object"], "additionalProperties": {"enum": ["x"]}}}}


def plain(schema, value, path="$"):
    kinds = {"object": dict, "array": list, "string": str, "null": type(None), "integer": int}
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if not any(isinstance(value, kinds[n]) and not isinstance(value, bool) for n in names):
            yield path, "type"
    if "enum" in schema and value not in schema["enum"]:
        yield path, "enum"
    if isinstance(value, int) and not isinstance(value, bool) and value < schema.get("minimum", value):
        yield path, "minimum"
    if isinstance(value, str) and len(value) > schema.get("maxLength", len(value)):
        yield path, "maxLength"
    if isinstance(value, list):
        if len(value) > schema.get("maxItems", len(value)):
            yield path, "maxItems"
        for i, item in enumerate(value):
            yield from plain(schema.get("items", {}), item, f"{path}[{i}]")
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                yield f"{path}.{name}", "required"
        for name, item in value.items():
            inner = schema.get("properties", {}).get(name, schema.get("additionalProperties", {}))
            if inner is False:
                yield f"{path}.{name}", "additionalProperties"
            else:
                yield from plain(inner, item, f"{path}.{name}")


def test_random_documents(spark):
    rng = random.Random(13)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return [rng.randrange(4), rng.choice(["x", "yy"]), None, True, "x"][kind]
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcde"): value(depth - 1) for _ in range(rng.randrange(4))}

    def document():
        shape = {"a": rng.randrange(4), "b": [{"c": rng.choice(["x", "yy", 3])} for _ in range(rng.randrange(4))], "d": rng.choice([None, {"k": "x"}, {"k": "z"}])}
        name = rng.choice("abcde")
        shape[name] = value(3)
        if rng.random() < 0.2:
            del shape[rng.choice(sorted(shape))]
        return shape

    documents = [*[value(3) for _ in range(100)], *[document() for _ in range(200)]]
    expected = sorted((i, *v) for i, d in enumerate(documents) for v in plain(SCHEMA, d))
    assert len({v[2] for v in expected}) == 7 and len({re.sub(r"\d", "", v[1]) for v in expected}) > 8
    assert found(spark, SCHEMA, [json.dumps(d) for d in documents]) == expected


def test_a_text_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, "{}")], "i int, t string")
    fields = "spark.sql.debug.maxToStringFields"
    spark.conf.set(fields, "10000")
    try:
        plan = schema_violations(rows, "t", SCHEMA, ["i"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(fields)
    # Where it comes from, where it is parsed, and where it is shown if it is not JSON.
    assert len(re.findall(r"\bt#\d+", plan)) <= 4
