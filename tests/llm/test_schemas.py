"""Argument schemas keyword by keyword against a plain validator; what isn't known is refused."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from cellgrove.llm import mixing, quality, tools

VALUES = ['""', '"a"', '"abc"', '"é"', "0", "3", "-2", "2.5", "1.0", "1e2", "12345678901234567890123", "true", "null", "[]", "[1]", "[1,1]", '[1,"x",3]', "{}", '{"p":1}', '{"p":"s","q":2}', '{"q":{"p":1}}']
SCHEMAS = [
    {}, True, False, {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}, {"type": "null"}, {"type": "array"}, {"type": "object"}, {"type": ["string", "null"]}, {"type": ["integer", "array"]}, {"type": []},
    {"minLength": 1}, {"maxLength": 1}, {"pattern": "^a"}, {"pattern": "c"}, {"minimum": 1}, {"maximum": 2.5}, {"exclusiveMinimum": 0}, {"exclusiveMaximum": 100}, {"multipleOf": 0.5}, {"multipleOf": 3},
    {"enum": ["a", 3, None]}, {"const": [1]}, {"const": {"q": 2, "p": "s"}}, {"items": {"type": "integer"}}, {"minItems": 1}, {"maxItems": 2}, {"uniqueItems": True}, {"uniqueItems": False},
    {"required": ["p"]}, {"properties": {"p": {"type": "integer"}}}, {"properties": {"q": {"required": ["p"]}}}, {"additionalProperties": False}, {"properties": {"p": True}, "additionalProperties": False}, {"additionalProperties": {"type": "integer"}}, {"properties": {"p": {}}, "additionalProperties": {"minimum": 2}}, {"minProperties": 1}, {"maxProperties": 1},
    {"anyOf": [{"type": "string"}, {"minimum": 1, "type": "number"}]}, {"oneOf": [{"type": "number"}, {"type": "integer"}]}, {"allOf": [{"type": "string"}, {"minLength": 2}]}, {"not": {"type": "object"}}, {"title": "t", "description": "d", "type": "string"},
]


def plain(x, s):
    if isinstance(s, bool):
        return s
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    is_a = {"string": isinstance(x, str), "integer": number and x == int(x), "number": number, "boolean": isinstance(x, bool), "null": x is None, "array": isinstance(x, list), "object": isinstance(x, dict)}
    same = lambda a, b: json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
    rules = {
        "type": lambda v: any(is_a[t] for t in ([v] if isinstance(v, str) else v)), "enum": lambda v: any(same(x, y) for y in v), "const": lambda v: same(x, v),
        "minLength": lambda v: not is_a["string"] or len(x) >= v, "maxLength": lambda v: not is_a["string"] or len(x) <= v, "pattern": lambda v: not is_a["string"] or re.search(v, x),
        "minimum": lambda v: not number or x >= v, "maximum": lambda v: not number or x <= v, "exclusiveMinimum": lambda v: not number or x > v, "exclusiveMaximum": lambda v: not number or x < v, "multipleOf": lambda v: not number or x / v == int(x / v),
        "items": lambda v: not is_a["array"] or all(plain(e, v) for e in x), "minItems": lambda v: not is_a["array"] or len(x) >= v, "maxItems": lambda v: not is_a["array"] or len(x) <= v, "uniqueItems": lambda v: not v or not is_a["array"] or all(not same(a, b) for a, b in itertools.combinations(x, 2)),
        "required": lambda v: not is_a["object"] or all(p in x for p in v), "properties": lambda v: not is_a["object"] or all(plain(x[p], y) for p, y in v.items() if p in x),
        "additionalProperties": lambda v: not is_a["object"] or all(plain(e, v) for p, e in x.items() if p not in s.get("properties", {})), "minProperties": lambda v: not is_a["object"] or len(x) >= v, "maxProperties": lambda v: not is_a["object"] or len(x) <= v,
        "anyOf": lambda v: any(plain(x, y) for y in v), "oneOf": lambda v: sum(plain(x, y) for y in v) == 1, "allOf": lambda v: all(plain(x, y) for y in v), "not": lambda v: not plain(x, v),
    }
    return all(rules[k](v) for k, v in s.items() if k in rules)


def test_schemas_by_a_plain_validator(spark):
    d = spark.createDataFrame([(v,) for v in VALUES], "a string").withColumn("v", F.try_parse_json("a"))
    got = {}
    for i in range(0, len(SCHEMAS), 12):
        part = SCHEMAS[i : i + 12]
        for r in d.select("a", *[tools.conforms(F.col("v"), s).alias(f"s{k}") for k, s in enumerate(part)]).collect():
            got |= {(r.a, i + k): r[f"s{k}"] for k in range(len(part))}
    wrong = [(v, SCHEMAS[k]) for (v, k), ok in got.items() if ok != bool(plain(json.loads(v), SCHEMAS[k])) and not (v.startswith("123456") and "multipleOf" in (SCHEMAS[k] if isinstance(SCHEMAS[k], dict) else {}))]
    assert not wrong and len(got) == len(VALUES) * len(SCHEMAS)


@pytest.mark.parametrize("schema", [{"minLenght": 1}, {"properties": {"p": {"$ref": "#/x"}}}, {"anyOf": [{"if": {}}]}, {"type": "text"}, {"additionalProperties": {"dependentRequired": {}}}])
def test_unknown_keywords_are_refused(schema):
    with pytest.raises(ValueError, match="aren't known"):
        tools.valid(F.lit("t"), F.lit("{}"), {"t": schema})


def test_rows_without_id_are_mixed_in_shards(spark):
    d = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = mixing.mix(d, shard_tokens=2000)
    assert got.select("shard").distinct().count() >= 3 and got.count() == 3000
    assert quality.classify(d.limit(3), spark.createDataFrame([], "doc_id long, quality int")).where("held_out").count() == 0
