"""Chat formatting: links tool calls with results, orders and validates them, in DataFrame operations only."""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Keywords of JSON schemas that are checked, and those that only describe. Any other is refused.
KEYWORDS = set("type enum const minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum multipleOf items minItems maxItems uniqueItems properties required additionalProperties minProperties maxProperties allOf anyOf oneOf not".split())
ANNOTATIONS = set("title description default examples format deprecated readOnly writeOnly $schema $id $comment".split())
#: For each tool the JSON schema of its arguments.
SCHEMAS = {"reply": {"type": "object", "properties": {"prompt": {"type": "string"}}, "required": ["prompt"], "additionalProperties": False}}
#: What the types of JSON schemas are called for a variant.
TYPES = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "object": "OBJECT<.*>", "array": "ARRAY<.*>"}
CALL = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, name, arguments, after) and results (conv_id, turn, call_id, content).

    Assistant texts of the form {"tool_calls": [...]} hold calls, tool texts {"tool_call_id": ..., "content": ...}
    results; what is no such JSON holds none, nor do null texts and roles. Null turns and identifiers are kept.
    """
    calls = messages.where("role = 'assistant'").select("conv_id", "turn", F.explode(F.from_json("text", CALL).tool_calls).alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    results = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("r")).select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    return calls, results.where("call_id is not null")


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain chats as calls and results: a user turn calls `reply` with its text as the prompt, after the user turn
    two before; the assistant turn that follows is the result."""
    key = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    asked = messages.where("role = 'user'")
    calls = asked.select("conv_id", "turn", key(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"), F.array(key(F.col("turn") - 2)).alias("after"))
    results = messages.where("role = 'assistant'").select("conv_id", "turn", key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without predecessors, else one more than the highest of them; null in or behind a cycle.

    edges: conv_id, call_id, needs. Where each call needs one at most, chains are followed by pointer doubling, in as
    many joins as their length has binary digits; otherwise level by level.
    """
    known = nodes.select("conv_id", "call_id").distinct()
    need = settle(edges.join(known.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi").select("conv_id", "call_id", "needs").distinct())
    if need.groupBy("conv_id", "call_id").count().where("count > 1").isEmpty():
        now = settle(known.join(need, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("needs").alias("up"), F.when(F.col("needs").isNull(), 0).otherwise(1).cast("long").alias("level")))
        for _ in range(now.count().bit_length() + 1):  # who is not at a root by then is in or behind a cycle
            if now.where("up is not null").isEmpty():
                break
            up = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
            now = settle(now.join(up, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))
    done = settle(known.join(need, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long")))
    rounds = 0
    while True:
        level = done.withColumnRenamed("call_id", "needs").withColumnRenamed("level", "below")
        ready = need.join(level, ["conv_id", "needs"], "left").groupBy("conv_id", "call_id").agg((F.max("below") + 1).alias("level"), F.bool_and(F.col("below").isNotNull()).alias("all"))
        more = settle(ready.where("all").drop("all").join(done, ["conv_id", "call_id"], "left_anti"))
        if more.isEmpty():
            break
        done, rounds = done.unionByName(more), rounds + 1
        if rounds % 16 == 0:  # each round is kept once; now and then they become one table
            done = settle(done)
    return known.join(done, ["conv_id", "call_id"], "left")


def require_schema(schema: dict | bool) -> None:
    """Checks that a schema has only keywords and types that `conforms` knows; a keyword is never passed over."""
    if isinstance(schema, bool):
        return
    if unknown := set(schema) - KEYWORDS - ANNOTATIONS:
        raise ValueError(f"schema keywords that aren't known: {sorted(unknown)}")
    if unknown := set(_types(schema)) - set(TYPES):
        raise ValueError(f"schema types that aren't known: {sorted(unknown)}")
    inner = [*schema.get("properties", {}).values(), *[x for k in ("anyOf", "oneOf", "allOf") for x in schema.get(k, [])], *[schema[k] for k in ("items", "additionalProperties", "not") if k in schema]]
    for x in inner:
        require_schema(x)


def _types(schema: dict) -> list[str]:
    t = schema.get("type", [])
    return [t] if isinstance(t, str) else list(t)


def conforms(v: Column, schema: dict | bool) -> Column:
    """Whether a variant follows a schema; null (no value at all) follows none.

    A keyword only binds values of the type that it is for. Numbers without a fraction are integers however they are
    written; enum and const compare canonical JSON.
    """
    if isinstance(schema, bool):
        return v.isNotNull() & F.lit(schema)
    shape, text = F.schema_of_variant(v), F.to_json(v)
    number = F.try_variant_get(v, "$", "double")
    kind = {t: F.coalesce(shape.rlike(f"(?s)^({pattern})$"), F.lit(False)) for t, pattern in TYPES.items()}
    kind["integer"] = kind["number"] & F.coalesce(number == F.floor(number), F.lit(False)) | kind["integer"]
    ok = v.isNotNull()

    def must(t: str, condition: Column) -> None:
        nonlocal ok
        ok = ok & (~kind[t] | F.coalesce(condition, F.lit(False)))

    if "type" in schema:
        ok = ok & reduce(or_, [kind[t] for t in _types(schema)], F.lit(False))
    canonical = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    for allowed in ([schema["enum"]] if "enum" in schema else []) + ([[schema["const"]]] if "const" in schema else []):
        ok = ok & text.isin(*map(canonical, allowed))
    string, items = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "array<variant>")
    compared = {
        "minLength": ("string", lambda x: F.char_length(string) >= x), "maxLength": ("string", lambda x: F.char_length(string) <= x), "pattern": ("string", lambda x: string.rlike(x)),
        "minimum": ("number", lambda x: number >= x), "maximum": ("number", lambda x: number <= x), "exclusiveMinimum": ("number", lambda x: number > x), "exclusiveMaximum": ("number", lambda x: number < x),
        "multipleOf": ("number", lambda x: F.abs(number / x - F.round(number / x)) < 1e-9),
        "minItems": ("array", lambda x: F.size(items) >= x), "maxItems": ("array", lambda x: F.size(items) <= x), "items": ("array", lambda x: F.forall(items, lambda e: conforms(e, x))),
        "uniqueItems": ("array", lambda x: F.size(F.array_distinct(F.transform(items, lambda e: F.to_json(e)))) == F.size(items) if x else F.lit(True)),
    }
    for k, (t, condition) in compared.items():
        if k in schema:
            must(t, condition(schema[k]))
    if set(schema) & {"properties", "required", "additionalProperties", "minProperties", "maxProperties"}:
        keys, props, whole = F.json_object_keys(text), schema.get("properties", {}), F.try_variant_get(v, "$", "map<string,variant>")
        inside = lambda p: F.array_contains(keys, p)
        for p in schema.get("required", []):
            must("object", inside(p))
        for p, inner in props.items():
            must("object", ~inside(p) | conforms(F.try_element_at(whole, F.lit(p)), inner))
        if (more := schema.get("additionalProperties", True)) is not True:
            others = F.array_except(keys, F.array(*map(F.lit, props)).cast("array<string>"))
            must("object", F.size(others) == 0 if more is False else F.forall(others, lambda p: conforms(F.try_element_at(whole, p), more)))
        if "minProperties" in schema:
            must("object", F.size(keys) >= schema["minProperties"])
        if "maxProperties" in schema:
            must("object", F.size(keys) <= schema["maxProperties"])
    holds = lambda k: [conforms(v, x) for x in schema[k]]
    if "allOf" in schema:
        ok = ok & reduce(and_, holds("allOf"), F.lit(True))
    if "anyOf" in schema:
        ok = ok & reduce(or_, holds("anyOf"), F.lit(False))
    if "oneOf" in schema:
        ok = ok & (sum((c.cast("int") for c in holds("oneOf")), F.lit(0)) == 1)
    if "not" in schema:
        ok = ok & ~conforms(v, schema["not"])
    return F.coalesce(ok, F.lit(False))


def valid(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Whether the tool is known and its arguments are JSON that conforms to its schema."""
    v, out = F.try_parse_json(arguments), F.lit(False)
    for schema in schemas.values():
        require_schema(schema)
    for tool, schema in schemas.items():
        out = F.when(name == tool, conforms(v, schema)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call: conv_id, turn, call_id, level, status, record (canonical JSON).

    status: duplicate (an earlier turn made the call, or one of the same turn that comes first by name and arguments;
    it takes no result), cycle, unknown_tool, invalid_arguments, unanswered, else ok. Of several results the earliest
    counts. Calls without an id are never answered; a null turn comes first; a null conversation has no links. Records
    have sorted keys and no spaces, arguments too (as text where they are not JSON). Results without a call are left
    out; see orphans. Empty tables give no rows; further columns are ignored.
    """
    calls = settle(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after").withColumn("_row", F.monotonically_increasing_id()))
    firsts = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "_row"))["_row"].alias("first"))
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("a")).select("conv_id", "call_id", F.col("a.content").alias("result"), F.lit(True).alias("answered"))
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("needs"))
    order = levels(calls, edges)
    d = calls.join(firsts, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left").join(order, ["conv_id", "call_id"], "left")
    known = F.coalesce(F.col("name").isin(*schemas), F.lit(False))
    status = (
        F.when(F.col("_row") != F.col("first"), "duplicate").when(F.col("level").isNull() & F.col("call_id").isNotNull(), "cycle").when(~known, "unknown_tool")
        .when(~valid(F.col("name"), F.col("arguments"), schemas), "invalid_arguments").when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    )
    parsed = F.try_parse_json("arguments")
    own = F.when(F.coalesce(F.col("_row") == F.col("first"), F.lit(False)), F.col("result"))
    fields = [F.col("call_id"), F.col("level"), F.col("name"), own.alias("result")]
    as_json = F.to_json(F.struct(parsed.alias("arguments"), *fields))
    as_text = F.to_json(F.struct("arguments", *fields))
    return d.select("conv_id", "turn", "call_id", "level", status.alias("status"), F.when(parsed.isNotNull(), as_json).otherwise(as_text).alias("record"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose identifier no call has."""
    return results.join(calls, ["conv_id", "call_id"], "left_anti")
