"""Chat formatting: tool calls linked with their results, ordered, validated and serialised as canonical JSON.

Calls and results are joined by (conversation, call id). A call's level is the length of the longest chain of calls that
it depends on; calls in the order of (level, position, id) follow all that they depend on. Chains of calls with one
dependency are followed by pointer doubling, in as many rounds as the logarithm of their length; only calls with several
dependencies are peeled, a round for each such call on a path. Arguments are validated against JSON schemas that are
compiled to expressions: types and lists of them, bounds, patterns, enumerations, members, items, allOf, anyOf, oneOf, not
and local references; a schema with any other rule is refused. Canonical JSON has sorted keys at every depth, no blanks, and no null members at the top.

Scale: everything is DataFrame expressions; the join's key holds the call id, so a conversation with a third of all
turns is dealt out like any other. No conversation is gathered in one task.

Defined results: a call without a result has status ``no_result``, a result without a call ``orphan``; of results
(calls) with one id the first by position counts, of those with one position the least by content; a dependency on a
call that nobody made is none; arguments that aren't JSON are invalid and serialised as a string; calls in or behind a
cycle of dependencies have no level, as have orphans; rows with a null conversation or id can't be linked and keep their
own row without a level; null text is an empty argument or result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage, staged_so_far

CALLS = ("conv_id", "call_id", "name", "arguments", "position", "after")
RESULTS = ("conv_id", "call_id", "content", "position")

#: Schema type by what ``schema_of_variant`` says.
_TYPES = {
    "string": "^STRING", "integer": "^(?:BIGINT|DECIMAL\\(\\d+,0\\))", "number": "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN",
    "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID",
}


#: Words of a schema that say nothing about values.
_NOTES = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format", "$schema", "$id", "$comment", "$defs", "definitions"}


def _member(path: str, name: str) -> str:
    """A variant's path to a member of any name."""
    if name.isidentifier():
        return f"{path}.{name}"
    quote = next((q for q in "'\"" if q not in name), None)
    if quote is None:
        raise ValueError(f"a member's name with both kinds of quotes can't be reached: {name}")
    return f"{path}[{quote}{name}{quote}]"


def _referred(schema: dict[str, Any], whole: dict[str, Any], above: tuple[str, ...]) -> tuple[dict[str, Any], tuple[str, ...]]:
    """The schema that a local ``$ref`` names; one that leads to itself has no expression."""
    ref = schema["$ref"]
    if not ref.startswith("#/") or ref in above:
        raise ValueError(f"only local references that don't repeat are known: {ref}")
    found: Any = whole
    for part in ref[2:].split("/"):
        found = found[part.replace("~1", "/").replace("~0", "~")]
    return found, (*above, ref)


def schema_errors(value: Column, schema: dict[str, Any] | bool, path: str = "$", at: str = "$", whole: dict[str, Any] | None = None, above: tuple[str, ...] = ()) -> list[Column]:
    """One expression a rule: null, or what is wrong. value: a variant (null: absent); path: as shown; at: as variants
    are asked. A word of the schema that isn't known is an error when the schema is compiled, never passed over."""
    if isinstance(schema, bool):
        schema = {} if schema else {"not": {}}
    whole = schema if whole is None else whole
    unknown = set(schema) - _NOTES - _RULES.keys() - {"type", "$ref", "required", "properties", "items", "additionalProperties", "anyOf", "oneOf", "allOf", "not"}
    if unknown:
        raise ValueError(f"{path}: unknown words in a schema: {', '.join(sorted(unknown))}")
    here = lambda p: F.try_variant_get(value, p, "variant")
    inner = lambda s, v=value, p=path, q=at, seen=above: schema_errors(v, s, p, q, whole, seen)
    holds = lambda s: F.coalesce(*inner(s), F.lit(None).cast("string")).isNull()
    there = here(at).isNotNull()
    wrong = lambda fails, what: F.when(there & fails, f"{path}: {what}")
    out = []
    if "$ref" in schema:
        found, seen = _referred(schema, whole, above)
        out += inner(found, seen=seen)
    if want := schema.get("type"):
        kinds = [want] if isinstance(want, str) else want
        out.append(wrong(~F.schema_of_variant(here(at)).rlike("|".join(_TYPES[k] for k in kinds)), f"not {' or '.join(kinds)}"))
    for rule, fails in _RULES.items():
        if rule in schema:
            out.append(wrong(fails(value, at, schema[rule]), rule))
    for s in schema.get("allOf", ()):
        out += inner(s)
    if "anyOf" in schema:
        out.append(wrong(~F.array_contains(F.array(*map(holds, schema["anyOf"])), True), "anyOf"))
    if "oneOf" in schema:
        out.append(wrong(F.size(F.filter(F.array(*map(holds, schema["oneOf"])), lambda x: x)) != 1, "oneOf"))
    if "not" in schema:
        out.append(wrong(holds(schema["not"]), "not"))
    for name in schema.get("required", ()):
        out.append(F.when(there & F.schema_of_variant(here(at)).rlike(_TYPES["object"]) & here(_member(at, name)).isNull(), f"{path}.{name}: missing"))
    for name, s in schema.get("properties", {}).items():
        out += inner(s, p=f"{path}.{name}", q=_member(at, name))
    if "items" in schema:
        bad = lambda x: F.coalesce(*inner(schema["items"], v=x, p="$", q="$"), F.lit(None).cast("string")).isNotNull()
        out.append(F.when(F.exists(F.try_variant_get(value, at, "array<variant>"), bad), f"{path}: items"))
    more = schema.get("additionalProperties", True)
    if more is False:
        known = F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>")
        out.append(F.when(F.size(F.array_except(F.json_object_keys(F.to_json(here(at))), known)) > 0, f"{path}: additional members"))
    elif more is not True:
        raise ValueError(f"{path}: schemas of additional members aren't known")
    return out


def _text(value: Column, at: str) -> Column:
    return F.try_variant_get(value, at, "string")


def _number(value: Column, at: str) -> Column:
    return F.try_variant_get(value, at, "double")


def _length(value: Column, at: str) -> Column:
    return F.size(F.try_variant_get(value, at, "array<variant>"))


def _one_of(value: Column, at: str, of: list) -> Column:
    return ~_text(value, at).isin([v if isinstance(v, str) else json.dumps(v) for v in of])


#: rule: whether a value (a variant, the path in it) fails it.
_RULES: dict[str, Callable[[Column, str, Any], Column]] = {
    "minimum": lambda v, at, x: _number(v, at) < x, "maximum": lambda v, at, x: _number(v, at) > x,
    "exclusiveMinimum": lambda v, at, x: _number(v, at) <= x, "exclusiveMaximum": lambda v, at, x: _number(v, at) >= x,
    "minLength": lambda v, at, x: F.length(_text(v, at)) < x, "maxLength": lambda v, at, x: F.length(_text(v, at)) > x,
    "minItems": lambda v, at, x: _length(v, at) < x, "maxItems": lambda v, at, x: _length(v, at) > x,
    "pattern": lambda v, at, x: ~_text(v, at).rlike(x), "enum": _one_of, "const": lambda v, at, x: _one_of(v, at, [x]),
}


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and no blanks; what isn't JSON becomes a JSON string."""
    as_string = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("s")))
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.substring(as_string, F.lit(6), F.length(as_string) - 6))


ID = ["conv_id", "call_id"]


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and level of every call: the length of the longest chain before it, null in or behind a cycle."""
    edges = calls.select(*ID, F.explode(F.array_distinct("after")).alias("before"))
    edges = stage(edges.join(calls.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"], "left_semi").select(*ID, "before"), "edges")
    needs = edges.groupBy(*ID).agg(F.count("*").alias("n"), F.min("before").alias("to"))
    mark = staged_so_far()
    jump, round_, moving, most = stage(needs.where("n = 1").select(*ID, "to", F.lit(1).cast("long").alias("d")), "jumps"), 0, 1, 1
    while moving and round_ <= most:  # a cycle never comes to rest
        on = jump.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"))
        found = jump.join(on, ["conv_id", "to"], "left")
        jump = stage(found.select(*ID, F.coalesce("next", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("next").isNotNull().alias("moved")), "jumps")
        release(mark, jump)
        n, moving = jump.agg(F.count("*"), F.count_if("moved")).first()
        most, round_, jump = max(1, n).bit_length(), round_ + 1, jump.where("NOT moved" if not moving or round_ > most else "true")
    # what every call leads to without a choice: a first call or one with several dependencies, and how far it is
    rest = calls.select(*ID).join(needs.where("n = 1"), ID, "left_anti").select(*ID, F.col("call_id").alias("to"), F.lit(0).cast("long").alias("d"))
    leads = jump.select(*ID, "to", "d").unionByName(rest)
    known = rest.join(needs, ID, "left_anti").select(*ID, F.lit(0).cast("long").alias("level"))
    several = needs.where("n > 1").select(*ID)
    if not several.isEmpty():
        end = leads.select("conv_id", F.col("call_id").alias("before"), F.col("to").alias("end"), "d")
        paths = stage(edges.join(several, ID, "left_semi").join(end, ["conv_id", "before"], "left").select(*ID, "end", (F.col("d") + 1).alias("d")), "paths")
        known = stage(known, "known")
        while True:
            done = known.select("conv_id", F.col("call_id").alias("end"), "level")
            met = paths.join(done, ["conv_id", "end"], "left").groupBy(*ID).agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.col("level") + F.col("d")).alias("level"))
            more = stage(met.where("open = 0").select(*ID, "level").join(known, ID, "left_anti"), "known")
            if more.isEmpty():
                break
            known = stage(known.unionByName(more), "known")
    ends = known.select("conv_id", F.col("call_id").alias("to"), "level")
    placed = leads.join(ends, ["conv_id", "to"], "left").select(*ID, (F.col("level") + F.col("d")).alias("level"))
    return calls.select(*ID).join(placed, ID, "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, level, position, status, valid, errors and json of every call, and of every orphan result."""
    least = lambda *cols: F.min(F.struct(F.col(cols[-1]).isNull().alias("_none"), cols[-1], *cols[:-1]))
    first = lambda df, *cols: df.groupBy("conv_id", "call_id").agg(least(*cols).alias("x")).select("conv_id", "call_id", "x.*").drop("_none")
    can = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    made = stage(first(calls.where(can), "name", "arguments", "after", "position"), "calls")
    got = first(results.where(can).withColumnRenamed("position", "answered"), "content", "answered")
    both = made.join(got.hint("shuffle_hash"), ["conv_id", "call_id"], "full").join(levels(made), ["conv_id", "call_id"], "left")
    alone = calls.where(~can).select(*CALLS).unionByName(results.where(~can).select("conv_id", "call_id", "content", F.col("position").alias("answered")), allowMissingColumns=True)
    both = both.unionByName(alone, allowMissingColumns=True)
    args = F.try_parse_json("arguments")
    wrong = F.array(F.when(F.col("name").isNotNull() & args.isNull(), "$: not JSON"), F.when(F.col("name").isNotNull() & ~F.col("name").isin(list(schemas)), "no such tool"))
    for name, schema in schemas.items():
        rules = F.array(*schema_errors(args, schema))
        wrong = F.when(F.col("name") == name, F.concat(wrong, rules)).otherwise(wrong)
    status = F.when(F.col("name").isNull(), "orphan").when(F.col("answered").isNull(), "no_result").otherwise("linked")
    rest = F.to_json(F.struct(F.col("call_id").alias("id"), "name", F.col("content").alias("result")))
    json = F.concat(F.lit("{"), F.when(F.col("name").isNotNull(), F.concat(F.lit('"arguments":'), canonical(F.col("arguments")), F.when(rest == "{}", "").otherwise(","))).otherwise(""), F.substring(rest, F.lit(2), F.length(rest)))
    d = both.withColumn("errors", F.array_compact(wrong))
    return d.select("conv_id", "call_id", "level", F.coalesce("position", "answered").alias("position"), status.alias("status"), ((F.size("errors") == 0) & F.col("name").isNotNull()).alias("valid"), "errors", json.alias("json"))


#: Schemas of the calls that plain conversations stand for.
CONVERSATION_TOOLS = {
    "reply": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 500, "pattern": r"(?s)^(?!.*\S{21})", "anyOf": [{"pattern": r"\?\s*$"}, {"maxLength": 300}]}, "turn": {"type": ["integer", "null"], "minimum": 0}},
    },
    "set_context": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer", "maximum": 0}}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that a plain conversation stands for.

    A user turn calls ``reply``, a system turn ``set_context``; the id is conversation:turn. An assistant turn is the result of the turn before it. Every second call waits for one that is
    made after it: of four turns, the call of the first two waits for the one two turns on, the other for the one six
    turns back, if there is such a call.
    """
    ident = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    ident_or_null = lambda back: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), ident(back))
    text = F.coalesce("text", F.lit(""))
    back = F.when(F.pmod("turn", F.lit(4)) < 2, -2).otherwise(6)
    calls = turns.where(F.col("role").isNull() | (F.col("role") != "assistant")).select(
        "conv_id", ident_or_null(0).alias("call_id"), F.when(F.col("role") == "system", "set_context").otherwise("reply").alias("name"),
        F.to_json(F.struct("turn", text.alias("prompt"))).alias("arguments"), F.col("turn").alias("position"), F.array_compact(F.array(ident_or_null(back))).alias("after"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", ident_or_null(1).alias("call_id"), text.alias("content"), F.col("turn").alias("position"))
    return calls, results


def op1(turns: DataFrame) -> DataFrame:
    found = link(*conversation_calls(turns), CONVERSATION_TOOLS)
    return found.withColumn("errors", F.array_join("errors", "; "))
