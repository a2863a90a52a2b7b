"""Schemas of JSON documents as counts that add up: types by path, how often each, and which members are optional.

A document's values are exploded level by level (an array's elements share the path ``[]``), so a state is a plain sum
by (group, path, type): tasks add up what they see, and states of different days or files are merged by adding again.
All levels are explosions of one scan, in which each value stays beside its members, so a text is parsed once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("path", "parent", "type", "n")
NONE = "array<struct<path:string,parent:string,step:int,v:variant,type:string>>"
#: Type names by what a variant's schema starts with.
TYPES = (("OBJECT", "object"), ("ARRAY", "array"), ("STRING", "string"), ("BOOLEAN", "boolean"), ("VOID", "null"))


def _type(value: Column) -> Column:
    """The type's name; the value's schema is made once, as it walks the whole value."""
    known = F.create_map(*(F.lit(x) for pair in TYPES for x in pair))
    named = F.try_element_at(known, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))
    return F.when(value.isNull(), "invalid").otherwise(F.coalesce(named, F.lit("number")))


def state(docs: DataFrame, text: str, *group: str, depth: int = 4) -> DataFrame:
    """group, path, parent (of the path), type and n over documents (JSON text), down to ``depth`` steps from the root.

    A null text is no document; text that isn't JSON counts as type ``invalid`` at the root.
    """
    parsed = docs.where(F.col(text).isNotNull()).select(*group, F.try_parse_json(text).alias("v"))
    root = parsed.select(*group, F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("step"), "v")
    seen = root.withColumn("type", _type(F.col("v")))
    for step in range(depth):
        own = F.array(F.struct("path", "parent", "step", F.lit(None).cast("variant").alias("v"), "type"))
        value = lambda path, v, at=step + 1: F.struct(path.alias("path"), F.col("path").alias("parent"), F.lit(at).alias("step"), v.alias("v"), _type(v).alias("type"))
        members = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: value(F.concat("path", F.lit("."), e["key"]), e["value"]))  # noqa: B023
        elements = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda v: value(F.concat("path", F.lit("[]")), v))  # noqa: B023
        inner = F.when(F.col("step") == step, F.when(F.col("type") == "object", members).when(F.col("type") == "array", elements))
        # what is not of this step passes by with its value; what is, has given it to its members
        kept = F.when(F.col("step") == step, own).otherwise(F.array(F.struct("path", "parent", "step", "v", "type")))
        seen = seen.select(*group, F.inline(F.concat(kept, F.coalesce(inner, F.array().cast(NONE)))))
    return seen.groupBy(*group, "path", "parent", "type").agg(F.count("*").alias("n"))


def merged(states: list[DataFrame], *group: str) -> DataFrame:
    return reduce(DataFrame.unionByName, states).groupBy(*group, "path", "parent", "type").agg(F.sum("n").alias("n"))


def schema(found: DataFrame, *group: str) -> DataFrame:
    """group, path, types (joined by |), n, and whether an object at the parent's path may lack the member."""
    objects = F.sum(F.when(F.col("type") == "object", F.col("n")))
    paths = found.groupBy(*group, "path", "parent").agg(F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"), F.sum("n").alias("n"), objects.alias("_objects"))
    # not a filter on the type: it would go down to the documents, and they would be read a second time for it
    objects = paths.where("_objects > 0").select(*(F.col(g).alias(f"_{g}") for g in group), F.col("path").alias("_path"), "_objects")
    paths = paths.drop("_objects")
    same = F.col("parent") == F.col("_path")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    lacks = ~F.endswith("path", F.lit("[]")) & (F.coalesce("_objects", F.lit(0)) > F.col("n"))
    return paths.join(objects, same, "left").select(*group, "path", "types", "n", F.coalesce(lacks, F.lit(False)).alias("optional"))
