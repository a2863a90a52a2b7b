"""Symbol lookup by name: tiers of ever looser matching, of which the first with a hit decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Tiers in order, and how many candidates an ambiguous lookup names.
TIERS = ("name@line", "exact", "path", "case-insensitive", "prefix", "word", "substring")
SHOWN = 5
#: Queries in one automaton; more queries take more passes over the distinct names.
AT_ONCE = 100_000


def matches(symbols: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """All hits of the deciding tier: query, key, tier, rank (in pre-order), hits, and the symbol's columns.

    symbols: key, sym_id, path, name, start_line, ...; queries: query, looked up in every document. Lines and paths are
    looked up by joins on equality. All other tiers hold the query within the name: an automaton of all queries goes
    over the distinct names once, and what it finds is joined back by name, so work follows names and hits, not their
    product with the queries.
    """
    q = queries.select("query", T.trimmed("query").alias("_q")).where(F.col("_q") != "").distinct()
    q = q.select("query", "_q", F.lower("_q").alias("_low"), F.split("_q", "@").alias("_at"), F.transform(F.split("_q", r"\."), lambda x: T.trimmed(x)).alias("_dots"))
    columns = symbols.columns
    s = symbols.withColumn("_name", F.lower("name"))

    number = F.get("_at", F.lit(1))
    lined = q.where((F.size("_at") == 2) & (F.get("_at", F.lit(0)) != "") & number.rlike("^[0-9]+$")).select("query", F.get("_at", F.lit(0)).alias("_of"), F.ltrim(number, F.lit("0")).alias("_line"))
    by_line = symbols.join(lined, (F.col("name") == F.col("_of")) & (F.col("start_line").cast("string") == F.col("_line"))).select("query", *columns, F.lit(1).alias("tier"))
    pathed = q.where((F.size("_dots") >= 2) & ~F.array_contains("_dots", "")).select("query", F.to_json("_dots").alias("_of"))
    by_path = symbols.join(pathed, F.to_json("path") == F.col("_of")).select("query", *columns, F.lit(3).alias("tier"))

    held = _held(s.select("_name").distinct(), q.select("_low").distinct())
    d = s.join(held, "_name").join(q.select("query", "_q", "_low"), "_low")
    words = F.split(F.lower(F.regexp_replace("name", "([a-z])([A-Z])", "$1 $2")), r"[\s_]+")
    tier = (
        F.when(F.col("name") == F.col("_q"), 2).when(F.col("_name") == F.col("_low"), 4).when(F.startswith("_name", F.col("_low")), 5)
        .when(F.array_contains(words, F.col("_low")), 6).otherwise(7)
    )
    d = d.select("query", *columns, tier.alias("tier")).union(by_line).union(by_path)
    per = Window.partitionBy("query", key)
    d = d.withColumn("_best", F.min("tier").over(per)).where("tier = _best")
    return d.withColumn("hits", F.count("*").over(per)).withColumn("rank", F.row_number().over(per.orderBy("sym_id"))).drop("_best")


def _held(names: DataFrame, asked: DataFrame) -> DataFrame:
    """_name and each _low that it holds. An automaton has AT_ONCE queries at most, which bounds what is sent to tasks."""
    spark = names.sparkSession
    rows = (r[0] for r in asked.toLocalIterator())
    passes = []
    while part := list(islice(rows, AT_ONCE)):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in sent.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                found = [(name, low) for name in batch.column(0).to_pylist() if name for low in {x for _, x in automaton.iter(name)}]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], names=["_name", "_low"])

        passes.append(names.mapInArrow(run, "_name string, _low string"))
    return reduce(DataFrame.union, passes) if passes else spark.createDataFrame([], "_name string, _low string")


def lookup(symbols: DataFrame, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """query, key, status (found, ambiguous), tier, hits and the first candidates (name, start_line, end_line)."""
    d = matches(symbols, queries, key).where(F.col("rank") <= SHOWN)
    d = d.groupBy("query", key).agg(F.first("tier").alias("tier"), F.first("hits").alias("hits"), F.array_sort(F.collect_list(F.struct("rank", "name", "start_line", "end_line"))).alias("c"))
    tiers = F.array(*(F.lit(t) for t in TIERS))
    shown = F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line")))
    return d.select("query", key, F.when(F.col("hits") == 1, "found").otherwise("ambiguous").alias("status"), F.get(tiers, F.col("tier") - 1).alias("tier"), "hits", shown.alias("candidates"))


def sliced(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, query, line_no, text of the lines of each found symbol, cut to the document."""
    one = found.where("status = 'found'").select(key, "query", F.get("candidates", F.lit(0)).alias("s"))
    d = one.join(docs.select(key, T.line_array("text").alias("parts")), key)
    first = F.greatest(F.col("s.start_line"), F.lit(1))
    span = F.slice("parts", first, F.greatest(F.least(F.col("s.end_line"), F.size("parts")) - first + 1, F.lit(0)))
    return d.select(key, "query", F.posexplode(span).alias("i", "text"), first.alias("first")).select(key, "query", (F.col("first") + F.col("i")).alias("line_no"), "text")
