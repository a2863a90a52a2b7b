"""Anchors against lines: verification, relocation within a window, and similar lines nearby."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: How far an anchor may have moved; where, how like and how many similar lines are looked for.
MOVED, NEAR, LEAST, SHOWN = 20, 50, 0.3, 3


def verified(anchors: DataFrame, lines: DataFrame, key: str = "doc_id", mark: str = "hash") -> DataFrame:
    """``anchors`` (key, line_no, mark, ...) with status: ok, changed (the line's mark differs) or missing."""
    there = lines.select(key, "line_no", F.col(mark).alias("_found"))
    d = anchors.join(there, [key, "line_no"], "left")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") == F.col(mark), "ok").otherwise("changed")
    return d.withColumn("status", status).drop("_found")


def relocated(anchors: DataFrame, lines: DataFrame, key: str = "doc_id", mark: str = "hash", window: int = MOVED) -> DataFrame:
    """key, line_no, mark, candidates and new_line: where exactly one line within ``window`` has the mark.

    Anchors and lines of one mark are looked at side by side in the order of their numbers, so a mark that thousands of
    lines share (blank ones) costs each anchor its neighbours only.
    """
    both = anchors.select(key, "line_no", mark).distinct().withColumn("_at", F.lit(None).cast("int"))
    both = both.unionByName(lines.select(key, "line_no", mark, F.col("line_no").alias("_at")))
    near = Window.partitionBy(key, mark).orderBy("line_no").rangeBetween(-window, window)
    d = both.withColumn("candidates", F.count("_at").over(near)).withColumn("_first", F.min("_at").over(near)).where("_at IS NULL")
    return d.select(key, "line_no", mark, "candidates", F.when(F.col("candidates") == 1, F.col("_first")).alias("new_line"))


def similar(expected: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, found_line, score, text and rank of the lines most like ``expected`` (key, line_no, content).

    A document meets its anchors once; its lines are split into tokens once, and an anchor sees NEAR lines on either side.
    """
    kind = docs.schema[key].dataType.simpleString()
    asked = expected.groupBy(key).agg(F.collect_list(F.struct(F.col("line_no").cast("int").alias("n"), F.coalesce("content", F.lit("")).alias("c"))).alias("asked"))
    d = docs.select(key, "text").join(asked, key)
    ddl = f"`{key}` {kind}, line_no int, found_line int, score double, text string, rank int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, (text, asked) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                parts = text.split("\n")
                sets = [T.tokens(x) for x in parts]
                for a in asked:
                    found = _most_alike(T.tokens(a["c"]) or frozenset([""]), sets, a["n"])
                    rows += [(a["n"], at, score, parts[at - 1], rank) for rank, (score, at) in enumerate(found, 1)]
                    keys += [i] * len(found)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, "line_no", "found_line", "score", "text", "rank"])

    return d.mapInArrow(run, ddl)


def _most_alike(wanted: frozenset[str], sets: list[frozenset[str]], line_no: int) -> list[tuple[float, int]]:
    """(score, line) of the SHOWN lines within NEAR of ``line_no`` that share the most tokens; the first of equals."""
    scored = []
    for at in range(max(line_no - NEAR, 1), min(len(sets), line_no + NEAR) + 1):
        there = sets[at - 1]
        if there and (score := len(wanted & there) / max(len(wanted), len(there))) >= LEAST:
            scored.append((-score, at))
    return [(-score, at) for score, at in sorted(scored)[:SHOWN]]
