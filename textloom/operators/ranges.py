"""Line ranges: merging, and the lines they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, key: str = "doc_id", gap: int = 1) -> DataFrame:
    """key, start_line, end_line: ranges that overlap, touch, or leave at most ``gap`` lines between them are one."""
    w = Window.partitionBy(key).orderBy("start_line", "end_line")
    reach = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start_line") > reach + gap + 1), 1).otherwise(0)
    d = ranges.select(key, "start_line", "end_line", fresh.alias("fresh"))
    d = d.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def expanded(ranges: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start_line, line_no, text of every line of the ranges; a line the document lacks is empty.

    Ranges meet their document once, and lines are taken from its array: no join by line, no nested loop.
    """
    d = ranges.join(docs.select(key, F.split("text", "\n", -1).alias("parts")), key)
    line = lambda n: F.struct(n.alias("line_no"), F.coalesce(F.get("parts", n - 1), F.lit("")).alias("text"))
    return d.select(key, "start_line", F.inline(F.transform(F.sequence("start_line", "end_line"), line)))
