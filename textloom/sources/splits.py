"""Numbered lines of large files: byte ranges are read by tasks of their own, and a prefix sum of their line counts
makes the numbers global.

Two passes over the files. The first adds up, for each byte range, rows, lines and bytes; ranges of a file are as many
as its size over the split size, and a running sum over them gives each range's first number. The second numbers the
lines of each range from 1 as they stream by, and adds what lies before. Both passes are parts of one query and take the
same splits; a range that only one of them knows is an error, never a wrong number.

Lines are those of the whole text: CRLF, LF and bare CR end one, a byte order mark is no part of the first, and a text
that ends with a line end has a last empty line. An empty file has no row.

A file may also be a folder of parts, as Spark's writers leave it: parts follow each other by the number in their names,
each but the last ends with a line end, and a mark at the start of a part that isn't the first is text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


MARK = "\ufeff"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """path, begin (of the byte range), size (of the file) and value: what stands between LFs (Spark takes a mark away)."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.col("_metadata.file_size").alias("size"), "value")


def _ranges(rows: DataFrame, parts: bool = False) -> DataFrame:
    """path, begin, whole (the file, or the folder of its parts), before (lines of the whole before the range), all (its
    lines), open (an empty line ends it) and mark (text that the reader took for a part's mark)."""
    cr = F.endswith("value", F.lit("\r"))
    lines = 1 + F.length("value") - F.length(F.replace("value", F.lit("\r"), F.lit(""))) - cr.cast("int")
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    each = rows.groupBy("path", "begin", "size").agg(F.sum(lines).alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.max_by(cr, "at").alias("cr"))
    part = F.regexp_extract("path", "/part-([0-9]+)[^/]*$", 1).cast("long") if parts else F.lit(0)
    each = each.withColumns({"whole": F.regexp_replace("path", "/[^/]*$", "") if parts else F.col("path"), "place": F.struct(part.alias("part"), "begin")})
    # each value stands for itself and an LF; one LF less than that, and the last line has none (a mark has 3 bytes)
    each = each.withColumn("left", F.col("size") - F.sum("bytes").over(Window.partitionBy("path")))
    whole = Window.partitionBy("whole")
    upto = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ended = ~F.col("left").isin(-1, 2) | F.col("cr")
    taken = (F.col("begin") == 0) & F.col("left").isin(2, 3) & (F.col("place") > F.min("place").over(whole))
    return each.select(
        "path", "begin", "whole", F.coalesce(F.sum("lines").over(upto), F.lit(0)).alias("before"), F.sum("lines").over(whole).alias("all"),
        F.max_by(ended, "place").over(whole).alias("open"), F.when(taken, MARK).otherwise("").alias("mark"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, n = None, 0
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for path, begin, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (path, begin) != place:
                place, n = (path, begin), 0
            for line in value.removesuffix("\r").split("\r"):
                n += 1
                for column, x in zip(out, (path, begin, n, line), strict=True):
                    column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "begin", "own", "text"])


def numbered_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """path, line_no (long) and text of every line of the text files at ``path``; with ``parts`` a folder's files are one,
    and path is the folder. Ranges, a row for each split, are broadcast, so that lines stay where they are read."""
    rows = _rows(spark, path)
    ranges = _ranges(rows, parts)
    own = rows.select("path", "begin", "value").mapInArrow(_numbered, "path string, begin long, own long, text string")
    known = F.when(F.col("before").isNull(), F.raise_error(F.lit("the files' splits have changed"))).otherwise(F.col("before"))
    first = F.col("own") == 1
    found = own.join(F.broadcast(ranges.select("path", "begin", "whole", "before", "mark")), ["path", "begin"], "left")
    found = found.select(F.col("whole").alias("path"), (known + F.col("own")).alias("line_no"), F.when(first, F.concat("mark", "text")).otherwise(F.col("text")).alias("text"))
    ends = ranges.where("open").select(F.col("whole").alias("path"), (F.col("all") + 1).alias("line_no"), F.lit("").alias("text")).distinct()
    return found.union(ends)
