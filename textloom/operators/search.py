"""Corpus search: matches by line, context, caps, limits and summaries. Each document is searched as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Over CAP_FROM matches in all, a document shows CAP; and the default limit.
CAP_FROM, CAP, LIMIT = 50, 10, 100


def matcher(pattern: str, *, literal: bool = False, ignore_case: bool = False):  # noqa: ANN201
    """A function from a text column to whether it matches."""
    if literal and not ignore_case:
        return lambda c: F.contains(c, F.lit(pattern))
    p = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E" if literal else pattern
    return lambda c: c.rlike(("(?iu)" if ignore_case else "") + p)


def hits(docs: DataFrame, pattern: str, key: str = "doc_id", **how: bool) -> DataFrame:
    """key, parts (the lines) and hits (numbers of the matching ones) of canonical documents that have a match."""
    test = matcher(pattern, **how)
    d = docs.select(key, T.line_array("text").alias("parts"))
    numbers = F.filter(F.transform("parts", lambda x, i: F.when(test(x), i + 1)), lambda n: n.isNotNull())
    return d.withColumn("hits", numbers).where(F.size("hits") > 0)


def grep(docs: DataFrame, pattern: str, *, key: str = "doc_id", context: int = 0, cap: bool = False, **how: bool) -> DataFrame:
    """key, line_no, kind (match or context), gap (lines are left out before this one) and text.

    cap: with more than CAP_FROM matches in all documents, a document's lines end before its match after the CAPth.
    """
    d = hits(docs, pattern, key, **how)
    around = F.flatten(F.transform("hits", lambda h: F.sequence(F.greatest(h - context, F.lit(1)), F.least(h + context, F.size("parts")))))
    d = d.withColumn("shown", F.array_sort(F.array_distinct(around)) if context else F.col("hits"))
    if cap:
        total = hits(docs, pattern, key, **how).agg(F.sum(F.size("hits"))).scalar()
        stop = F.get("hits", F.lit(CAP))
        d = d.withColumn("shown", F.when((total > CAP_FROM) & stop.isNotNull(), F.filter("shown", lambda n: n < stop)).otherwise(F.col("shown")))
    # rows are made of single lines within the document's row, so no row carries the document
    kind = (lambda n: F.when(F.array_contains("hits", n), "match").otherwise("context")) if context else lambda n: F.lit("match")
    gap = lambda n, i: F.coalesce((i > 0) & (n > F.get("shown", i - 1) + 1), F.lit(False))
    line = lambda n, i: F.struct(n.alias("line_no"), kind(n).alias("kind"), gap(n, i).alias("gap"), F.get("parts", n - 1).alias("text"))
    return d.select(key, F.inline(F.transform("shown", line)))


def more_matches(docs: DataFrame, pattern: str, key: str = "doc_id", **how: bool) -> DataFrame:
    """key and how many of its matches the cap leaves out, where any."""
    d = hits(docs, pattern, key, **how)
    total = hits(docs, pattern, key, **how).agg(F.sum(F.size("hits"))).scalar()
    return d.where((total > CAP_FROM) & (F.size("hits") > CAP)).select(key, (F.size("hits") - CAP).alias("more"))


def summary(docs: DataFrame, pattern: str, key: str = "doc_id", **how: bool) -> DataFrame:
    """key, matches, most first; documents in order among equals."""
    return hits(docs, pattern, key, **how).select(key, F.size("hits").cast("long").alias("matches")).orderBy(F.desc("matches"), key)


def first_matches(docs: DataFrame, pattern: str, limit: int = LIMIT, key: str = "doc_id", **how: bool) -> DataFrame:
    """The first ``limit`` matches in document and line order (a top-k: each task keeps that many)."""
    # of a document no more than ``limit`` can be among the first
    line = lambda n: F.struct(n.alias("line_no"), F.get("parts", n - 1).alias("text"))
    return hits(docs, pattern, key, **how).select(key, F.inline(F.transform(F.slice("hits", 1, limit), line))).orderBy(key, "line_no").limit(limit)


def limit_notice(docs: DataFrame, pattern: str, limit: int = LIMIT, **how: bool) -> DataFrame:
    """One row: matches in all, and a notice where ``first_matches`` leaves some out, else null."""
    found = hits(docs, pattern, **how).agg(F.coalesce(F.sum(F.size("hits")), F.lit(0)).cast("long").alias("matches"))
    return found.select("matches", F.when(F.col("matches") > limit, F.lit(f"[{limit} matches are shown; narrow the pattern or raise the limit for more]")).alias("notice"))


def text_only(docs: DataFrame) -> DataFrame:
    """Documents (as of ``lines.normalised``) that are searched: binary ones are not."""
    return docs.where(~F.col("is_binary"))


def binary_warnings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and a warning for each document that a search passes over as binary."""
    return docs.where("is_binary").select(key, F.concat(F.lit("[Warning: "), F.col(key).cast("string"), F.lit(" holds binary content and is not searched]")).alias("warning"))


def block(path: Column, matches: Column, body: Column) -> Column:
    return F.concat(F.format_string("--- %s (%d matches) ---\n", path, matches), body)


def rendered(found: DataFrame, more: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key and the block of text of each document, from ``grep`` with hashes (columns hash, text)."""
    mark = F.when(F.col("kind") == "match", ">>").otherwise("  ")
    line = F.concat(F.when(F.col("gap"), "--\n").otherwise(""), F.col(key).cast("string"), F.lit(":"), mark, F.col("line_no").cast("string"), F.lit(":"), "hash", F.lit("|"), "text")
    d = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("t")))).alias("x"), F.count_if(F.col("kind") == "match").alias("matches"))
    body = F.array_join(F.transform("x", lambda x: x["t"]), "\n")
    if more is not None:
        d = d.join(more, key, "left")
        body = F.concat(body, F.when(F.col("more").isNotNull(), F.format_string("\n... +%d more matches", "more")).otherwise(""))
        return d.select(key, block(F.col(key).cast("string"), F.col("matches") + F.coalesce("more", F.lit(0)), body).alias("block"))
    return d.select(key, block(F.col(key).cast("string"), F.col("matches"), body).alias("block"))
