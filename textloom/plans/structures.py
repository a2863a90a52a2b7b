"""Queries of structural search over ``pages``, and SQL for patterns of fixed depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges, structural
from ..sources.tables import table

LINKS, REPEATED, ENTRIES = '<li><a href="$H">$T</a></li>', "<article><h1>$A</h1><p><b>$A$$$MORE</b></p></article>", "<li>$$$</li>"


def _split_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a line end between neighbouring tags."""
    return table(spark, folder, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("html"))


def structural_links(spark: SparkSession, folder: str) -> DataFrame:
    """List entries that hold a link only: their targets and labels, counted through the page."""
    found = structural.matches(structural.trees(table(spark, folder, "pages")), LINKS)
    return found.select("page_id", F.col("bound")["H"].alias("target"), F.col("bound")["T"].alias("label")).groupBy("page_id", "target", "label").agg(F.count("*").alias("n"))


def structural_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Articles whose first bold words repeat the heading: one metavariable in two places."""
    found = structural.matches(structural.trees(table(spark, folder, "pages")), REPEATED)
    return found.select("page_id", F.col("bound")["A"].alias("heading"), (F.length(F.col("bound")["MORE"]) > 0).alias("more"))


def structural_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Line ranges of list entries, merged."""
    found = structural.matches(structural.trees(_split_tags(spark, folder)), ENTRIES)
    return ranges.merged(found.select("page_id", "start_line", "end_line"), "page_id")


def structural_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of those ranges."""
    pages = _split_tags(spark, folder).withColumnRenamed("html", "text")
    return ranges.expanded(structural_ranges(spark, folder), pages, "page_id").select("page_id", "start_line", "line_no", "text")


_LINK = r"""'<li>\s*<a href="([^"]*)">\s*([^<\s](?:[^<]*[^<\s])?)\s*</a>\s*</li>'"""
_RANGES = r"""
l AS (
  SELECT page_id, generate_subscripts(t, 1) AS line_no, unnest(t) AS text FROM (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS t FROM pages)
),
b AS (SELECT page_id, line_no AS start_line, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(text, '<li>')),
e AS (SELECT page_id, line_no AS end_line, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(text, '</li>')),
r AS (SELECT page_id, start_line, end_line FROM b JOIN e USING (page_id, k)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY start_line) AS island FROM (
  SELECT *, CASE WHEN start_line <= lag(end_line) OVER (PARTITION BY page_id ORDER BY start_line) + 2 THEN 0 ELSE 1 END AS fresh FROM r)),
m AS (SELECT page_id, min(start_line)::INT AS start_line, max(end_line)::INT AS end_line FROM i GROUP BY page_id, island)
"""
SQL = {
    "structural_links": f"""SELECT page_id, target, label, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(html, {_LINK}, 1)) AS target, unnest(regexp_extract_all(html, {_LINK}, 2)) AS label FROM pages) GROUP BY page_id, target, label""",
    "structural_repeated": """SELECT page_id, heading, true AS more FROM (
  SELECT page_id, regexp_extract(html, '<article><h1>([^<]*)</h1><p><b>[^<]*<', 1) AS heading, regexp_extract(html, '<article><h1>[^<]*</h1><p><b>([^<]*)<', 1) AS said FROM pages) WHERE heading <> '' AND heading = said""",
    "structural_ranges": f"WITH {_RANGES} SELECT * FROM m",
    "structural_lines": f"WITH {_RANGES} SELECT page_id, start_line, line_no::INT AS line_no, text FROM m JOIN l USING (page_id) WHERE line_no BETWEEN start_line AND end_line",
}


def queries() -> dict[str, object]:
    return {f.__name__: f for f in (structural_links, structural_repeated, structural_ranges, structural_lines)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
