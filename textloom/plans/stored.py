"""Queries over text files that are written from ``documents`` first and over JSON texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import spread
from ..operators import schemas
from ..sources import splits, work
from ..sources.tables import table

FILES = 16
#: Bytes of text that a task writes.
PART_BYTES = 32 << 20


def lines_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents one below the other in 16 files, and the files' lines, numbered by byte ranges.

    A file is a folder of parts by ranges of ids, so that tasks write as much of it each, however large it is.
    """
    path = work.folder(spark, "texts")
    docs = table(spark, folder, "documents").select("doc_id", F.pmod("doc_id", F.lit(FILES)).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    docs.repartitionByRange(parts, "file", "doc_id").sortWithinPartitions("file", "doc_id").select("file", "text").write.partitionBy("file").text(path)
    found = splits.numbered_lines(spark, path, parts=True)
    return found.select(F.regexp_extract("path", "file=([0-9]+)$", 1).cast("long").alias("file"), "line_no", "text")


def json_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The schema of the clicks' properties by kind of click, down to four steps."""
    docs = spread(table(spark, folder, "clicks").select("kind", "props"))
    return schemas.schema(schemas.state(docs, "props", "kind"), "kind").select("kind", "path", "types", "n", "optional")


SQL = {
    "json_schema": """WITH d AS (SELECT kind, props AS text FROM clicks WHERE props IS NOT NULL),
v AS (SELECT kind, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, CASE WHEN t.type IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(t.type) WHEN t.type = 'VARCHAR' THEN 'string' ELSE 'number' END AS type
  FROM d, json_tree(CASE WHEN json_valid(text) THEN text END) t UNION ALL SELECT kind, '$', 'invalid' FROM d WHERE NOT json_valid(text)),
p AS (SELECT *, regexp_replace(path, '(\\.[^.\\[\\]]*|\\[\\])$', '') AS parent FROM v WHERE len(regexp_extract_all(path, '\\.|\\[')) <= 4),
o AS (SELECT kind, path AS parent, count(*) AS objects FROM p WHERE type = 'object' GROUP BY ALL)
SELECT p.kind, p.path, string_agg(DISTINCT type, '|' ORDER BY type) AS types, count(*) AS n, coalesce(NOT ends_with(p.path, '[]') AND max(objects) > count(*), false) AS optional
FROM p LEFT JOIN o ON o.kind IS NOT DISTINCT FROM p.kind AND o.parent = p.parent AND p.path <> '$' GROUP BY p.kind, p.path""",
    "lines_of_files": f"""WITH t AS (SELECT doc_id % {FILES} AS file, doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS p FROM documents))
SELECT file, row_number() OVER (PARTITION BY file ORDER BY doc_id, i) AS line_no, text FROM t
UNION ALL SELECT file, count(*) + 1, '' FROM t GROUP BY file"""
}


def queries() -> dict[str, object]:
    return {"lines_of_files": lines_of_files, "json_schema": json_schema}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
