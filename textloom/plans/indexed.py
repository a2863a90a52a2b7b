"""Searches through a trigram index of ``documents``, and SQL: the same rows as scans, and how many blocks are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines, trigrams
from ..sources import work
from ..sources.tables import table
from . import oracles

BLOCKS = 64
WORD, RARE, EITHER = "[Tt]ion", "Licensed under", "licensed under|token = |copyright"
PROBES = {"rare": RARE, "cue": 'token = "', "absent": "no such words here", "common": "the"}


def _index(spark: SparkSession, folder: str) -> str:
    path = work.folder(spark, "trigrams")
    docs = lines.normalised(table(spark, folder, "documents")).select("doc_id", "text")
    trigrams.build(docs, path, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(BLOCKS)))
    return path


def grep_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return trigrams.grep(spark, _index(spark, folder), WORD).select("doc_id", "line_no", "text")


def grep_indexed_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    return trigrams.grep(spark, _index(spark, folder), EITHER, ignore_case=True).select("doc_id", "line_no", "text")


def index_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """How many blocks a search for each probe reads."""
    path = _index(spark, folder)
    count = lambda found: BLOCKS if found is None else len(found)
    rows = [(name, count(trigrams.blocks(spark, path, probe, literal=True))) for name, probe in PROBES.items()]
    return spark.createDataFrame(rows, "probe string, blocks_read int")


def _blocks_sql() -> str:
    wanted = [(name, x) for name, probe in PROBES.items() for x in sorted(trigrams.trigrams_in(trigrams.condition(probe, literal=True)))]
    rows = ", ".join(f"('{name}', '{x}')" for name, x in wanted)
    return f"""WITH w(probe, trigram) AS (VALUES {rows}),
b AS (SELECT doc_id % {BLOCKS} AS block, string_agg(lower(text), chr(10)) AS text FROM documents GROUP BY 1),
h AS (SELECT probe, block FROM w JOIN b ON contains(b.text, trigram) GROUP BY probe, block HAVING count(*) = (SELECT count(*) FROM w v WHERE v.probe = w.probe))
SELECT probe, count(block)::INT AS blocks_read FROM (SELECT DISTINCT probe FROM w) LEFT JOIN h USING (probe) GROUP BY probe"""


def queries() -> dict[str, object]:
    return {f.__name__: f for f in (grep_indexed, grep_indexed_alternatives, index_blocks)}


def oracle_sql() -> dict[str, str]:
    return {
        "grep_indexed": oracles.SQL["grep_regex"],
        "grep_indexed_alternatives": oracles.SQL["grep_literal_ci"].partition("WHERE contains")[0] + "WHERE regexp_matches(lower(text), 'licensed under|token = |copyright')",
        "index_blocks": _blocks_sql(),
    }
