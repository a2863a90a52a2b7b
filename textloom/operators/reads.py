"""Requests to read parts of documents: which parameters exclude one another, what range is meant, whether a map follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import MOST_BYTES, MOST_LINES, head_lines

REQUEST = "start int, most int, symbol string, map boolean"


def conflict(start: Column, most: Column, symbol: Column, map_: Column) -> Column:
    """Why a request can't be answered: a symbol stands for a range of its own and is shown without a map; else null."""
    named = F.coalesce(symbol != "", F.lit(False))
    return F.when(named & (start.isNotNull() | most.isNotNull()), "A symbol can't be read with an offset or a limit.").when(
        named & F.coalesce(map_, F.lit(False)), "A symbol can't be read with a map."
    )


def answered(docs: DataFrame, requests: DataFrame, key: str = "doc_id", most_lines: int = MOST_LINES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The requests (key, and the columns of REQUEST, null where not given) with status, message, first_line, last_line,
    truncated and with_map. No line leaves its document: ``lines.lines`` reads what is wanted of it.

    status: ok, conflict (see ``conflict``) or past_end (a start beyond the last line). A start or limit of 0 is none, a
    negative start is the first line, and a negative limit gives no line. A map follows where one is asked for, and where
    a whole document is cut by the budget. Requests for documents that aren't there have no row.
    """
    names = [c.split()[0] for c in REQUEST.split(", ")]
    d = requests.select(key, *names).join(docs.select(key, T.line_array("text").alias("parts")), key)
    given = lambda c: F.coalesce(F.col(c) != 0, F.lit(False))
    first = F.when(given("start"), F.greatest("start", F.lit(1))).otherwise(1)
    total = F.size("parts")
    d = d.withColumn("why", conflict(*map(F.col, names))).withColumn("first", first).withColumn("total", total)
    wanted = F.when(given("most"), F.greatest(F.least(F.col("most"), F.col("total") - F.col("first") + 1), F.lit(0))).otherwise(F.col("total") - F.col("first") + 1)
    past = given("start") & (F.col("first") > F.col("total"))
    status = F.when(F.col("why").isNotNull(), "conflict").when(past, "past_end").otherwise("ok")
    d = d.withColumn("status", status).withColumn("wanted", F.when(F.col("status") == "ok", wanted).otherwise(0))
    fits = head_lines(F.slice("parts", F.col("first"), F.col("wanted")), most_lines, most_bytes, F.col("first"))
    d = d.withColumn("fits", F.when(F.col("wanted") > 0, fits).otherwise(0)).withColumn("truncated", F.col("fits") < F.col("wanted"))
    whole = ~given("start") & ~given("most") & ~F.coalesce(F.col("symbol") != "", F.lit(False))
    message = F.coalesce("why", F.when(F.col("status") == "past_end", F.format_string("Line %d is past the end (%d lines).", "start", "total")))
    with_map = (F.col("status") == "ok") & (F.coalesce("map", F.lit(False)) | (F.col("truncated") & whole))
    shown = F.col("fits") > 0
    return d.select(
        key, *names, "status", message.alias("message"), F.when(shown, F.col("first")).alias("first_line"),
        F.when(shown, F.col("first") + F.col("fits") - 1).alias("last_line"), "truncated", with_map.alias("with_map"),
    )
