"""Documents as numbered, anchored lines: slices, the head budget, and anchor parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.linehash import line_hash

#: The head budget.
MOST_LINES, MOST_BYTES = 2000, 50 * 1024


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, canonical text, has_bom, ending, bare_cr and is_binary."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        key, T.canonical_text(raw).alias("text"), F.startswith(raw, F.lit(T.BOM)).alias("has_bom"),
        T.dominant_ending(raw).alias("ending"), T.has_bare_cr(raw).alias("bare_cr"), T.has_nul(raw).alias("is_binary"),
    )


def lines(docs: DataFrame, key: str = "doc_id", offset: int | None = None, limit: int | None = None) -> DataFrame:
    """key, line_no, text of canonical documents. A slice is taken before lines become rows."""
    parts = T.line_array("text")
    start = offset or 1
    if offset or limit:
        parts = F.slice(parts, F.lit(start), F.lit(limit) if limit else F.greatest(F.size(parts) - start + 1, F.lit(0)))
    return docs.select(key, F.posexplode(parts).alias("i", "text")).select(key, (F.col("i") + start).alias("line_no"), "text")


def anchored(numbered: DataFrame) -> DataFrame:
    """Adds hash and anchor (``LINE:HASH|text``)."""
    h = numbered.withColumn("hash", line_hash("text"))
    return h.withColumn("anchor", F.concat(F.col("line_no").cast("string"), F.lit(":"), "hash", F.lit("|"), "text"))


def head_lines(parts: Column, most_lines: int = MOST_LINES, most_bytes: int = MOST_BYTES, first: Column | None = None) -> Column:
    """How many leading lines fit both budgets, as anchored text: an anchor adds the number's digits and four bytes.

    first: the number of the first line, 1 where not given.
    """
    first = F.lit(1) if first is None else first
    cost = F.transform(parts, lambda x, i: F.length((i + first).cast("string")) + 4 + F.octet_length(x) + F.when(i > 0, 1).otherwise(0))
    start = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(acc: Column, c: Column) -> Column:
        fits = acc["open"] & (acc["n"] < most_lines) & (acc["bytes"] + c <= most_bytes)
        return F.struct((acc["bytes"] + F.when(fits, c).otherwise(0)).cast("long").alias("bytes"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

    return F.aggregate(F.slice(cost, F.lit(1), F.lit(most_lines)), start, add, lambda acc: acc["n"])


def head(docs: DataFrame, key: str = "doc_id", most_lines: int = MOST_LINES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """key, line_no, text, total and truncated of the lines within the budget; no shuffle."""
    parts = T.line_array("text")
    d = docs.select(key, parts.alias("parts")).withColumn("n", head_lines(F.col("parts"), most_lines, most_bytes))
    d = d.select(key, F.size("parts").alias("total"), (F.col("n") < F.size("parts")).alias("truncated"), F.posexplode(F.slice("parts", F.lit(1), F.col("n"))).alias("i", "text"))
    return d.select(key, (F.col("i") + 1).alias("line_no"), "text", "total", "truncated")


def parsed_anchor(ref: Column | str) -> Column:
    """A struct of line, hash and content (what follows the first bar), or null line where ``ref`` isn't LINE:HASH."""
    c = F.col(ref) if isinstance(ref, str) else ref
    bar = F.instr(c, "|")
    head_part = T.trimmed(F.regexp_replace(F.regexp_replace(c, r"(?s)\|.*$", ""), "(?s) {2}.*$", ""))
    tight = F.regexp_replace(head_part, rf"^([^:]*?){T.BLANK_CLASS}*:{T.BLANK_CLASS}*", "$1:")
    ok = tight.rlike("^[0-9]+:[0-9a-fA-F]{2}$") & (F.try_to_number(F.split_part(tight, F.lit(":"), F.lit(1)), F.lit("9999999999")) >= 1)
    return F.struct(
        F.when(ok, F.split_part(tight, F.lit(":"), F.lit(1)).try_cast("int")).alias("line"),
        F.when(ok, F.split_part(tight, F.lit(":"), F.lit(2))).alias("hash"),
        F.when(bar > 0, F.substr(c, bar + 1)).alias("content"),
    )


def rendered(rows: DataFrame, key: str, text: str = "anchor") -> DataFrame:
    """key and the document's lines joined in order."""
    gathered = F.array_sort(F.collect_list(F.struct("line_no", F.col(text).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(gathered, lambda x: x["t"]), "\n").alias("text"))
