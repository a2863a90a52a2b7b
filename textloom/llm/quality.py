"""Quality rules: a learned decision list over text statistics, by sequential covering.

Rules are conjunctions of thresholds. A rule grows on two thirds of the labelled rows (the threshold of most
information gain is added until no low-quality row's cover improves), is pruned on the last third, and is kept while
it is precise there; the rows it covers go, and the next rule is learned. The list is emitted as one ordered Spark
conditional, so applying it is a projection.

Everything that touches documents is DataFrame expressions. Learning sees at most ``sample`` labelled rows (a documented
bound, in the order of a hash of the id) and runs on the driver over their statistics.

Repeated windows are found by 64-bit hashes of five 64-bit word hashes, compared within one text only.

Defined results: null or blank text has no words and fails the base rules; null labels are not learned from; of several
labels of an id the least counts, of several texts of a labelled id the one of least hash is learned from; with no
labelled row the list is empty and the base rules alone decide; each input row gives one row; texts of any length are
read whole; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_BLANKS = r"[ \t\n\x0B\f\r]+"


def base_columns(text: Column) -> dict[str, Column]:
    """Expressions over a text column ``text`` for the arrays that the statistics need."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return {"words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS)), "lines": F.split(F.coalesce(text, F.lit("")), "\n")}


def statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what rules look at."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    bare = whole
    for ch in SYMBOLS:
        bare = F.replace(bare, F.lit(ch), F.lit(""))
    d = docs.select(*carry, whole.alias("text"), *(c.alias(f"_{k}") for k, c in base_columns(F.col("text")).items()))
    d = d.select(
        *carry, "text", F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).alias("_chars"),
        (F.length("text") - F.length(bare)).alias("_symbols"),
        F.filter("_lines", lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # a window is the 64-bit hash of five word hashes; an array of longs sorts and de-duplicates without boxing
    window = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("_n") - 4, F.lit(1))),
        lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(-1, 4))),
    )
    d = d.withColumn("_windows", F.when(F.col("_n") >= 5, window))
    placed = F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    last = F.size("_placed") - 1
    repeated = F.filter(
        "_placed",
        lambda x, i: ((i > 0) & (F.get("_placed", i - 1)["w"] == x["w"])) | ((i < last) & (F.get("_placed", i + 1)["w"] == x["w"])),
    )
    d = d.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
    d = d.withColumn("_starts", F.when(F.col("_placed").isNotNull(), F.array_sort(F.transform(repeated, lambda x: x["i"]))))
    # each repeated window covers its words up to the next repeated window's start, five at most
    covered = F.aggregate(
        F.transform("_starts", lambda s, i: F.when(i + 1 < F.size("_starts"), F.least(F.lit(5), F.get("_starts", i + 1) - s)).otherwise(5)),
        F.lit(0), lambda a, x: a + x,
    )
    lines = F.size("_lines")
    upper = F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))
    n = F.greatest(F.col("n_words"), F.lit(1))
    counted = F.struct(
        F.col("_n").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        lines.alias("_lines"), upper.alias("_upper"),
    )
    # made as a generator's row: a later filter isn't pushed below it, which would copy these expressions over and over
    return d.select(*carry, F.inline(F.array(counted))).select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word"), (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))).alias("dup_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("_upper") / F.greatest("word_chars", F.lit(1))).alias("upper_share"),
    )


#: What rules may test.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_share", "repeat_share", "upper_share")


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Test, ...]


def _counts(rows: list[dict], rule: Rule) -> tuple[int, int]:
    got = [r["bad"] for r in rows if all(t.holds(r) for t in rule)]
    return sum(got), len(got) - sum(got)


def _grow(rows: list[dict], most: int, bins: int) -> Rule:
    rule: Rule = ()
    inside = rows
    while len(rule) < most:
        p0 = sum(r["bad"] for r in inside)
        n0 = len(inside) - p0
        if not p0 or not n0:
            break
        before, best, gain = log2(p0 / (p0 + n0)), None, 1e-9
        for f in FEATURES:
            ordered = sorted((r[f], r["bad"]) for r in inside)
            bad = 0
            step = max(1, len(ordered) // bins)
            for i, (value, is_bad) in enumerate(ordered[:-1]):
                bad += is_bad
                if value == ordered[i + 1][0] or (i % step and value and ordered[i + 1][0]):
                    continue
                for above, p, n in ((False, bad, i + 1 - bad), (True, p0 - bad, n0 - (i + 1 - bad))):
                    if p and (g := p * (log2(p / (p + n)) - before)) > gain:
                        best, gain = Test(f, above, (value + ordered[i + 1][0]) / 2), g
        if best is None:
            break
        rule += (best,)
        inside = [r for r in inside if best.holds(r)]
    return rule


def learn(rows: list[dict], *, most_rules: int = 12, most_tests: int = 4, bins: int = 64, precision: float = 0.97, least: int = 4) -> list[Rule]:
    """An ordered list of rules that find rows with ``bad`` = 1. ``precision``: of a rule on the pruning rows, Laplace-corrected."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < most_rules and any(r["bad"] for r in left):
        grow, prune = [r for i, r in enumerate(left) if i % 3], [r for i, r in enumerate(left) if not i % 3]
        rule = _grow(grow, most_tests, bins)

        def worth(x: Rule, rows: list[dict] = prune) -> float:
            p, n = _counts(rows, x)
            return (p - n) / (p + n + 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = _counts(left, rule) if rule else (0, 0)
        pp, pn = _counts(prune, rule) if rule else (0, 0)
        if p < least or p / (p + n) < precision or (pp + 1) / (pp + pn + 2) < precision - 0.2:
            break
        rules.append(rule)
        left = [r for r in left if not all(t.holds(r) for t in rule)]
    return rules


def low_quality(rules: list[Rule]) -> Column:
    """The list as one conditional: the first rule that holds decides."""
    out: Column | None = None
    for rule in rules:
        test = rule[0].column()
        for t in rule[1:]:
            test &= t.column()
        out = F.when(test, True) if out is None else out.when(test, True)
    return F.lit(False) if out is None else out.otherwise(False)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 5000) -> list[Rule]:
    """Rules from at most ``sample`` rows of ``labels`` (doc_id, quality: 1 good, 0 bad) that have a document."""
    rated = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # sample rows bound the broadcast, and one text an id what is collected
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = statistics(found, ("doc_id", "quality")).select("doc_id", "quality", *FEATURES).collect()
    rows = [{f: float(r[f]) for f in FEATURES} | {"bad": int(r.quality == 0)} for r in sorted(rows, key=lambda r: (crc32(str(r.doc_id).encode()), r.doc_id))]
    return learn(rows)


def judge(docs: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, the base statistics, base_failed and kept of every row."""
    d = statistics(docs, carry)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~low_quality(rules)).alias("kept"),
    )


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, fit(docs, labels))
