"""Search through a trigram index: a pattern is compiled to a condition on trigrams, and only blocks that may match are read.

``build`` writes documents dealt into blocks (a partition column, so that unread blocks are never opened) and a table of
postings: a trigram and the blocks that have it, sorted by trigram, so that a lookup reads a few row groups. Trigrams are
of case-folded text, so one index serves searches of either kind.

``condition`` knows literals, groups, alternatives, small classes, quantifiers, quotes and flags; what else it meets
counts as anything, so a block with a match is never left out: at worst all blocks are read, as in a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: A condition: "all", a trigram, or ("and" | "or", conditions).
Condition = str | tuple
ALL = "all"
#: Strings that a piece of a pattern may stand for, while they are followed exactly.
MOST_STRINGS = 16


@lru_cache(maxsize=1 << 16)
def folded(c: str) -> str:
    """As matching without case compares characters: upper case, then lower, one character each."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low[0]


def fold(text: str) -> str:
    return text.lower() if text.isascii() else "".join(map(folded, text))


def _of(text: str) -> Condition:
    """The trigrams of a (folded) string."""
    found = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    return _join("and", found)


def _join(how: str, parts: list[Condition]) -> Condition:
    flat: list[Condition] = []
    for p in parts:
        if p == ALL:
            if how == "or":
                return ALL
            continue
        for q in p[1] if isinstance(p, tuple) and p[0] == how else [p]:
            if q not in flat:
                flat.append(q)
    if not flat:
        return ALL
    return flat[0] if len(flat) == 1 else (how, flat)


def _any_of(strings: set[str]) -> Condition:
    return _join("or", [_of(s) if len(s) > 2 else ALL for s in sorted(strings)])


class _Pattern:
    """A reader of patterns. A piece is (strings it stands for exactly, or None; its condition)."""

    def __init__(self, pattern: str) -> None:
        self.p, self.at = pattern, 0

    def whole(self) -> Condition:
        strings, condition = self.alternatives()
        if self.at < len(self.p):  # a bracket that closes nothing
            return ALL
        return condition if strings is None else _any_of(strings)

    def alternatives(self) -> tuple[set[str] | None, Condition]:
        branches = [self.sequence()]
        while self.p.startswith("|", self.at):
            self.at += 1
            branches.append(self.sequence())
        exact = [s for s, _ in branches]
        if None not in exact and len(all_ := set().union(*exact)) <= MOST_STRINGS:
            return all_, _any_of(all_)
        return None, _join("or", [c if s is None else _any_of(s) for s, c in branches])

    def sequence(self) -> tuple[set[str] | None, Condition]:
        run, known, conditions = {""}, True, []
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            strings, condition, more = self.piece()
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a in run for b in strings}
            else:
                conditions.append(_any_of(run))
                run, known = (strings, False) if strings is not None else ({""}, False)
                if strings is None:
                    conditions.append(condition)
            if more:  # repeated: what follows doesn't join on
                conditions.append(_any_of(run))
                run, known = {""}, False
        if known:
            return run, _any_of(run)
        return None, _join("and", [*conditions, _any_of(run)])

    def piece(self) -> tuple[set[str] | None, Condition, bool]:
        """An atom with its quantifier; whether more of it may follow."""
        strings, condition = self.atom()
        m = re.compile(r"(?:[*+?]|\{(\d+)(,?)(\d*)\})[+?]?").match(self.p, self.at)
        if not m:
            return strings, condition, False
        self.at = m.end()
        what = m[0][0]
        if what in "*?" or (what == "{" and int(m[1]) == 0):
            return (strings | {""}, ALL, False) if what == "?" and strings is not None else (None, ALL, False)
        if m[0].startswith("{1}"):
            return strings, condition, False
        return strings, condition, True

    def atom(self) -> tuple[set[str] | None, Condition]:
        c = self.p[self.at]
        self.at += 1
        if c == "(":
            return self.group()
        if c == "[":
            return self.one_of()
        if c == "\\":
            return self.escape()
        if c == ".":
            return None, ALL
        if c in "^$":
            return {""}, ALL
        return {folded(c)}, ALL

    def group(self) -> tuple[set[str] | None, Condition]:
        m = re.compile(r"\?(?:<[A-Za-z]\w*>|[a-zA-Z-]*[:)]|>|<?[=!])").match(self.p, self.at)
        head = m[0] if m else ""
        if self.p.startswith("?", self.at) and not m or "x" in head.partition("<")[0].rstrip(":)"):
            raise _Unknown
        self.at += len(head)
        if head.endswith(")"):  # flags only
            return {""}, ALL
        found = self.alternatives()
        if not self.p.startswith(")", self.at):
            raise _Unknown
        self.at += 1
        return ({""}, ALL) if head.endswith(("=", "!")) else found

    def one_of(self) -> tuple[set[str] | None, Condition]:
        """A class of a few plain characters is those; any other is anything."""
        start, plain = self.at, True
        if self.p.startswith("^", self.at):
            self.at, plain = self.at + 1, False
        depth, chars, first = 1, set(), True
        while depth:
            if self.at >= len(self.p):
                raise _Unknown
            c = self.p[self.at]
            self.at += 1
            if c == "\\":
                self.at += 1
                plain = False
            elif c == "[":
                depth, plain = depth + 1, False
            elif c == "]" and not (first and self.at - 1 == start):
                depth -= 1
            elif c in "-&":
                plain = False
            else:
                chars.add(folded(c))
            first = False
        return (chars, ALL) if plain and chars and len(chars) <= MOST_STRINGS else (None, ALL)

    def escape(self) -> tuple[set[str] | None, Condition]:
        if self.at >= len(self.p):
            raise _Unknown
        c = self.p[self.at]
        self.at += 1
        if c == "Q":
            end = self.p.find("\\E", self.at)
            said = self.p[self.at :] if end < 0 else self.p[self.at : end]
            self.at = len(self.p) if end < 0 else end + 2
            return {fold(said)}, ALL
        if c in "bBAzZG":
            return {""}, ALL
        if c in "tnrfae":
            return (None, ALL) if c in "ae" else ({"\t\n\r\f"["tnrf".index(c)]}, ALL)
        if c in "wWdDsShHvVRX":
            return None, ALL
        if c.isalnum():  # code points, properties, references
            raise _Unknown
        return {folded(c)}, ALL


class _Unknown(Exception):
    """A form that the reader doesn't know."""


def condition(pattern: str, *, literal: bool = False) -> Condition:
    """What blocks that match have; ``literal``: the pattern is a plain string."""
    if literal:
        return _any_of({fold(pattern)})
    try:
        return _Pattern(pattern).whole()
    except _Unknown:
        return ALL


def trigrams_in(c: Condition) -> set[str]:
    if c == ALL:
        return set()
    return {c} if isinstance(c, str) else set().union(*map(trigrams_in, c[1]))


def _holds(c: Condition, have: Column) -> Column:
    if isinstance(c, str):
        return F.lit(True) if c == ALL else F.array_contains(have, c)
    out = _holds(c[1][0], have)
    for x in c[1][1:]:
        out = out & _holds(x, have) if c[0] == "and" else out | _holds(x, have)
    return out


def build(docs: DataFrame, path: str, block: Column, key: str = "doc_id") -> None:
    """Write key and text of canonical documents to ``path``, dealt by ``block`` (an int of a bounded range), and the postings."""
    spark = docs.sparkSession
    docs.select(key, "text", block.cast("int").alias("block")).repartition("block").write.partitionBy("block").parquet(f"{path}/texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a task has said of a block it need not say again
        said, of = set(), None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for text, b in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if b != of:
                    said, of = set(), b
                t = fold(text.as_py() or "")
                new = set(map("".join, zip(t, t[1:], t[2:], strict=False))) - said
                said |= new
                out[0].extend(new)
                out[1].extend([b] * len(new))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["trigram", "block"])

    found = spark.read.parquet(f"{path}/texts").select("text", "block").mapInArrow(run, "trigram string, block int")
    found.groupBy("trigram").agg(F.sort_array(F.collect_set("block")).alias("blocks")).repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{path}/postings")


def blocks(spark: SparkSession, path: str, pattern: str, *, literal: bool = False) -> list[int] | None:
    """The blocks that may match; None: all. As many numbers as there are blocks come to the driver at most."""
    c = condition(pattern, literal=literal)
    if c == ALL:
        return None
    found = spark.read.parquet(f"{path}/postings").where(F.col("trigram").isin(sorted(trigrams_in(c)))).select("trigram", F.explode("blocks").alias("block"))
    found = found.groupBy("block").agg(F.collect_set("trigram").alias("have")).where(_holds(c, F.col("have")))
    return sorted(r.block for r in found.select("block").collect())


def texts(spark: SparkSession, path: str, among: list[int] | None) -> DataFrame:
    """The documents of the blocks; the scan lists no others."""
    found = spark.read.parquet(f"{path}/texts")
    return (found if among is None else found.where(F.col("block").isin(among))).drop("block")


def grep(spark: SparkSession, path: str, pattern: str, *, key: str = "doc_id", literal: bool = False, **how) -> DataFrame:  # noqa: ANN003
    """``search.grep`` of the indexed documents, over the blocks that may match."""
    return search.grep(texts(spark, path, blocks(spark, path, pattern, literal=literal)), pattern, key=key, literal=literal, **how)
