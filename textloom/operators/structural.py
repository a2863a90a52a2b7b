"""Structural search: patterns of elements with metavariables, matched against element trees.

A page becomes one row of arrays over its nodes in pre-order (elements and texts that aren't blank): tag, size of the
subtree, first and last child, siblings, attributes, place. A pattern is markup: ``$A`` in the place of a node matches
any one node, in the place of an attribute's value any value; ``$$$`` matches any number of siblings, ``$$$A`` names
them; ``$_`` is never compared. A metavariable that occurs twice must stand for the same source both times.

Matching is an expression over a page's arrays: from a candidate root each node of the pattern is a hop to a first
child or the next sibling (from the right behind a last ``$$$``), so no page is joined with itself, nothing is shuffled,
and work follows the nodes that have the root's tag. Between two ``$$$`` nodes go to the leftmost place where they match
by themselves.

Pages are read leniently: elements without end tag end with their parent, end tags without element are passed over,
void elements hold nothing. A null page has the status ``unreadable`` and no nodes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import pieces
from .outline import arrow_schema

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT = "#text"
_MANY, _ONE = re.compile(r"\$\$\$(\w*)"), re.compile(r"\$(\w+)")


@dataclass
class Node:
    tag: str
    start: int
    end: int = -1
    attrs: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    children: list[Node] = field(default_factory=list)


class _Builder(HTMLParser):
    """Builds the tree of a text; places are offsets in it."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=False)
        self.source, self.root = text, Node("", 0)
        self.open = [self.root]
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.said = -1  # where the run of text that is open starts
        self.feed(text)
        self.close()
        self._end_text(len(text))
        for node in self.open:
            node.end = len(text)

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _end_text(self, at: int) -> None:
        if self.said >= 0 and (text := self.source[self.said : at]).strip():
            start = self.said + len(text) - len(text.lstrip())
            self.open[-1].children.append(Node(TEXT, start, start + len(text.strip()), text=text.strip()))
        self.said = -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        at = self._place()
        self._end_text(at)
        node = Node(tag, at, at + len(self.get_starttag_text()), {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = self._place()
        self._end_text(at)
        depth = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if depth:
            for node in self.open[depth + 1 :]:
                node.end = at
            self.open[depth].end = self.source.find(">", at) + 1 or len(self.source)
            del self.open[depth:]

    def _said(self, _: str) -> None:
        if self.said < 0:
            self.said = self._place()

    handle_data = handle_entityref = handle_charref = _said

    def _unsaid(self, _: str) -> None:
        self._end_text(self._place())

    handle_comment = handle_decl = handle_pi = unknown_decl = _unsaid


def parsed(text: str) -> Node:
    """The tree under a nameless root."""
    return _Builder(text).root


_COLUMNS = "tag array<string>, text array<string>, attrs array<map<string,string>>, size array<int>, parent array<int>, first array<int>, last array<int>, next array<int>, previous array<int>, start array<int>, end array<int>, start_line array<int>, end_line array<int>"


def _rows(text: str) -> dict[str, list]:
    out: dict[str, list] = {part.split()[0]: [] for part in _COLUMNS.split(", ")}
    built = _Builder(text)
    lines = built.lines
    stack = [(n, -1) for n in reversed(built.root.children)]
    # pre-order numbers follow from the order of visits; sizes and links from the numbers
    number: dict[int, int] = {}
    parents: list[tuple[Node, int]] = []
    while stack:
        node, parent = stack.pop()
        number[id(node)] = at = len(out["tag"])
        parents.append((node, at))
        for k, v in (("tag", node.tag), ("text", node.text), ("attrs", node.attrs), ("size", 1), ("parent", parent), ("first", None), ("last", None), ("next", None), ("previous", None), ("start", node.start), ("end", node.end), ("start_line", bisect_right(lines, node.start)), ("end_line", bisect_right(lines, max(node.start, node.end - 1)))):
            out[k].append(v)
        stack += [(n, at) for n in reversed(node.children)]
    for node, at in [*parents, (built.root, -1)]:
        own = [number[id(n)] for n in node.children]
        if at >= 0 and own:
            out["first"][at], out["last"][at] = own[0], own[-1]
        for a, b in zip(own, own[1:], strict=False):
            out["next"][a], out["previous"][b] = b, a
    for node, at in reversed(parents):
        out["size"][at] += sum(out["size"][number[id(n)]] for n in node.children)
    return out


def trees(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, source, status (``read`` or ``unreadable``) and the arrays of each page's nodes."""
    source = pages.select(key, F.col(html).alias("source"))
    ddl = f"{key} {source.schema[key].dataType.simpleString()}, source string, status string, {_COLUMNS}"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [
                {key: k, "source": text, "status": "unreadable" if text is None else "read", **{c: [list(x.items()) for x in v] if c == "attrs" else v for c, v in _rows(text or "").items()}}
                for k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return source.mapInArrow(run, ddl)


class Pattern:
    """A pattern's conditions and bindings as expressions over a page's arrays and the number of a candidate root."""

    def __init__(self, pattern: str) -> None:
        roots = parsed(pattern).children
        if len(roots) != 1 or roots[0].tag == TEXT:
            raise ValueError("a pattern is one element")
        self.root = roots[0]

    def at(self, i: Column) -> tuple[Column, dict[str, Column]]:
        """Whether the pattern matches at node ``i``, and what its metavariables stand for."""
        state = _State()
        self._element(self.root, i, state)
        condition = state.conditions[0]
        for c in state.conditions[1:]:
            condition = condition & c
        return F.coalesce(condition, F.lit(False)), {k: v[0] for k, v in state.bound.items()}

    def _element(self, node: Node, i: Column, state: _State) -> None:
        state.conditions.append(_of("tag", i) == node.tag)
        for name, value in node.attrs.items():
            given = F.try_element_at(_of("attrs", i), F.lit(name))
            if m := _ONE.fullmatch(value):
                state.conditions.append(given.isNotNull())
                state.bind(m[1], given)
            else:
                state.conditions.append(given == value)
        children = [c for n in node.children for c in _split(n)]
        segments: list[list[Node]] = [[]]
        many: list[str] = []
        for c in children:
            if c.tag == TEXT and (m := _MANY.fullmatch(c.text)):
                many.append(m[1])
                segments.append([])
            else:
                segments[-1].append(c)
        if not children:
            state.conditions.append(_of("first", i).isNull())
            return
        left, before = _of("first", i), None
        for k, c in enumerate(segments[0]):
            place = left if k == 0 else _of("next", before)
            self._node(c, place, state)
            before = place
        if not many:
            state.conditions.append(_of("next", before).isNull())
            return
        after_left = before
        for name, segment in zip(many, segments[1:-1], strict=False):
            place = self._leftmost(segment, i, after_left, state)
            state.between(name, i, after_left, place)
            for k, c in enumerate(segment):
                at = place if k == 0 else _of("next", after_left)
                self._node(c, at, state)
                after_left = at
        right = None
        for k, c in enumerate(reversed(segments[-1])):
            place = _of("last", i) if k == 0 else _of("previous", right)
            self._node(c, place, state)
            right = place
        if right is not None:
            state.conditions.append(right > (after_left if after_left is not None else i))
        state.between(many[-1], i, after_left, right)

    def _leftmost(self, segment: list[Node], parent: Column, behind: Column | None, state: _State) -> Column:
        """The least child of ``parent`` behind a place where the segment matches by itself."""
        begin = parent + 1 if behind is None else behind + _of("size", behind)
        inside = F.sequence(begin, parent + _of("size", parent) - 1)

        def fits(j: Column) -> Column:
            own = _State()
            at = j
            for k, c in enumerate(segment):
                at = at if k == 0 else _of("next", at)
                self._node(c, at, own)
            found = _of("parent", j) == parent
            for c in own.conditions:
                found = found & c
            return F.coalesce(found, F.lit(False))

        return F.get(F.filter(F.when(begin <= parent + _of("size", parent) - 1, inside), fits), F.lit(0))

    def _node(self, node: Node, place: Column, state: _State) -> None:
        if node.tag != TEXT:
            self._element(node, place, state)
        elif m := _ONE.fullmatch(node.text):
            state.conditions.append(place.isNotNull())
            state.bind(m[1], _source(_of("start", place), _of("end", place)))
        else:
            state.conditions.append((_of("tag", place) == TEXT) & (_of("text", place) == node.text))


@dataclass
class _State:
    conditions: list[Column] = field(default_factory=list)
    bound: dict[str, list[Column]] = field(default_factory=dict)

    def bind(self, name: str, value: Column) -> None:
        if name != "_":
            if name in self.bound:
                self.conditions.append(self.bound[name][0] == value)
            self.bound.setdefault(name, []).append(value)

    def between(self, name: str, parent: Column, left: Column | None, right: Column | None) -> None:
        """Bind the siblings between two places (None: the parent's ends)."""
        if name:
            begin = _of("first", parent) if left is None else _of("next", left)
            end = _of("last", parent) if right is None else _of("previous", right)
            self.bind(name, F.when(F.coalesce(begin <= end, F.lit(False)), _source(_of("start", begin), _of("end", end))).otherwise(""))


def _of(name: str, i: Column) -> Column:
    return F.get(F.col(name), i)


def _source(start: Column, end: Column) -> Column:
    return F.substring(F.col("source"), start + 1, end - start)


def _split(node: Node) -> list[Node]:
    """A pattern's text as texts and metavariables."""
    if node.tag != TEXT:
        return [node]
    parts = [p.strip() for p in re.split(r"(\$\$\$\w*|\$\w+)", node.text)]
    return [Node(TEXT, 0, 0, text=p) for p in parts if p]


def matches(found: DataFrame, pattern: str, key: str = "page_id") -> DataFrame:
    """key, node, start_line, end_line and bound (metavariable to source) of every match; of ``trees``."""
    compiled = Pattern(pattern)
    candidates = F.filter(F.sequence(F.lit(0), F.size("tag") - 1), lambda i: _of("tag", i) == compiled.root.tag)
    rooted = found.where(F.array_contains("tag", compiled.root.tag)).withColumn("candidates", candidates)

    def row(i: Column) -> Column:
        condition, bound = compiled.at(i)
        names = [x for k, v in bound.items() for x in (F.lit(k), v)]
        values = F.create_map(*names) if names else F.create_map().cast("map<string,string>")
        return F.when(condition, F.struct(i.alias("node"), _of("start_line", i).alias("start_line"), _of("end_line", i).alias("end_line"), values.alias("bound")))

    return rooted.select(key, F.inline(F.filter(F.transform("candidates", row), lambda x: x.isNotNull())))
