"""Symbols of a document, and the text tools that scanners share."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

from .tokens import SIGN, Syntax, replaced, tokenise

#: Kinds that a symbol may have.
KINDS = (
    "class", "constant", "enum", "function", "import", "interface", "method", "module", "namespace", "procedure", "property", "struct", "table",
    "trigger", "type", "unknown", "variable", "view",
)


@dataclass(slots=True)
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    signature: str | None = None
    children: list[Symbol] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)
    doc: str | None = None
    exported: bool | None = None


@dataclass
class Outline:
    language: str
    lines: int
    symbols: list[Symbol]
    imports: list[str] = field(default_factory=list)
    level: str = "full"
    #: scanned; keywords (there is no scanner, or it found nothing); failed (the scanner broke: an error of ours)
    status: str = "scanned"


def flat(symbols: list[Symbol], path: tuple[str, ...] = (), parent: int | None = None, first: int = 0) -> Iterator[tuple[int, int | None, tuple[str, ...], Symbol]]:
    """(number, parent's number, names from the root, symbol) in pre-order."""
    at = first
    for s in symbols:
        number = at
        yield number, parent, (*path, s.name), s
        at += 1
        for row in flat(s.children, (*path, s.name), number, at):
            at = row[0] + 1
            yield row


class Source:
    """A text with its line starts and brackets, and a masked copy: comments blanked, literals as letters, length kept."""

    def __init__(self, text: str, syntax: Syntax) -> None:
        self.text = text
        self.starts = list(accumulate((len(x) + 1 for x in text.split("\n")[:-1]), initial=0))
        found = tokenise(text, syntax)
        blanks = [(a, b, " ") for a, b in found.comments]
        self.close = found.close
        self.masked = replaced(text, sorted(blanks + [(a, b, SIGN) for a, b in found.literals]))
        self.spoken = replaced(text, blanks)  # without comments only

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def clean(self, lo: int, hi: int) -> str:
        """The text between two places without comments, blanks collapsed."""
        return " ".join(self.spoken[lo:hi].split())

    def match(self, at: int) -> int:
        """Just past the bracket that closes the one at ``at``, or the end."""
        return self.close.get(at, len(self.masked))

    @cached_property
    def _lines(self) -> list[str]:
        return self.text.split("\n")

    def doc_above(self, at: int, mark: str) -> str | None:
        """The first line of the comment lines that start with ``mark`` right above the line of ``at``."""
        i, first = self.line(at) - 2, None
        while i >= 0 and (line := self._lines[i].strip()).startswith((mark, "#[")):
            if line.startswith(mark):
                first = line[len(mark) :].strip()
            i -= 1
        return first or None

    def block_doc(self, at: int) -> str | None:
        """The first line with words of the ``/** */`` comment that ends right above the place ``at``."""
        while at > 0 and self.text[at - 1].isspace():
            at -= 1
        if self.text[max(0, at - 2) : at] != "*/":
            return None
        begin = self.text.rfind("/*", 0, at)
        if not self.text.startswith("/**", begin):
            return None
        lines = (x.strip().lstrip("*").strip() for x in self.text[begin + 3 : at - 2].split("\n"))
        return next((x for x in lines if x), None)


@dataclass(slots=True)
class Statement:
    start: int
    head_end: int
    end: int
    body: tuple[int, int] | None


_GOES_ON = re.compile(r"[,=+\-*/&|?:(\[<.]\Z|(?:=>|\bextends|\bimplements)\Z")
_GOES_ON_MOST = 12  # characters of the line's end that tell
_STARTS_ON = re.compile(r"\s*[.?:&|+*=)\]{,]")
_VALUE = re.compile(r"(?<![=!<>])=(?![=>])|=>\s*$|\bimport\b|\bexport\s*$")
_SKIP = re.compile(r"[\s;]*")
_MARKS = {False: re.compile(r"[;{}()\[\]]"), True: re.compile(r"[;{}()\[\]\n]")}


def _goes_on(masked: str, start: int, at: int) -> bool:
    """Whether the statement that began at ``start`` goes on behind the line that ends at ``at``."""
    while at > start and masked[at - 1].isspace():
        at -= 1
    return bool(_GOES_ON.search(masked[max(start, at - _GOES_ON_MOST) : at]))


def statements(src: Source, lo: int, hi: int, newline: bool = False) -> Iterator[Statement]:
    """Statements between two places at one nesting: each ends at a semicolon, a closed block, or (newline) a line end
    that neither side carries over. A block behind an ``=`` belongs to a value, so the statement goes on behind it."""
    masked, at = src.masked, lo
    search, close, size = _MARKS[newline].search, src.close, len(masked)
    while at < hi:
        skip = _SKIP.match(masked, at, hi).end()
        if skip >= hi:
            return
        start, pos, body, value = skip, skip, None, False
        end, judged = hi, skip
        while m := search(masked, pos, hi):
            ch, pos = m[0], m.end()
            if ch in "([":
                pos = min(hi, close.get(m.start(), size))
            elif ch == "{":
                stop = min(hi, close.get(m.start(), size))
                if body is None:
                    body = (m.start() + 1, stop - 1)
                pos = stop
                value = value or bool(_VALUE.search(masked[max(start, judged - 8) : m.start()]))
                judged = m.start()
                if not value:
                    end = stop
                    break
            elif ch == ";":
                end = m.end()
                break
            elif ch == "\n" and not _goes_on(masked, start, m.start()) and not _STARTS_ON.match(masked, pos, hi):
                end = m.start()
                break
        yield Statement(start, body[0] - 1 if body else end, end, body)
        at = max(end, start + 1)


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts between separators outside all brackets."""
    out, depth, last = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch in "([{<") - (ch in ")]}" or (ch == ">" and text[i - 1 : i] not in ("-", "=")))
        if ch == by and depth <= 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]
