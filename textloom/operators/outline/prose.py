"""Outlines of Markdown and SQL, and the keyword outline of anything else."""

from __future__ import annotations

import re

from .model import Outline, Symbol


def markdown(text: str, name: str = "") -> Outline | None:
    """Headings outside fences; a heading lies in the last one of lower level."""
    lines = re.split(r"\r?\n", text)
    total, fenced = text.count("\n") + 1, False
    found: list[tuple[int, Symbol]] = []
    for i, line in enumerate(lines, 1):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and (m := re.fullmatch(r"(#{1,6})\s+(.+)", line)):
            if found:
                found[-1][1].end = i - 1
            title = m[2].strip()
            found.append((len(m[1]), Symbol(title, "class", i, total, f"{m[1]} {title}")))
    roots: list[Symbol] = []
    last: dict[int, Symbol] = {}  # by level
    for level, symbol in found:
        above = max((k for k in last if k < level), default=0)
        (last[above].children if above else roots).append(symbol)
        last = {k: v for k, v in last.items() if k < level} | {level: symbol}
    return Outline("Markdown", total, roots) if roots else None


#: Statements that define something, in order of precedence, and the pieces that they share.
_NAME = r'(?:"?(\w+)"?\.)?"?(\w+)"?'
_ONCE = r"(?:IF\s+NOT\s+EXISTS\s+)?"
_OR = r"(?:OR\s+REPLACE\s+)?"
DDL = (
    ("TABLE", "class", rf"CREATE\s+{_OR}(?:TEMP(?:ORARY)?\s+)?TABLE\s+{_ONCE}{_NAME}"),
    ("VIEW", "class", rf"CREATE\s+{_OR}(?:TEMP(?:ORARY)?\s+)?(?:MATERIALIZED\s+)?VIEW\s+{_ONCE}{_NAME}"),
    ("INDEX", "variable", rf'CREATE\s+(?:UNIQUE\s+)?(?:CLUSTERED\s+)?(?:NONCLUSTERED\s+)?INDEX\s+{_ONCE}(?:CONCURRENTLY\s+)?"?(\w+)"?\s+ON\s+"?(\w+)"?'),
    ("FUNCTION", "function", rf"CREATE\s+{_OR}(?:DEFINER\s*=\s*\S+\s+)?(?:AGGREGATE\s+)?(?:FUNCTION|PROCEDURE)\s+{_ONCE}{_NAME}"),
    ("TRIGGER", "function", rf'CREATE\s+{_OR}(?:CONSTRAINT\s+)?TRIGGER\s+{_ONCE}"?(\w+)"?'),
    ("TYPE", "class", rf"CREATE\s+{_OR}(?:TYPE|DOMAIN)\s+{_ONCE}{_NAME}"),
    ("SCHEMA", "class", rf'CREATE\s+SCHEMA\s+{_ONCE}(?:AUTHORIZATION\s+)?"?(\w+)"?'),
    ("ALTER TABLE", "variable", rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_NAME}"),
)
_DDL = [(prefix, kind, re.compile(r"\s*" + p, re.I | re.A)) for prefix, kind, p in DDL]
_NEXT = re.compile(r"\s*(?:CREATE|ALTER)\s+", re.I)


def sql(text: str, name: str = "") -> Outline:
    lines = text.split("\n")
    symbols: list[Symbol] = []
    for i, line in enumerate(lines):
        for prefix, kind, pattern in _DDL:
            if m := pattern.match(line):
                names = [g for g in m.groups() if g]
                title = " ON ".join(names) if prefix == "INDEX" else names[-1]
                stop = next((j + (";" in x) for j, x in ((j, lines[j]) for j in range(i, len(lines))) if ";" in x or (j > i and _NEXT.match(x))), len(lines))
                symbols.append(Symbol(f"{prefix} {title}", kind, i + 1, stop))
                break
    for a, b in zip(symbols, symbols[1:], strict=False):
        a.end = min(a.end, b.start - 1)
    return Outline("SQL", len(lines), symbols)


#: What starts a line that defines something.
KEYWORDS = (
    ("class ", "class"), ("def ", "function"), ("async def ", "function"), ("func ", "function"), ("function ", "function"), ("export ", "function"),
    ("struct ", "struct"), ("enum ", "enum"), ("interface ", "interface"), ("type ", "type"), ("#define ", "constant"), ("CREATE TABLE", "table"),
    ("CREATE VIEW", "view"), ("CREATE FUNCTION", "function"), ("CREATE PROCEDURE", "procedure"), ("ALTER TABLE", "table"),
)
#: Words that may stand before the name; those of SQL in any case.
_BEFORE = {w for start, _ in KEYWORDS for w in start.split()} | {"const", "let", "var", "INDEX", "TRIGGER"}


def _named(line: str) -> str:
    """What follows the known words that a line begins with."""
    while (word := line.split(maxsplit=1)[:1]) and (word[0] in _BEFORE or word[0].upper() in _BEFORE):
        line = line[len(word[0]) :].lstrip()
    return line


def keywords(text: str, name: str = "", language: str = "Unknown", most: int = 500) -> Outline | None:
    total = text.count("\n")
    symbols: list[Symbol] = []
    for i, line in enumerate(text.split("\n"), 1):
        if len(symbols) < most and line.startswith(tuple(k for k, _ in KEYWORDS)):
            line = line.strip()
            rest = _named(line)
            m = re.match(r"[\w$]+", rest, re.A)
            title = m[0] if m else re.split(r"\s|[({<:]", rest)[0] or "unknown"
            kind = next((kind for k, kind in KEYWORDS if line.lower().startswith(k.lower())), "unknown")
            symbols.append(Symbol(title, kind, i, min(i + 50, total)))
    for a, b in zip(symbols, symbols[1:], strict=False):
        a.end = max(a.start, b.start - 1)
    return Outline(language, total, symbols, level="minimal") if symbols else None
