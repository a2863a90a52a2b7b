"""One pass over a source: what is comment, what is literal, which brackets belong together, how deep each line is.

The pass keeps a stack of open brackets and templates. Scanners look places up and never scan a block again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache, cached_property

#: Stands for each character of a literal in the masked text: a letter, so that a line ending in a string ends in a word.
SIGN = "ª"
#: Words after which a slash starts a regular expression.
BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"`|\$\{|\\[\s\S]")
_CHAR = re.compile(r"'(?:\\[^\n]{1,10}?|[^'\\\n])'")
_RUST_RAW = re.compile(r'b?r(#*)"')
_CPP_RAW = re.compile(r'R"([^()\\\s]{0,16})\(')
_LAST = re.compile(r"\w+\Z|.\Z", re.S)
_LAST_MOST = 16  # characters that tell whether the last word is one of BEFORE_REGEX


@dataclass(frozen=True)
class Syntax:
    """A language's comments and literals. templates: backquotes with ``${}``; raw: which raw strings it knows."""

    comment: str = "//"
    block: tuple[str, str] | None = ("/*", "*/")
    quotes: str = "\"'"
    chars: bool = False  # a single quote may also start a lifetime
    nested: bool = False  # block comments nest
    templates: bool = False
    regex: bool = False
    raw: str = ""  # "`", "rust" or "cpp"


@dataclass
class Tokens:
    text: str
    comments: list[tuple[int, int]] = field(default_factory=list)
    literals: list[tuple[int, int]] = field(default_factory=list)
    close: dict[int, int] = field(default_factory=dict)  # just past the partner of each opening bracket
    braces: list[tuple[int, int]] = field(default_factory=list)  # how many braces are open from a place on

    @cached_property
    def depth(self) -> list[int]:
        """Open braces where each line starts."""
        out, n, left = [0], 0, self.braces[::-1]
        for m in re.finditer("\n", self.text):
            while left and left[-1][0] <= m.start():
                n = left.pop()[1]
            out.append(n)
        return out


@cache
def _patterns(syntax: Syntax) -> tuple[re.Pattern, dict[str, re.Pattern], re.Pattern | None]:
    """What starts a token, whole strings by their quote, and both ends of a block comment."""
    marks = [re.escape(syntax.comment), r"[()\[\]{}]", *(re.escape(q) for q in syntax.quotes)]
    marks += [re.escape(x[0]) for x in (syntax.block,) if x] + ["`"] * (syntax.templates or syntax.raw == "`") + ["/"] * syntax.regex
    marks += [_RUST_RAW.pattern.replace("(#*)", "#*")] * (syntax.raw == "rust") + [r'R"[^()\\\s]{0,16}\('] * (syntax.raw == "cpp")
    marks.sort(key=lambda m: -len(m))
    strings = {q: re.compile(rf"{re.escape(q)}(?:\\[\s\S]|[^{re.escape(q)}\\\n])*{re.escape(q)}?") for q in syntax.quotes}
    return re.compile("|".join(marks)), strings, re.compile("|".join(map(re.escape, syntax.block))) if syntax.block else None


def tokenise(text: str, syntax: Syntax) -> Tokens:
    """Literals that are not closed end with their line (templates and raw strings with the text); an unclosed bracket
    closes with the bracket around it, or the text."""
    token, strings, nest = _patterns(syntax)
    out, stack, braces = Tokens(text), [], 0  # stack: (bracket or "`", place)
    plain = {q: p.match for q, p in strings.items() if q != "'" or not syntax.chars}
    at, said, size = 0, "", len(text)  # said: the last word or sign that isn't blank or comment

    def template(start: int, at: int) -> int:
        """Go on in a template whose literal part starts at ``start``; just past its end or the next ``${``."""
        while m := _TEMPLATE.search(text, at):
            at = m.end()
            if m[0] == "`":
                out.literals.append((start, at))
                return at
            if m[0] == "${":
                out.literals.append((start, at))
                stack.append(("`", m.start()))
                return at
        out.literals.append((start, size))
        return size

    while m := token.search(text, at):
        begin, what = m.start(), m[0]
        if syntax.regex and (between := text[at:begin].strip()):  # only a slash asks what was said
            said = _LAST.search(between[-_LAST_MOST:])[0]
        at = m.end()
        if what in _PAIRS:
            stack.append((what, begin))
            if what == "{":
                braces += 1
                out.braces.append((begin, braces))
            said = what
        elif what in plain:
            at = plain[what](text, begin).end()
            out.literals.append((begin, at))
            said = SIGN
        elif what in ")]}":
            if what == "}" and stack and stack[-1][0] == "`":
                stack.pop()
                at = template(begin, at)
                said = SIGN
                continue
            if stack and _PAIRS.get(stack[-1][0]) == what:
                out.close[stack.pop()[1]] = at
                if what == "}":
                    braces -= 1
                    out.braces.append((begin, braces))
                said = what
                continue
            kinds = [i for i in range(len(stack) - 1, max(-1, len(stack) - 9), -1) if _PAIRS.get(stack[i][0]) == what]
            if kinds:
                for kind, place in stack[kinds[0] + 1 :]:
                    braces -= kind == "{"
                    out.close[place] = begin
                out.close[stack[kinds[0]][1]] = at
                braces -= what == "}"
                out.braces.append((begin, braces))
                del stack[kinds[0] :]
            said = what
        elif what == syntax.comment:
            at = text.find("\n", begin)
            at = size if at < 0 else at
            out.comments.append((begin, at))
        elif syntax.block and what == syntax.block[0]:
            level = 1
            while level and (n := nest.search(text, at)):
                at = n.end()
                level += (1 if n[0] == syntax.block[0] else -1) if syntax.nested or n[0] != syntax.block[0] else 0
            at = size if level else at
            out.comments.append((begin, at))
        else:
            at = _literal(text, begin, what, syntax, strings, said, template, at)
            if at > begin + (what == "/" or (what == "'" and syntax.chars)):
                if what != "`" or not syntax.templates:
                    out.literals.append((begin, at))
                said = SIGN
            else:
                at, said = m.end(), what
    for _, place in stack:
        out.close.setdefault(place, size)
    return out


def _literal(text: str, begin: int, what: str, syntax: Syntax, strings: dict[str, re.Pattern], said: str, template, at: int) -> int:  # noqa: ANN001
    """Just past the literal that starts at ``begin``; at most one past it if none does."""
    if what == "/":
        m = _REGEX.match(text, begin) if said in BEFORE_REGEX or said in ("", *"(,=:[!&|?{;+-*%~^<>") else None
        return m.end() if m else begin
    if what == "`":
        end = template(begin, at) if syntax.templates else text.find("`", at) + 1
        return end or len(text)
    if what[0] in "bR" or what[0] == "r":
        if syntax.raw == "rust":
            ending = '"' + "#" * what.count("#")
        else:
            ending = ")" + what[2:-1] + '"'
        end = text.find(ending, at)
        return len(text) if end < 0 else end + len(ending)
    if what == "'" and syntax.chars:
        m = _CHAR.match(text, begin)
        return m.end() if m else begin
    return strings[what].match(text, begin).end()


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span's characters replaced by its sign; line ends of spans of blanks stay."""
    parts, at = [], 0
    for begin, end, sign in spans:
        parts.append(text[at:begin])
        parts.append(re.sub(r"[^\n]", " ", text[begin:end]) if sign == " " and text.find("\n", begin, end) >= 0 else sign * (end - begin))
        at = end
    return "".join([*parts, text[at:]])
