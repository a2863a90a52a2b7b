"""Column functions for the canonical text rules: line endings, marks, blanks, binary detection, truncation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as blank.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same as a character class for java.util.regex.
BLANK_CLASS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BOM = "\ufeff"
#: Escape sequences that terminals interpret.
ANSI_CONTROL = r"\x1b\[[0-9;]*[a-zA-Z]"
ANSI_TITLE = r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def without_bom(text: Column | str) -> Column:
    return F.when(F.startswith(_c(text), F.lit(BOM)), F.substr(_c(text), F.lit(2))).otherwise(_c(text))


def to_lf(text: Column | str) -> Column:
    """CRLF, then bare CR, become LF."""
    return F.replace(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def canonical_text(text: Column | str) -> Column:
    return to_lf(without_bom(text))


def dominant_ending(text: Column | str) -> Column:
    """``crlf`` where the first CRLF comes before the first LF of its own, else ``lf``."""
    crlf, lf = F.instr(_c(text), "\r\n"), F.instr(_c(text), "\n")
    return F.when((crlf > 0) & (crlf < lf), "crlf").otherwise("lf")


def has_bare_cr(text: Column | str) -> Column:
    return F.instr(F.replace(_c(text), F.lit("\r\n"), F.lit("")), "\r") > 0


def is_binary(content: Column | str) -> Column:
    """Bytes with a NUL, or that are not UTF-8; nothing is not binary."""
    text = _c(content).cast("string")
    return (F.instr(text, "\x00") > 0) | ~F.is_valid_utf8(text)


def has_nul(content: Column | str) -> Column:
    return F.instr(_c(content).cast("string"), "\x00") > 0


def squeezed(text: Column | str) -> Column:
    """Without any blank."""
    return F.translate(_c(text), BLANKS, "")


def trimmed(text: Column | str) -> Column:
    return F.btrim(_c(text), F.lit(BLANKS))


def line_array(text: Column | str) -> Column:
    """Lines of LF text; empty text is one empty line, and what follows a last LF is a line."""
    return F.split(_c(text), "\n", -1)


def strip_ansi(text: Column | str) -> Column:
    """Without terminal escape sequences; texts that hold none are not searched."""
    plain = F.regexp_replace(F.regexp_replace(_c(text), ANSI_CONTROL, ""), ANSI_TITLE, "")
    return F.when(F.instr(_c(text), "\x1b") > 0, plain).otherwise(_c(text))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    c = _c(text)
    return F.when(F.octet_length(c) == F.length(c), F.length(c)).otherwise((F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int"))


def truncate(text: Column | str, most: int) -> Column:
    c = _c(text)
    if most < 3:
        return F.when(F.length(c) <= most, c).otherwise("...")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(most - 3)), F.lit("...")))


def truncate_middle(text: Column | str, most: int) -> Column:
    """At most ``most`` lines: as many from either end, and how many are left out between them."""
    parts, half = line_array(text), most // 2
    gap = F.format_string("\n... %d lines omitted ...\n", F.size(parts) - most)
    # a tail of no lines is, as in slices that end at minus zero, the whole
    tail = F.slice(parts, F.size(parts) - half + 1, F.lit(half)) if half else parts
    cut = F.array_join(F.concat(F.slice(parts, F.lit(1), F.lit(half)), F.array(gap), tail), "\n")
    return F.when(F.size(parts) <= most, _c(text)).otherwise(cut)


def format_size(n: Column | str) -> Column:
    n = _c(n)
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n.cast("double") / 1024))
        .otherwise(F.format_string("%.1f MB", n.cast("double") / (1024 * 1024)))
    )


def compact_path(path: Column | str, most: int = 40) -> Column:
    """Paths over ``most`` characters and three parts: first part, dots, parent and name."""
    c, parts = _c(path), F.split(_c(path), "/")
    short = F.concat_ws("/", F.get(parts, F.lit(0)), F.lit("..."), F.element_at(parts, -2), F.element_at(parts, -1))
    return F.when((F.length(c) > most) & (F.size(parts) > 3), short).otherwise(c)


def directory(path: Column | str) -> Column:
    """Parent folder of a path: ``.`` where it has none, ``/`` at the root; trailing slashes don't count."""
    c = F.regexp_replace(_c(path), "(?<=.)/+$", "")
    parent = F.regexp_extract(c, "^(.*?)/+[^/]*$", 1)
    return F.when(F.instr(c, "/") == 0, ".").when(parent == "", "/").otherwise(parent)


_BETWEEN = re.compile(f"[{BLANKS}]+")


def tokens(line: str) -> frozenset[str]:
    """The distinct tokens between blanks, as ``token_similarity`` has them; none of a blank line."""
    return frozenset(x for x in _BETWEEN.split(line) if x)


def token_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token set; tokens are between blanks."""
    sets = [F.array_distinct(F.split(trimmed(x), BLANK_CLASS + "+")) for x in (a, b)]
    return F.size(F.array_intersect(*sets)) / F.greatest(*(F.size(s) for s in sets))
