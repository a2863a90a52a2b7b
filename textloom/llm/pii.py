"""Personal data: one Aho-Corasick pass finds anchors, deterministic local parsers expand and validate them.

Anchors are at-signs, plus signs, digits, address schemes and account cues (both in any case of A-Z). From an anchor a
parser walks to the boundaries of the candidate and validates it (address parts, Luhn, mod 97, digit counts); no pattern
is run over the whole text. Kinds: email, ip, card, phone; and, added by the method, ``url`` (an address with user
information, or a ``mailto:``/``tel:`` address) and ``account`` (an IBAN, or a number that follows an account cue).

Scale: one map over whole texts, without a shuffle; the time is in proportion to the text, however many anchors fail.
Defined results: null text is empty and has no spans; spans of a kind never overlap; texts of any length are read whole;
each input row gives one row, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
Span = tuple[int, int]

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_BLANK = frozenset(" \t\n\x0b\x0c\r")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
_GAP = frozenset(" :=#.")
#: An IBAN has 34 characters at most, in blocks of four.
LONGEST_IBAN = 42
_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport")


_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for x in ("@", "+", *_DIGITS):
        a.add_word(x, ("digit" if x in _DIGITS else x, 1))
    for kind, forms in (("scheme", _SCHEMES), ("cue", _CUES)):
        for x in forms:
            a.add_word(x, (kind, len(x)))
    a.make_automaton()
    return a


def run_end(text: str, at: int, chars: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for ch in iban[4:] + iban[:4]:
        rest = int(str(rest) + (ch if ch in _DIGITS else str(ord(ch) - 55))) % 97
    return rest == 1


def parse_email(text: str, at: int, least: int) -> Span | None:
    """Around the at-sign at ``at``; nothing before ``least`` belongs to it."""
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = run_end(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := run_end(text, end + 1, _LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def parse_ip(text: str, start: int) -> Span | None:
    """Four numbers joined by dots from ``start``, of whatever size."""
    end = run_end(text, start, _DIGITS)
    for _ in range(3):
        more = run_end(text, end + 1, _DIGITS) if end < len(text) and text[end] == "." else end
        if more <= end + 1:
            return None
        end = more
    return start, end


def parse_card(text: str, start: int) -> Span | None:
    """Digits from ``start``, single blanks or hyphens between them."""
    n, end = len(text), start + 1
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGITS:
            end += 2
        else:
            break
    return (start, end) if end > start + 1 else None


def parse_phone(text: str, plus: int) -> Span | None:
    """From a plus sign and a digit to the last digit of the run of digits, blanks, brackets, dots and hyphens."""
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    end = run_end(text, plus + 2, _PHONE)
    while end > plus + 2 and text[end - 1] not in _DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


class Address:
    """The run without blanks, quotes and angle brackets that an address may reach to; schemes in one run share it."""

    def __init__(self, text: str, start: int) -> None:
        self.text, self.start = text, start
        self.end = start
        while self.end < len(text) and text[self.end] not in _BLANK and text[self.end] not in "<>\"'":
            self.end += 1
        self.trimmed = self.end
        while self.trimmed > start and text[self.trimmed - 1] in ".,;:!?)":
            self.trimmed -= 1
        self.next = {"@": -1, "/": -1}
        self.digits: list[int] | None = None

    def find(self, sign: str, after: int) -> int:
        """The first place of a sign from ``after`` on, else the end."""
        if self.next[sign] < after:
            at = self.text.find(sign, after, self.trimmed)
            self.next[sign] = at if at >= 0 else self.trimmed
        return self.next[sign]

    def digits_from(self, after: int) -> int:
        if self.digits is None:
            self.digits = [0, *accumulate(c in _DIGITS for c in self.text[self.start : self.trimmed])]
        return self.digits[-1] - self.digits[min(after - self.start, len(self.digits) - 1)]

    def parse(self, start: int, after: int) -> Span | None:
        """An address that identifies a person: user information before the host, or a mail or telephone address."""
        end = max(self.trimmed, after)
        scheme = self.text[start:after].lower()
        if scheme == "mailto:":
            ok = self.find("@", after) < end
        elif scheme == "tel:":
            ok = self.digits_from(after) >= 8
        else:
            at, host = self.find("@", after), min(self.find("/", after), end)
            ok = after < at < host - 1
        return (start, end) if ok else None


def parse_account(text: str, after: int) -> Span | None:
    """The IBAN or number of 6 to 18 digits that follows a cue, blanks and signs between them."""
    at = run_end(text, after, _GAP)
    end = at
    while end < len(text) and end - at < LONGEST_IBAN and (text[end] in _ALNUM or text[end] == " " and end + 1 < len(text) and text[end + 1] in _ALNUM):
        end += 1
    packed = text[at:end].replace(" ", "")
    if len(packed) >= 15 and packed[:2].isalpha() and packed[:2].isupper() and packed[2:4].isdigit():
        for size in range(min(34, len(packed)), 14, -1):
            one = packed[:size]
            if one.isascii() and one.isalnum() and one.upper() == one and mod97(one):
                stop, seen = at, 0
                while seen < size:
                    seen += text[stop] != " "
                    stop += 1
                return at, stop
    stop, digits = at, 0
    while stop < len(text) and digits <= 18 and (text[stop] in _DIGITS or text[stop] == "-"):
        digits += text[stop] != "-"
        stop += 1
    while stop > at and text[stop - 1] == "-":
        stop -= 1
    return (at, stop) if 6 <= digits <= 18 and (stop == len(text) or text[stop] not in _ALNUM) else None


_AUTOMATON = _automaton()


def find_spans(text: str) -> dict[str, list[Span]]:
    """All spans of a text, by kind, in order."""
    spans: dict[str, list[Span]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # where the kind's next candidate may begin
    run: Address | None = None
    low = text.lower()
    if len(low) != len(text):  # a letter whose small form has two characters would shift what follows
        low = text.translate(_LOWER)
    for at, (anchor, size) in _AUTOMATON.iter(low):
        if anchor == "digit":
            if at >= past["card"]:
                span = parse_card(text, at)
                past["card"] = span[1] if span else at + 1
                if span and 16 <= len(d := text[span[0] : span[1]].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    spans["card"].append(span)
            if at >= past["ip"]:
                span = parse_ip(text, at)
                past["ip"] = span[1] if span else run_end(text, at, _DIGITS)
                if span and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text[span[0] : span[1]].split(".")):
                    spans["ip"].append(span)
        elif anchor == "@":
            if span := parse_email(text, at, past["email"]):
                past["email"] = span[1]
                spans["email"].append(span)
        elif anchor == "+":
            if at >= past["phone"] and (span := parse_phone(text, at)):
                past["phone"] = span[1]
                if 8 <= sum(c in _DIGITS for c in text[span[0] : span[1]]) <= 15:
                    spans["phone"].append(span)
        elif anchor == "scheme":
            start = at + 1 - size
            if run is None or at + 1 > run.end:
                run = Address(text, at + 1)
            if start >= past["url"] and (span := run.parse(start, at + 1)):
                past["url"] = span[1]
                spans["url"].append(span)
        else:
            start = at + 1 - size
            whole = (start == 0 or text[start - 1] not in _ALNUM) and (at + 1 == len(text) or text[at + 1] not in _ALNUM)
            if whole and start >= past["account"] and (span := parse_account(text, at + 1)):
                past["account"] = span[1]
                spans["account"].append(span)
    return spans


def rendered(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, n_<kind> of the base kinds, base_sha256 and spans (``kind:start:end``) of every row."""
    kept = docs.select(*carry).schema.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [find_spans(text) for text in batch.column(len(kept)).to_pylist()]
            yield (
                {f.name: batch.column(i) for i, f in enumerate(kept)}
                | {f"n_{k}": [len(x[k]) for x in found] for k in BASE}
                | {"base_sha256": [hashlib.sha256(rendered(x, BASE).encode()).hexdigest() for x in found], "spans": [rendered(x, KINDS) for x in found]}
            )

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"n_{k} long" for k in BASE), "base_sha256 string", "spans string"])
    return arrow_map(docs.select(*carry, F.coalesce("text", F.lit("")).alias("text")), run, ddl)


def op8(docs: DataFrame) -> DataFrame:
    return scan(docs)
