"""Outlines of data files: CSV, JSON, JSON Lines, session logs, YAML, TOML."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from datetime import UTC, datetime

from .model import Outline, Symbol

SHOWN = 10


def csv_cells(line: str, delimiter: str) -> list[str]:
    """Cells of one line: quotes group, doubled quotes are one, blanks around a cell go."""
    cells = re.findall(rf'((?:"(?:[^"]|"")*(?:"|$)|[^{re.escape(delimiter)}"])*)(?:{re.escape(delimiter)}|$)', line)
    if not line.endswith(delimiter) and len(cells) > 1:
        cells.pop()  # the empty match at the end
    unquote = lambda m: m[1].replace('""', '"')
    return [re.sub(r'"((?:[^"]|"")*)(?:"|$)', unquote, c).strip() for c in cells]


def csv(text: str, name: str = "") -> Outline | None:
    lines = [x for x in re.split(r"\r?\n", text) if x.strip()]
    if not lines:
        return None
    tab = lines[0].count("\t") > lines[0].count(",")
    sep, total = "\t" if tab else ",", text.count("\n") + 1
    head = csv_cells(lines[0], sep)
    symbols = [Symbol(f"{len(lines) - 1} rows × {len(head)} columns", "table", 1, total)]
    symbols += [Symbol(h or f"Column {i}", "property", 1, 1, f"Column {i} of {len(head)}") for i, h in enumerate(head, 1)]
    if len(lines) > 1:
        cut = [c if len(c) <= 20 else c[:17] + "..." for c in csv_cells(lines[1], sep)[:5]]
        symbols.append(Symbol("Sample: " + (" | " if tab else ", ").join(cut), "variable", 2, 2))
    return Outline("TSV" if tab or name.endswith(".tsv") else "CSV", total, symbols)


def type_name(value: object) -> str:
    if isinstance(value, list):
        if not value:
            return "[]"
        inner = {dict: "{...}", list: "[...]"}.get(type(value[0])) or type_name(value[0])
        return f"[]({len(value)}) {inner}"
    if isinstance(value, dict):
        return "{...}"
    return {bool: "boolean", str: "string", type(None): "null"}.get(type(value), "number")


def json_outline(text: str, name: str = "") -> Outline | None:
    """One level of keys and types; of an array its first element. Lines are running estimates."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    prefix = ""
    if isinstance(value, list) and value:
        prefix, value = "[].", value[0]
        if not isinstance(value, dict):
            return Outline("JSON", text.count("\n") or 1, [Symbol(f"[]: {type_name(value)}", "variable", 1, 1)])
    if isinstance(value, dict):
        names = [f"{prefix}{k}: {type_name(v)}" for k, v in value.items() if prefix == "" or k != "_count"]
    else:  # a scalar's type is read as an object of its characters
        names = [f"{i}: {c}" for i, c in enumerate(type_name(value))]
    return Outline("JSON", text.count("\n") or 1, [Symbol(n, "variable", i, i) for i, n in enumerate(names, 1)])


def _entries(text: str) -> list[str]:
    lines = re.split(r"\r\n|\n|\r", text)
    return lines[:-1] if lines[-1] == "" else lines


def jsonl(text: str, name: str = "") -> Outline | None:
    lines = _entries(text)
    if lines:
        head = _object(lines[0])
        if head.get("type") == "session" and "cwd" in head and "timestamp" in head:
            return session(lines, head)
    samples: list[tuple[int, str]] = []
    schema = None
    for i, line in enumerate(lines[:100], 1):
        if len(samples) == 10 or not line.strip():
            continue
        try:
            value = json.loads(line)
        except ValueError:
            continue
        samples.append((i, line if len(line) <= 80 else line[:80] + "..."))
        if schema is None:
            keys = list(value) if isinstance(value, dict) else []
            kind = "object" if isinstance(value, dict) else f"array[{len(value)}]" if isinstance(value, list) else type_name(value)
            listed = ", ".join(keys[:5]) + "..." * (len(keys) > 5)
            schema = f"Schema: {kind}" + (f" {{{listed}}}" if keys else "")
    symbols = [Symbol(schema, "class", 1, 1)] if schema else []
    symbols += [Symbol(f"Line {i}: {preview}", "variable", i, i) for i, preview in samples[:5]]
    if len(lines) > len(samples):  # counts what was looked at, though fewer are shown
        symbols.append(Symbol(f"... {len(lines) - len(samples)} more lines", "variable", len(samples) + 1, len(lines)))
    return Outline("JSON Lines", len(lines), symbols)


def _object(line: str) -> dict:
    try:
        value = json.loads(line)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def preview(content: object, most: int = 80) -> str:
    """A message's text, or its first text block, on one line."""
    if isinstance(content, list):
        content = next((b["text"] for b in content if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str)), "")
    line = re.sub(r"\s+", " ", content).strip() if isinstance(content, str) else ""
    return line if len(line) <= most else line[: most - 3] + "..."


def minute(timestamp: str) -> str:
    try:
        at = datetime.fromisoformat(timestamp)
    except (TypeError, ValueError):
        return timestamp
    return f"{(at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC):%Y-%m-%d %H:%M} UTC"


#: What the statistics line names, in this order.
COUNTED = ("user", "assistant", "tool results", "compaction", "branch summary", "model change")
_COUNTS_AS = {"toolResult": "tool results", "branch_summary": "branch summary", "model_change": "model change"}


def session(lines: list[str], head: dict) -> Outline:
    """User turns span to the line before the next turn, compaction or branch summary."""
    counts = dict.fromkeys(COUNTED, 0)
    symbols: list[Symbol] = []
    turn: Symbol | None = None
    for i, line in enumerate(lines[1:], 2):
        entry = _object(line)
        kind = entry.get("type")
        message = entry.get("message") if isinstance(entry.get("message"), dict) else {}
        what = message.get("role") if kind == "message" else kind
        label = _COUNTS_AS.get(what, what)
        if label in counts:
            counts[label] += 1
        is_user = kind == "message" and what == "user"
        if turn and (is_user or kind in ("compaction", "branch_summary")):
            turn.end, turn = i - 1, None
        if is_user:
            turn = Symbol(f"[User] {preview(message.get('content'))}", "function", i, i)
            symbols.append(turn)
        elif kind in ("compaction", "branch_summary"):
            symbols.append(Symbol("[Compaction]" if kind == "compaction" else "[Branch Summary]", "namespace", i, i))
        elif kind == "model_change":
            symbols.append(Symbol("[Model] " + ("/".join(x for x in (entry.get("provider"), entry.get("modelId")) if x) or "unknown"), "namespace", i, i))
        elif kind == "session_info" and entry.get("name"):
            symbols.append(Symbol(f"[Session] {entry['name']}", "property", i, i))
    if turn:
        turn.end = len(lines)
    shown = ", ".join(f"{n} {what}" for what, n in counts.items() if n)
    top = [Symbol(f"Session: {head['cwd']} ({minute(head['timestamp'])})", "module", 1, 1), Symbol(f"Stats: {shown}", "property", 1, len(lines))]
    return Outline("Session log", len(lines), top + symbols)


_YAML_KEY = re.compile(r"(\s*)(-\s+)?([a-zA-Z_][\w.-]*)\s*:", re.A)


def yaml(text: str, name: str = "") -> Outline | None:
    total = text.count("\n") + 1
    keys = []  # (indent, line, name, is an array's item)
    for i, line in enumerate(re.split(r"\r?\n", text), 1):
        if not line.startswith(("---", "...")) and (m := _YAML_KEY.match(line)):
            keys.append((len(m[1]) + 2 * bool(m[2]), i, m[3], bool(m[2])))
    if not keys:
        return None
    least = 0 if any(k[0] == 0 for k in keys) else min(k[0] for k in keys)
    roots = [k for k in keys if k[0] == least]
    symbols = []
    nested = [k for k in keys if 0 < k[0] <= 4] if least == 0 else []
    for root, stop in zip(roots, [k[1] for k in roots[1:]] + [total + 1], strict=True):
        first = bisect_right(nested, root[1], key=lambda k: k[1])
        inner = [k for k in nested[first : first + SHOWN] if k[1] < stop]
        children = [Symbol(k[2], "variable" if k[3] else "property", k[1], k[1]) for k in inner]
        symbols.append(Symbol(root[2], "property", root[1], stop - 1, children=children))
    return Outline("YAML", total, symbols)


_TOML_HEAD = re.compile(r"(\[\[([^\]]+)\]\]|\[([^\]]+)\])\s*(?:#.*)?")
_TOML_KEY = re.compile(r"([a-zA-Z_][\w.-]*)\s*=", re.A)


def toml(text: str, name: str = "") -> Outline | None:
    total = text.count("\n") + 1
    top: list[Symbol] = []
    sections: list[Symbol] = []
    for i, line in enumerate(re.split(r"\r?\n", text), 1):
        line = line.strip()
        if m := _TOML_HEAD.fullmatch(line):
            if sections:
                sections[-1].end = i - 1
            sections.append(Symbol(f"[[{m[2]}]]" if m[2] else f"[{m[3]}]", "variable" if m[2] else "class", i, total))
        elif not line.startswith("#") and (m := _TOML_KEY.match(line)):
            into = sections[-1].children if sections else top
            if len(into) < SHOWN:
                into.append(Symbol(m[1], "property", i, i))
    return Outline("TOML", total, top + sections) if top or sections else None
