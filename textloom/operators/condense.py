"""Condensing one command's output: the reducers that follow state over lines. Plain functions from text to text."""

from __future__ import annotations

import re
from collections import Counter

#: The sizes of the condensed forms.
DIFF_LINES, HUNK_CONTEXT, LOG_LINES, LOG_WIDTH, BODY_LINES, TAIL_CHARS = 100, 3, 20, 80, 200, 8000


def condensed_diff(text: str, most: int = DIFF_LINES) -> str:
    """A unified diff by file and hunk, with little context, change counts, and a cap on the whole."""
    shown: list[str] = []
    name, counts, hunk = "", [0, 0], None

    def close_hunk() -> None:
        nonlocal hunk
        lines, hunk = hunk or [], None if hunk is None else []
        at = [i for i, x in enumerate(lines) if x[:1] in ("+", "-")]
        first, last = (at[0], at[-1] + 1) if at else (len(lines), len(lines))
        lead, trail = lines[:first], lines[last:]
        dropped = "  ... ({} context lines)".format
        if len(lead) > HUNK_CONTEXT:
            shown.append(dropped(len(lead) - HUNK_CONTEXT))
        shown.extend(f"  {x}" for x in lead[-HUNK_CONTEXT:] + lines[first:last] + trail[:HUNK_CONTEXT])
        if len(trail) > HUNK_CONTEXT:
            shown.append(dropped(len(trail) - HUNK_CONTEXT))

    def close_file() -> None:
        close_hunk()
        if name and any(counts):
            shown.append(f"  +{counts[0]} -{counts[1]}")

    for line in text.split("\n"):
        if line.startswith("diff --git"):
            close_file()
            found = re.search(r"diff --git a/(.+) b/(.+)", line)
            name, counts, hunk = found[2] if found else "unknown", [0, 0], None
            shown.append(f"\n📄 {name}")
        elif line.startswith("@@"):
            close_hunk()
            found = re.search(r"@@ .+ @@", line)
            shown.append(f"  {found[0] if found else '@@'}")
            hunk = []
        elif hunk is not None and not line.startswith(("---", "+++", "\\\\")):
            hunk.append(line)
            if line[:1] in ("+", "-"):
                counts[line[0] == "-"] += 1
    close_file()
    return "\n".join(_capped(shown, most))


def _capped(shown: list[str], most: int) -> list[str]:
    """Changes from the middle go first; if those aren't enough, all lines from the middle."""
    over = len(shown) - most
    if over <= 0:
        return shown
    changes = [i for i, x in enumerate(shown) if x.lstrip()[:1] in ("+", "-") and not re.fullmatch(r"\+\d+ -\d+", x.lstrip())]
    if len(changes) > over:
        keep = len(changes) - over
        ahead = (keep + 1) // 2
        start, end = changes[ahead], changes[len(changes) - (keep - ahead) - 1] + 1
    else:
        half = (most - 1) // 2
        start, end = half, len(shown) - half
    return [*shown[:start], f"  ... +{end - start} more changes", *shown[end:]]


def condensed_status(text: str) -> str:
    """Short-format status: branch, and counts with the first names of each group."""
    lines = text.split("\n")
    if len(lines) == 1 and not lines[0].strip():
        return "Clean working tree"
    branch, conflicts = "", 0
    groups: dict[str, list[str]] = {"✅ Staged": [], "📝 Modified": [], "❓ Untracked": []}
    for line in lines:
        if line.startswith("##"):
            found = re.search(r"## (.+)", line)
            branch = found[1].split("...")[0] if found else branch
        elif len(line) >= 3:
            index, tree, file = line[0], line[1], line[3:]
            conflicts += index == "U"
            for group, belongs in (("✅ Staged", index in "MADRC"), ("📝 Modified", tree in "MD"), ("❓ Untracked", line[:2] == "??")):
                if belongs:
                    groups[group].append(file)
    out = [f"📌 {branch}"]
    for group, files in groups.items():
        most = 3 if "Untracked" in group else 5
        if files:
            out += [f"{group}: {len(files)} files", *(f"  {x}" for x in files[:most])]
        if len(files) > most:
            out.append(f"  ... +{len(files) - most} more")
    if conflicts:
        out.append(f"⚠️  Conflicts: {conflicts} files")
    return "\n".join(out).strip()


#: Names of linters by what their command holds, in this order.
LINTERS = (
    ("eslint", "ESLint"), ("ruff", "Ruff"), ("pylint", "Pylint"), ("mypy", "MyPy"), ("flake8", "Flake8"), ("clippy", "Clippy"),
    ("golangci", "GolangCI-Lint"), ("prettier", "Prettier"),
)
_AT_START = re.compile(r"(.+):(\d+):(\d+):\s*(.+)")
_AT_END = re.compile(r"(error|warning):\s*(.+?)\s+at\s+(.+):(\d+):(\d+)")
_STYLISH = re.compile(r"\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)(?:\s{2,}(\S+))?")
_COMPILER = re.compile(r"(.+)\((\d+),(\d+)\):\s*(error|warning)\s+(\S+):\s*(.+)")
Issue = tuple[str, str, str, int, str]


def lint_issues(text: str, strict: bool = False) -> list[Issue]:
    """(severity, rule, file, line, message) of each line that reports one.

    strict: also reads reports grouped under file names, and compilers' ``file(line,column)``.
    """
    out, heading = [], ""
    for line in text.split("\n"):
        rule = lambda message: (m[1] if (m := re.search(r"\[(.+?)\]$", message)) else "unknown")
        if m := _AT_START.fullmatch(line):
            out.append(("ERROR", rule(m[4]), m[1], int(m[2]), m[4]))
        elif m := _AT_END.fullmatch(line):
            out.append((m[1].upper(), rule(m[2]), m[3], int(m[4]), m[2]))
        elif strict and (m := _STYLISH.fullmatch(line)):
            out.append((m[3].upper(), m[5] or "unknown", heading, int(m[1]), m[4]))
        elif strict and (m := _COMPILER.fullmatch(line)):
            out.append((m[4].upper(), m[5], m[1], int(m[2]), m[6]))
        elif line and not line[0].isspace():
            heading = line
    return out


def short_path(path: str, most: int = 40) -> str:
    parts = path.split("/")
    return path if len(path) <= most or len(parts) <= 3 else "/".join((parts[0], "...", *parts[-2:]))


def condensed_lint(text: str, command: str, strict: bool = False) -> str:
    """Counts by severity, rule and file; ties stay in the order in which they first came."""
    tool = next((name for key, name in LINTERS if key in command.lower()), "Linter")
    issues = lint_issues(text, strict)
    if not issues:
        return f"✓ {tool}: No issues found"
    errors = sum(i[0] == "ERROR" for i in issues)
    files = Counter(i[2] for i in issues)
    out = [f"{tool}: {errors} errors, {len(issues) - errors} warnings in {len(files)} files", "═" * 39, "Top rules:"]
    out += [f"  {rule} ({n}x)" for rule, n in Counter(i[1] for i in issues).most_common(10)]
    out += ["", "Top files:"]
    for file, n in files.most_common(10):
        out.append(f"  {short_path(file)} ({n} issues)")
        out += [f"    {rule} ({k})" for rule, k in Counter(i[1] for i in issues if i[2] == file).most_common(3)]
    return "\n".join(out) + "\n"


_UNIT = re.compile(r"\s*(?:Compiling|Checking|Building)\s+")
_PROGRESS = re.compile(r"\s*(?:Compiling|Checking|Downloading|Downloaded|Fetching|Fetched|Updating|Updated|Building|Generated|Creating|Running)\s+")
_ERROR = re.compile(r"error\[|error:|\[ERROR\]|FAIL")
_COMPILER_ERROR = re.compile(r".+\(\d+,\d+\): error ")
_WARNING = re.compile(r"warning:|\[WARNING\]|warn:")


def build_blocks(text: str, strict: bool = False) -> tuple[int, list[list[str]], int]:
    """Units compiled, error blocks, and how many warnings.

    A block goes on over indented lines, ``-->`` and blank lines, but not over a second blank line once it has more
    than three lines. Progress and warning lines don't end it.
    """
    units, warnings, blocks = 0, 0, []
    block: list[str] | None = None
    blanks = 0
    for line in text.split("\n"):
        if _UNIT.match(line):
            units += 1
        elif _PROGRESS.match(line):
            continue
        elif _ERROR.match(line) or strict and _COMPILER_ERROR.match(line):
            block, blanks = [line], 0
            blocks.append(block)
        elif _WARNING.match(line):
            warnings += 1
        elif block is None:
            continue
        elif not line.strip():
            blanks += 1
            if blanks >= 2 and len(block) > 3:
                block = None
            else:
                block.append(line)
        elif line[0].isspace() or line.startswith("-->"):
            block.append(line)
            blanks = 0
        else:
            block = None
    return units, blocks, warnings


def condensed_build(text: str, strict: bool = False) -> str:
    units, blocks, warnings = build_blocks(text, strict)
    if not blocks and not warnings:
        return f"✓ Build successful ({units} units compiled)"
    out = [f"❌ {len(blocks)} error(s):"] if blocks else []
    for block in blocks[:5]:
        out += block[:10] + ["  ..."] * (len(block) > 10)
    if len(blocks) > 5:
        out.append(f"... and {len(blocks) - 5} more errors")
    if warnings:
        out.append(f"\n⚠️  {warnings} warning(s)")
    return "\n".join(out)


def parent(path: str) -> str:
    """The folder of a path, by the rules of POSIX path names."""
    bare = path.rstrip("/") if path.strip("/") else path[:1]
    if "/" not in bare:
        return "."
    return bare.rpartition("/")[0].rstrip("/") or "/"


def condensed_listing(text: str, most: int = 100) -> str:
    """Files counted by folder, most first; complaints are kept, ahead of the counts."""
    lines = text.split("\n")
    if len(lines) <= most:
        return text
    complaints, folders = [], Counter()
    for line in filter(None, (x.strip() for x in lines)):
        if "Permission denied" in line or "No such file" in line or line.startswith(("find:", "ls:")):
            complaints.append(line)
        else:
            folders[parent(line)] += 1
    out = [*complaints, ""] if complaints else []
    out += [f"{folder}/ ({n} files)" for folder, n in folders.most_common()]
    return "\n".join([*out, "", f"Total: {folders.total()} files in {len(folders)} directories"])


_TRANSFERRED = re.compile(r"\s*%\s+Total|\s*\d+\s+\d+\s+\d+\s+\d+\s+\d+\s+\d+")
_CHUNKS = re.compile(r"\s*\d+K\s+\.")
_HEADER = re.compile(r"(?:HTTP/|< HTTP/|Content-|Host:)", re.I)


def condensed_http(text: str) -> str:
    """Without progress meters; of the body (all lines, if no headers are seen) the first BODY_LINES."""
    lines = text.split("\n")
    if len(lines) < 10:
        return text
    lines = [x for x in lines if not (_TRANSFERRED.match(x) or _CHUNKS.match(x) or re.search(r"Dload\s+Upload", x))]
    header = next((i for i, x in enumerate(lines) if _HEADER.match(x.strip())), len(lines))
    body = next((i + 1 for i in range(header + 1, len(lines)) if not lines[i].strip()), 0)
    cut = len(lines) - body - BODY_LINES
    return "\n".join(lines[: body + BODY_LINES] + [f"[... {cut} more lines]"] if cut > 0 else lines)


#: How test runners report, tried in this order.
_RESULTS = (
    r"test result:\s*(\w+)\.\s*(\d+)\s*passed;\s*(\d+)\s*failed;",
    r"(?i)(\d+)\s*passed(?:,\s*(\d+)\s*failed)?(?:,\s*(\d+)\s*skipped)?",
    r"(?i)(\d+)\s*pass(?:,\s*(\d+)\s*fail)?(?:,\s*(\d+)\s*skip)?",
    r"(?i)tests?:\s*(\d+)\s*passed(?:,\s*(\d+)\s*failed)?(?:,\s*(\d+)\s*skipped)?",
)
_RUNNERS = ("test", "jest", "vitest", "pytest", "mocha", "ava", "tap")


def is_test_run(command: str) -> bool:
    """Judged by the words before the first option or quotation."""
    words = command.lower().split()
    stop = next((i for i, w in enumerate(words) if w[0] in "-\"'"), len(words))
    return any(r in " ".join(words[:stop]) for r in _RUNNERS)


def test_counts(text: str) -> tuple[int, int, int]:
    """Passed, failed, skipped."""
    number = lambda x: int(x) if x and x.isdigit() else 0
    counts = [0, 0, 0]
    for pattern in _RESULTS:
        if m := re.search(pattern, text):
            counts = [number(x) for x in (*m.groups(), None)[:3]]
            break
    if not counts[1] and (m := re.search(r"(?i)(\d+)\s*failed", text)):
        counts[1] = int(m[1])
    if not counts[0] and not counts[1]:
        lines = text.split("\n")
        # ASCII word boundaries: the signs count only next to a word character
        counts[0] = sum(bool(re.search(r"(?a)\b(?:ok|PASS|✓|✔)\b", x)) for x in lines)
        counts[1] = sum(bool(re.search(r"(?a)\b(?:FAIL|fail|✗|✕)\b", x)) for x in lines)
    return counts[0], counts[1], counts[2]


def condensed_tests(text: str, command: str) -> str | None:
    """A summary where all passed; where any failed, the end of the output. None where it isn't a test run."""
    if not is_test_run(command) or "| cat" in command:
        return None
    passed, failed, skipped = test_counts(text)
    if not failed:
        return "\n".join(["📋 Test Results:", f"   ✅ {passed} passed"] + [f"   ⏭️  {skipped} skipped"] * (skipped > 0))
    if len(text) <= TAIL_CHARS:
        return text
    tail = text[-TAIL_CHARS:]
    return f"... (output truncated, showing last {TAIL_CHARS} chars)\n{tail.partition(chr(10))[2] if chr(10) in tail else tail}"
