"""Command events: a router over (command, output), and what each route makes of the output.

The route is decided by expressions. Line filters and logs are expressions too; the reducers that follow state over
lines run in one Arrow function, which only looks at the rows of its routes. Nothing is shuffled and no state is kept
between events, so the same function serves tables and streams.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import text as T
from . import condense as C

#: What commands are told by (parts of the lower-cased command).
TEST_RUNS = ("vitest", "jest", "pytest", "cargo test", "npm test", "npx vitest", "bun test", "go test", "mocha")
LINT_ROUTE = ("eslint", "prettier --check", "tsc --noemit")
LINT_TOOLS = ("eslint", "prettier", "ruff", "pylint", "mypy", "flake8", "black", "clippy", "golangci-lint")
BUILD_ROUTE = ("tsc", "cargo build", "cargo check", "cargo test", "npm run build")
BUILD_TOOLS = ("make", "cmake", "gradle", "./gradlew", "mvn")
DOCKER = ("docker build", "docker compose build", "docker buildx build", "docker buildx bake")
INSTALLS = r"^(?:npm\s+(?:install|i|ci)(?:\s|$)|yarn\s*$|yarn\s+(?:install|add)(?:\s|$)|pnpm\s+(?:install|i|add)(?:\s|$))"

#: Lines that carry nothing, and lines that are kept all the same.
BUILD_NOISE = (
    r"make\[\d+\]: (?:Entering|Leaving) directory|^\s*\[\s*\d+%\]|^>\s+Task\s+:|^\[INFO\]\s+(?:Downloading|Compiling|Building|Unpacking)|^:\w+$"
)
BUILD_SIGNAL = r"(?i:error:|warning:)|\[ERROR\]|\[WARNING\]|make: \*\*\*|BUILD (?:SUCCESSFUL|FAILED|SUCCESS|FAILURE)"
TRANSFER_NOISE = (
    r"^\s+[\d,]+\s+\d+%|\(\s*xfr#\d+|\d+%\s+\d+\s+[\d.]+[KMGkmg]B/s|^(?:sending|receiving) incremental file list$|^(?!(?i:done|transfer-complete)$)[\w./\-]+$"
)
TRANSFER_SIGNAL = r"sent .* bytes|(?i:permission denied|connection refused|no such file|error)"
INSTALL_NOISE = r"[⸩⠋⠹]|^(?i:npm\s+http\b|npm\s+timing\b|resolution\s+step\s+details:)"
INSTALL_SIGNAL = (
    r"(?i:\badded\b|\bremoved\b|\bup to date\b|\baudited\b|\berror\b|\bin\s+\d+(?:\.\d+)?(?:ms|s|m)\b|^done in\s+\d+(?:\.\d+)?s\.?$)|WARN|ERR!"
)
DOCKER_NOISE = r"^---> (?:[0-9a-f]{8,}|Running in)|^Removing intermediate container|^Sending build context"
DOCKER_SIGNAL = r"^(?i:step \d+/\d+\s*:|successfully built|successfully tagged|writing image|naming to|error|erro|fatal|warning|warn)|ERROR"
SHORT = 10


def _any(command: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(command, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(command, F.lit(p))
    return out


def _first_word(command: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | (command == w) | F.startswith(command, F.lit(w + " "))
    return out


def _kept(output: Column, keep, shape=lambda x: x) -> Column:  # noqa: ANN001
    """The lines that ``keep`` holds for; short outputs as they are; null where nothing but blanks is left."""
    parts = T.line_array(output)
    left = F.filter(F.transform(parts, shape), keep)
    whole = F.array_join(left, "\n")
    return F.when(output == "", None).when(F.size(parts) < SHORT, output).when(T.trimmed(whole) != "", whole)


def condensed_log(output: Column) -> Column:
    """The first lines, each cut to width, and how many more there are."""
    parts = T.line_array(output)
    shown = F.transform(F.slice(parts, F.lit(1), F.lit(C.LOG_LINES)), lambda x: T.truncate(x, C.LOG_WIDTH))
    more = F.array(F.format_string("... and %d more commits", F.size(parts) - C.LOG_LINES))
    return F.array_join(F.when(F.size(parts) > C.LOG_LINES, F.concat(shown, more)).otherwise(shown), "\n")


#: Reducers that follow state over lines, by route.
REDUCERS = {
    "git diff": lambda c, o: C.condensed_diff(o), "git status": lambda c, o: C.condensed_status(o), "lint": lambda c, o: C.condensed_lint(o, c),
    "lint strict": lambda c, o: C.condensed_lint(o, c, True), "build": lambda c, o: C.condensed_build(o), "build strict": lambda c, o: C.condensed_build(o, True),
    "listing": lambda c, o: C.condensed_listing(o), "http": lambda c, o: C.condensed_http(o),
}


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("failed", BooleanType())]))
def _stateful(route: pa.Array, command: pa.Array, output: pa.Array) -> pa.Array:
    """Of rows with an output (null: another route's); a reducer that fails leaves the output as it was, and says so."""
    texts, failed = [], []
    for r, c, o in zip(route.to_pylist(), command, output, strict=True):
        text, broke = None, False
        if o.is_valid and r in REDUCERS:
            try:
                text = REDUCERS[r](c.as_py(), o.as_py())
            except Exception:
                broke = True
        texts.append(text)
        failed.append(broke)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(failed, pa.bool_())], names=["text", "failed"])


def routed(events: DataFrame, strict: bool = False) -> DataFrame:
    """Adds stripped (no escape sequences) and route to ``events`` (command, output)."""
    raw = F.coalesce("command", F.lit(""))
    low, tight = F.lower(raw), T.trimmed(F.lower(raw))
    d = events.withColumn("stripped", T.strip_ansi(F.coalesce("output", F.lit(""))))
    out = F.col("stripped")
    filters = {
        "build tools": (_first_word(tight, BUILD_TOOLS), _kept(out, lambda x: x.rlike(BUILD_SIGNAL) | ~x.rlike(BUILD_NOISE))),
        "install": (tight.rlike(INSTALLS), _kept(out, lambda x: ~x.rlike(INSTALL_NOISE) & x.rlike(INSTALL_SIGNAL))),
        "docker": (_starts_or_follows(tight, DOCKER), _kept(out, lambda x: ~x.rlike(DOCKER_NOISE) & x.rlike(DOCKER_SIGNAL), T.trimmed)),
        "transfer": (_first_word(tight, ("scp", "rsync")), _kept(out, lambda x: x.rlike(TRANSFER_SIGNAL) | ~x.rlike(TRANSFER_NOISE))),
    }
    for name, (applies, text) in filters.items():
        d = d.withColumn(f"_{name}", F.when(applies, text))
    git = T.trimmed(low).rlike("^git(?: |$)")
    list_flags = r"(?:^|\s)-[a-z]*[rl]"
    mode = " strict" if strict else ""
    route = (
        F.when(F.coalesce("output", F.lit("")) == "", "empty").when(_any(low, TEST_RUNS), "test")
        .when(git & F.startswith(low, F.lit("git diff")), "git diff").when(git & F.startswith(low, F.lit("git status")), "git status")
        .when(git & F.startswith(low, F.lit("git log")), "git log")
        .when(_any(low, LINT_ROUTE) & _any(low, LINT_TOOLS), "lint" + mode)
        .when(F.col("_build tools").isNotNull(), "build tools")
        .when(_any(low, BUILD_ROUTE), "build" + mode)
        .when(F.col("_install").isNotNull(), "install").when(F.col("_docker").isNotNull(), "docker")
        .when(_first_word(tight, ("find", "tree")) | (F.startswith(tight, F.lit("ls ")) & F.substr(tight, F.lit(4)).rlike(list_flags)), "listing")
        .when(_first_word(tight, ("curl", "wget", "http")), "http")
        .when(F.col("_transfer").isNotNull(), "transfer").otherwise("none")
    )
    return d.withColumn("route", route)


def _starts_or_follows(command: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.startswith(command, F.lit(p)) | F.contains(command, F.lit(" " + p))
    return out


def condensed(events: DataFrame, strict: bool = False) -> DataFrame:
    """``events`` with route, status (``ok``, or ``failed`` where a reducer broke), condensed and saved (UTF-16 units fewer
    than ``output``).

    strict: lint and build reports in forms that are otherwise passed over as clean are read too.
    """
    d = routed(events, strict)
    d = d.withColumn("_state", _stateful("route", F.coalesce("command", F.lit("")), F.when(F.col("route").isin(*REDUCERS), F.col("stripped"))))
    made = F.coalesce(
        F.when(F.col("route") == "git log", condensed_log(F.col("stripped"))), F.col("_state.text"),
        *(F.when(F.col("route") == n, F.col(f"_{n}")) for n in ("build tools", "install", "docker", "transfer")),
        F.col("stripped"),
    )
    d = d.withColumn("condensed", made)
    saved = T.utf16_length(F.coalesce("output", F.lit(""))) - T.utf16_length("condensed")
    return d.select(*events.columns, "route", F.when(F.col("_state.failed"), "failed").otherwise("ok").alias("status"), "condensed", saved.cast("long").alias("saved"))


@F.arrow_udf(StringType())
def _tests(command: pa.Array, output: pa.Array) -> pa.Array:
    return pa.array([C.condensed_tests(o.as_py() or "", c.as_py() or "") for c, o in zip(command, output, strict=True)], pa.string())


def test_summaries(events: DataFrame) -> DataFrame:
    """``events`` with summary: what a test run comes to, or null where the command is none. The router doesn't use it."""
    return events.withColumn("summary", _tests("command", T.strip_ansi("output")))


#: Issues in reports, for aggregation over many events.
ISSUE_AT_START = r"^(.+):(\d+):(\d+):\s*(.+)$"
ISSUE_AT_END = r"^(error|warning):\s*(.+?)\s+at\s+(.+):(\d+):(\d+)$"


def lint_issues(events: DataFrame, key: str = "event_id") -> DataFrame:
    """key, position, severity, rule, file, line, message of each reported issue; lines are parsed by expressions."""
    d = events.select(key, F.posexplode(T.line_array(T.strip_ansi("output"))).alias("position", "x"))
    a, b = F.col("x").rlike(ISSUE_AT_START), F.col("x").rlike(ISSUE_AT_END)
    get = lambda p, i: F.regexp_extract("x", p, i)
    message = F.when(a, get(ISSUE_AT_START, 4)).otherwise(get(ISSUE_AT_END, 2))
    rule = F.regexp_extract(message, r"\[(.+?)\]$", 1)
    return d.where(a | b).select(
        key, "position", F.when(a, "ERROR").otherwise(F.upper(get(ISSUE_AT_END, 1))).alias("severity"), F.when(rule == "", "unknown").otherwise(rule).alias("rule"),
        F.when(a, get(ISSUE_AT_START, 1)).otherwise(get(ISSUE_AT_END, 3)).alias("file"),
        F.when(a, get(ISSUE_AT_START, 2)).otherwise(get(ISSUE_AT_END, 4)).cast("int").alias("line"), message.alias("message"),
    )


def top_counts(issues: DataFrame, of: str, most: int = 10, key: str = "event_id") -> DataFrame:
    """``of`` and n of the most frequent values; ties by first appearance."""
    d = issues.groupBy(of).agg(F.count("*").alias("n"), F.min(F.struct(key, "position")).alias("first"))
    return d.orderBy(F.desc("n"), "first").limit(most).select(of, "n")
