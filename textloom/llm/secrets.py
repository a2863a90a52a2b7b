"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are whole private key blocks, runs of token characters with at least two digits, key formats of fixed prefix,
and values of six or more characters behind a cue or an assignment, in quotes or not (quoted ones behind a cue may hold blanks), and the
user part of addresses. Each gets its length, character transitions, distinct characters, dictionary coverage, the path of its
document, and the neighbouring words. The forest is trained on the driver from labelled findings (a bounded table; the
default one is generated by rule) and emitted as conditional expressions.

Everything on documents is DataFrame expressions over one row: no shuffle, no explode before the last step. A text
without a candidate is not split. Redaction joins the pieces between candidates again, so it needs no positions.

Defined results: null text has no candidate and stays null; candidates never overlap; each row is scanned for itself,
repeated rows too; extra columns are kept by ``redact`` and ignored by ``findings``.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = r"[A-Za-z0-9+/_.~-]"
_NO_DIGIT = r"[A-Za-z+/_.~-]"
_CUES = "passw(?:or)?d|passwd|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|mot.?de.?passe|kennwort|contrase"
_CUE = f"(?i)(?:{_CUES})"
#: What may stand between a cue or an assignment and its value, up to the quote.
_LEAD = rf"(?:[=:]>?\s{{0,3}}|(?i:{_CUES})[A-Za-z0-9_]{{0,12}}\s{{1,2}}(?:is\s{{1,2}})?)"
#: Where a value may start: not at a cue's own name before its assignment, nor at a scheme or what follows it.
_NAMED = rf"[\w.-]{{0,20}}(?i:{_CUES})[\w.-]{{0,20}}\\?[\"'`]?\s{{0,3}}[=:]|[A-Za-z][A-Za-z0-9+.-]*+://"
_START = rf"(?![=:>\\]|//|(?i:bearer|basic)\s|{_NAMED})"
_PART = r"[^\s\"'`&;,]+"
_BARE = rf"{_START}(?=[^\s\"'`]{{6}}){_PART}(?:[&;,](?![\w.-]{{1,40}}[=:]){_PART})*+(?<![.:)\]}}>\\])"
#: A block runs to its own end mark, whatever headers it has; any other mark ends it.
_BLOCK = r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY|PRIVATE KEY BLOCK)-----(?:[^-]++|-(?!----))*+-----END [A-Z ]*+(?<=PRIVATE KEY|PRIVATE KEY BLOCK)-----"
#: What keys of known services start with.
_KNOWN = r"(?:gh[pousr]_|github_pat_|glpat-|hf_|npm_|pypi-|xox[abeoprs]-|sk-|[sr]k_live_|shpat_|dop_v1_|SG\.|AIza)"
_HOOK = r"hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9/_-]+"
#: What a candidate may begin with that isn't part of the secret: a run of blanks, or a cue with its sign and quote.
_CUED = rf"(?i:{_CUES})[A-Za-z0-9_]*+\\?[\"'`]?\s*+[=:]>?\s*+\\?[\"'`]"
_LEADING = rf"^(?:\s++\\?[\"'`]?|{_CUED})"
#: A candidate: a key block; a value in quotes or bare, behind a cue or an assignment; quoted words behind a cue; what
#: stands before the @ of an address with a scheme; a whole run with two digits; a key of known form.
CANDIDATE = (
    rf"{_BLOCK}"
    rf"|(?<=://)[^\s/@:\"'`<>]*+:[^\s/@\"'`<>]++(?=@)"
    rf"|(?<=[\"'`])(?<={_LEAD}\\?[\"'`])(?!{_NAMED})[^\s\"'`]{{5,}}[^\s\"'`\\](?=\\?[\"'`])"
    rf"|(?<=[\s=:>\"'`])(?<={_LEAD}\\?[\"'`]?){_BARE}"
    rf"|(?<=[=:]|[=:]>)\s{{4,}}+\\?(?:[\"'`](?=[^\"'`\n]{{6}})[^\"'`\n]++(?=[\"'`])|{_BARE})"
    rf"|{_CUED}(?=[^\"'`\n]{{6}})[^\"'`\n]++(?=[\"'`])"
    rf"|(?<![A-Za-z0-9]){_KNOWN}[A-Za-z0-9_.-]{{16,}}|{_HOOK}"
    rf"|(?<!{_TOKEN})(?={_NO_DIGIT}*+[0-9]{_NO_DIGIT}*+[0-9]){_TOKEN}{{10,}}={{0,2}}"
    r"|(?:AKIA|ASIA)[A-Z0-9]{16}"
)
#: What a text must have to be split at all.
_MAYBE = rf"-----BEGIN |://[^\s/@]*+@|{_KNOWN}|hooks\.slack|[=:]>?\s++\\?[\"'`]?[^\s\"'`]{{6}}|[0-9][A-Za-z+/_.~-]*+[0-9]|AKIA|ASIA|[=:]>?\s{{0,3}}\\?[\"'`]?[^\s\"'`]{{6}}|(?i:{_CUES})"
_BENIGN = r"(?i)(?:commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|version|build|isbn|issue|ticket|invoice|order|serial|phone|tel|file|image|path)"
#: Words that real secrets seldom hold (fixed values, in alphabetical order).
DICTIONARY = (
    "access", "admin", "alpha", "beta", "build", "case", "change", "chapter", "class", "client", "code", "config", "data", "date", "default",
    "demo", "document", "dummy", "example", "fake", "field", "file", "function", "here", "html", "http", "image", "index", "item", "java",
    "json", "library", "line", "local", "mail", "main", "model", "module", "name", "node", "number", "object", "package", "page", "part",
    "password", "path", "placeholder", "product", "project", "python", "readme", "release", "report", "sample", "schema", "secret", "section",
    "server", "service", "site", "source", "string", "system", "table", "test", "text", "token", "type", "update", "user", "value", "version",
    "view", "word", "www", "your",
)

FEATURES = (
    "length", "digit_share", "upper_share", "transitions", "distinct_share", "hex", "digits_only", "known_prefix", "coverage",
    "slashes", "dots", "path_like", "path_is_sample", "cue_before", "assigned", "benign_before", "url_before", "at_after",
    "quoted", "signs", "lower_only", "brackets", "user_part",
)


def _share(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))) / F.length(value)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """A struct of FEATURES, all double."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "[^abc]", "d")
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(classes, "a+", "a"), "b+", "b"), "c+", "c"), "d+", "d"))
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    got = {
        "length": F.length(value).cast("double"),
        "digit_share": _share(value, "[0-9]"),
        "upper_share": _share(value, "[A-Z]"),
        "transitions": (runs - 1) / F.greatest(F.length(value) - 1, F.lit(1)),
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "hex": _flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": _flag(value.rlike("^[0-9.-]+$")),
        "known_prefix": _flag(value.rlike(f"^(?:\\w+:)?/*(?:AKIA|ASIA|eyJ|-----BEGIN |hooks\\.slack|{_KNOWN})")),
        "coverage": _share(F.lower(value), words),
        "slashes": _share(value, "/"),
        "dots": _share(value, r"\."),
        "path_like": _flag(value.rlike(r"^[/.~]|/.*/|\.[a-z]{2,4}$")),
        "path_is_sample": _flag(path.rlike("(?i)(?:test|example|sample|fixture|mock)")),
        "cue_before": _flag(before.rlike(_CUE + r"[A-Za-z0-9_]*\\?[\"'`]?\s{0,2}(?:is|:?=>?|:)?\s{0,3}\\?[\"'`]?$")),
        "assigned": _flag(before.rlike(r"[=:]>?\s{0,3}\\?[\"'`]?$")),
        "benign_before": _flag(before.rlike(_BENIGN + r"[\s:=#\"']{0,3}$")),
        "url_before": _flag(before.rlike(r"(?:://|www\.)\S*$")),
        "at_after": _flag(after.rlike("^@")),
        "quoted": _flag(before.rlike("[\"'`]$") & after.rlike(r"^\\?[\"'`]")),
        "signs": _share(value, "[^A-Za-z0-9+/_.~=-]"),
        "lower_only": _flag(value.rlike(r"^\p{Ll}+$")),
        "brackets": _share(value, r"[()<>\[\]{}]"),
        "user_part": _flag(before.rlike("://$") & after.rlike("^@")),
    }
    return F.struct(*(got[k].cast("double").alias(k) for k in FEATURES))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with _pieces (texts between candidates), _values and _features, all null where a text can't have any."""
    maybe = F.col("text").rlike(_MAYBE)
    d = docs.withColumn("_values", F.when(maybe, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))))
    d = d.withColumn("_values", F.when(F.size("_values") > 0, F.col("_values")))
    d = d.withColumn("_pieces", F.when(F.col("_values").isNotNull(), F.split("text", CANDIDATE, -1)))
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    # blanks and cues that a candidate begins with go to the piece before it
    d = d.withColumn("_leads", F.transform("_values", lambda v: F.regexp_extract(v, _LEADING, 0)))
    d = d.withColumn("_values", F.transform(F.arrays_zip("_values", "_leads"), lambda z: F.substring(z["_values"], F.length(z["_leads"]) + 1, F.length(z["_values"]))))
    squeezed = lambda i: F.regexp_replace(F.get("_leads", i), r"\s+", " ")
    ahead = lambda i: F.concat(F.coalesce(F.get("_values", i - 1), F.lit("")), F.get("_pieces", i), squeezed(i))
    made = F.transform("_values", lambda v, i: features(v, F.right(ahead(i), F.lit(48)), F.left(F.get("_pieces", i + 1), F.lit(16)), path))
    d = d.withColumn("_features", made)
    return d.withColumn("_pieces", F.transform(F.arrays_zip("_pieces", "_leads"), lambda z: F.concat(z["_pieces"], F.coalesce(z["_leads"], F.lit(""))))).drop("_leads")


@dataclass
class Node:
    """A leaf has only a share of secrets; else rows with feature <= threshold go to ``low``."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 3) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Node(share)
    best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)) + 1, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        left = np.cumsum(t)[:-1]
        n = np.arange(1, len(t))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(t) - n >= least)
        if ok.any():
            a, b = left / n, (left[-1] + t[-1] - left) / (len(t) - n)
            cost = np.where(ok, 2 * a * (1 - a) * n + 2 * b * (1 - b) * (len(t) - n), np.inf)
            i = int(cost.argmin())
            if cost[i] < best[0]:
                best = (float(cost[i]), int(f), float((v[i] + v[i + 1]) / 2))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow_tree(x[low], y[low], rng, depth - 1), grow_tree(x[~low], y[~low], rng, depth - 1))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, seed: int = 1) -> list[Node]:
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(grow_tree(x[rows], y[rows], rng, depth))
    return forest


def tree_column(node: Node, row: Column) -> Column:
    if node.feature < 0:
        return F.lit(node.share)
    return F.when(row[FEATURES[node.feature]] <= node.threshold, tree_column(node.low, row)).otherwise(tree_column(node.high, row))


def forest_column(forest: list[Node], row: Column) -> Column:
    """The mean share over the trees, as one expression."""
    total = tree_column(forest[0], row)
    for tree in forest[1:]:
        total = total + tree_column(tree, row)
    return total / len(forest)


def labelled_findings(n: int = 1800, seed: int = 9) -> list[tuple[str, str, bool]]:
    """(text, source, is_secret): generated texts with one candidate each, half of them secrets."""
    rng = random.Random(seed)
    hexa, alnum, base64, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    some = lambda alphabet, low, high: "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    prose = lambda: " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(3, 9)))
    num = lambda low, high: some(string.digits, low, high)
    word = lambda: rng.choice(DICTIONARY)
    key = lambda: rng.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "PASSWORD", "API_KEY", "Secret"))
    value = lambda: rng.choice((some(hexa, 16, 64), some(alnum, 14, 44), some(base64, 24, 60) + rng.choice(("", "=", "==")), some(alnum, 6, 9) + "-" + some(alnum, 6, 9) + num(2, 2)))
    camel = lambda: "".join(w.capitalize() for w in prose().split()[: rng.randint(2, 4)])
    odd = lambda: rng.choice((some(alnum, 2, 6), prose().split()[0].capitalize())) + rng.choice("!@#$%^*?") + some(alnum + "!@#$%^*?", 3, 10) + num(1, 4)
    short = lambda: rng.choice((prose().split()[0] + num(2, 5), prose().split()[0] + num(1, 2) + some(string.ascii_lowercase, 2, 4), some(alnum, 4, 7) + num(1, 3), odd()))
    words = lambda: rng.choice((camel() + camel(), some(string.ascii_lowercase, 16, 32), some(string.ascii_letters, 12, 32), odd()))
    plain = lambda: rng.choice((word(), some(string.ascii_lowercase, 6, 12), prose().split()[0] + "ing", word() + some(string.ascii_lowercase, 2, 4)))
    name = lambda: rng.choice(("name", "title", "note", "class", "href", "type", "lang", "from", "to", "key", "label", "x", "result", "Author", "Subject"))
    phrase = lambda: rng.choice((" ", " ", "-")).join(rng.choice((word(), prose().split()[0])) + rng.choice(("", "", "s", num(1, 2))) for _ in range(rng.randint(2, 4)))
    leet = lambda: rng.choice((word(), prose().split()[0] + "e")).translate(str.maketrans("aeos", "4305")) + rng.choice((word().capitalize(), prose().split()[0].capitalize())) + num(1, 4)
    wide = lambda: " " * rng.randint(4, 9)
    body = lambda: "\n".join(some(base64, 60, 64) for _ in range(rng.randint(2, 6)))
    secret = (
        lambda: f"{key()}:{wide()}\"{short()}\"", lambda: f"{key()} ={wide()}{short()}", lambda: f"{key()} ={wide()}{leet()}", lambda: f"{key()}={leet()}", lambda: f'{key()}: "{leet()}"', lambda: f'"{key()}": "{phrase()}"', lambda: f"{key()} = '{phrase()}'", lambda: f"postgres://{prose().split()[0]}:{short()}@{prose().split()[0]}/x",
        lambda: f"https://{prose().split()[0]}:{words()}@host.example", lambda: "glpat-" + some(alnum + "_-", 20, 22), lambda: "ghp_" + some(string.ascii_letters, 36, 36), lambda: "hf_" + some(string.ascii_letters, 34, 34), lambda: f"https://hooks.slack.com/services/T{some(upper, 8, 10)}/B{some(upper, 8, 10)}/{some(alnum, 24, 24)}",
        lambda: f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{some(upper, 32, 32)}\n\n{body()}\n-----END RSA PRIVATE KEY-----", lambda: f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x 1\n\n{body()}\n={some(base64, 4, 4)}\n-----END PGP PRIVATE KEY BLOCK-----",
        lambda: f"{key()}={short()}", lambda: f'{key()}: "{short()}"', lambda: f"{key()} = '{words()}'", lambda: f'{key()} = "{words()}"', lambda: f"{key()}={camel() + camel()}", lambda: f'"{key()}": "{words()}"',
        lambda: f"{key()} is {short()}", lambda: f"{key()}: {short()}" + rng.choice(("", ",", ".")), lambda: f"{key()}={value()}", lambda: f'{key()} = "{value()}"', lambda: f"{key()}: {value()}", lambda: f"{key()}='{value()}'", lambda: f"{key()} {value()}",
        lambda: rng.choice(("AKIA", "ASIA")) + some(upper, 16, 16), lambda: "ghp_" + some(alnum, 34, 38), lambda: "sk-" + some(alnum, 24, 48), lambda: "AIza" + some(alnum, 33, 35),
        lambda: "xoxb-" + num(10, 12) + "-" + some(alnum, 20, 28), lambda: "Authorization: Bearer " + value(), lambda: "eyJ" + some(alnum, 20, 30) + "." + some(alnum, 20, 60) + "." + some(alnum, 20, 40),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(some(base64, 60, 64) for _ in range(rng.randint(2, 6))) + "\n-----END RSA PRIVATE KEY-----",
    )
    clean = (
        lambda: f"{name()}:{wide()}{plain()}", lambda: f'{name()} ={wide()}"{plain()} {plain()}"', lambda: f"https://{plain()}.com/@{prose().split()[0]}", lambda: f"{name()}:{wide()}{prose()}",
        lambda: f"{name()}: {plain()}", lambda: f'{name()}="{plain()}"', lambda: f'{name()} = "{plain()} {plain()}"', lambda: f"{key()} {plain()} {prose()}", lambda: f"{key()} is {plain()}", lambda: f"{key()}: {plain()}",
        lambda: f"{name()} = {plain()}({plain()})", lambda: f"{plain()}: {plain().capitalize()}", lambda: f'{name()}="https://{plain()}.com/{plain()}"', lambda: f"{name()}={camel()}", lambda: f"{key()}={word()}({name()})", lambda: f"{name()}: {camel()}{num(1, 2)}",
        lambda: "commit " + some(hexa, 40, 40), lambda: "sha256: " + some(hexa, 64, 64), lambda: "md5 " + some(hexa, 32, 32), lambda: "-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)),
        lambda: num(10, 19), lambda: ".".join(num(1, 3) for _ in range(4)), lambda: f"v{num(1, 2)}.{num(1, 2)}.{num(1, 3)}-{word()}.{num(1, 4)}",
        lambda: "/" + "/".join(word() + num(1, 2) for _ in range(rng.randint(2, 5))), lambda: f"20{num(2, 2)}-0{num(1, 1)}-1{num(1, 1)}T1{num(1, 1)}",
        lambda: f"{word()}_{num(2, 4)}_{word()}{num(1, 3)}.{rng.choice(('png', 'jpg', 'txt', 'py', 'html'))}", lambda: f"https://www.{word()}.com/{word()}/{num(3, 8)}/{word()}-{num(2, 4)}",
        lambda: f"{word()}{word().capitalize()}{num(1, 2)}{word().capitalize()}{num(1, 2)}", lambda: f"id={num(8, 14)}", lambda: f"{key()}=your_{word()}_{word()}_{num(2, 3)}",
        lambda: f'{key()} = "{word()}-{word()}-{num(2, 3)}"', lambda: f"{key()}: xxxxxxxxxx{num(2, 2)}", lambda: f"{word()}.{num(2, 3)}.{word()}{num(1, 3)}@mail{num(1, 2)}.example.com",
        lambda: f"order {num(4, 6)}-{num(4, 6)}-{num(2, 3)}", lambda: f"{prose().replace(' ', '')[:12]}{num(2, 3)}", lambda: f"1{num(2, 2)}-{num(3, 3)}-{num(4, 4)}",
        lambda: "uuid " + "-".join(some(hexa, k, k) for k in (8, 4, 4, 4, 12)), lambda: f"image {some(hexa, 12, 16)}.png", lambda: f"build {num(8, 12)}", lambda: f"checksum: {some(hexa, 40, 40)}",
    )
    out = []
    for i in range(n):
        bad = i % 2 == 0
        text = f"{prose()} {rng.choice(secret if bad else clean)()} {prose()}"
        out.append((text, rng.choice(("src/app", "notes/page", "web/crawl", "tests/fixture")), bad))
    return out


def fit(spark: SparkSession, labelled: list[tuple[str, str, bool]] | None = None) -> list[Node]:
    """A forest from labelled findings (text with candidates, path, is_secret); their number bounds the driver's work."""
    rows = spark.createDataFrame(labelled or labelled_findings(), "text string, source string, secret boolean").coalesce(1)
    # explode would add a filter on the features, and compute them again for it
    got = [r for r in candidates(rows).select("secret", F.explode_outer("_features").alias("f")).select("secret", "f.*").collect() if r[FEATURES[0]] is not None]
    x, y = np.array([[r[f] for f in FEATURES] for r in got]), np.array([float(r.secret) for r in got])
    by = np.lexsort((*x.T, y))
    return grow_forest(x[by], y[by])


def scored(docs: DataFrame, forest: list[Node]) -> DataFrame:
    """``docs`` with _pieces, _values and _scores (null where there is no candidate)."""
    return candidates(docs).withColumn("_scores", F.transform("_features", lambda f: forest_column(forest, f))).drop("_features")


#: Candidates whose lengths are added up together, and sums of them that are again.
_STEP = 64


def findings(docs: DataFrame, forest: list[Node], threshold: float = 0.5) -> DataFrame:
    """One row a candidate: doc_id, start and end (code points), length, score, is_secret, value_sha256."""
    d = scored(docs.select(*(c for c in ("doc_id", "text", "source") if c in docs.columns)), forest).where("_values is not null")
    add = lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)
    down = lambda i, by: F.floor(i / by).cast("int")
    steps = lambda c: F.transform(F.sequence(F.lit(0), down(F.size(c) - 1, _STEP)), lambda b: add(F.slice(c, b * _STEP + 1, F.lit(_STEP))))
    d = d.select("doc_id", "_values", "_scores", "_pieces", F.transform("_values", lambda v, i: F.length(v) + F.length(F.get("_pieces", i))).alias("_long"))
    d = d.withColumn("_sums", steps("_long"))
    d = d.withColumn("_sums2", steps("_sums"))
    inside = lambda c, n: add(F.slice(c, down(n, _STEP) * _STEP + 1, n % _STEP))
    begin = lambda i: add(F.slice("_sums2", F.lit(1), down(i, _STEP * _STEP))) + inside("_sums", down(i, _STEP)) + inside("_long", i) + F.length(F.get("_pieces", i))
    found = F.transform("_values", lambda v, i: F.struct(v.alias("value"), begin(i).alias("start"), F.get("_scores", i).alias("score")))
    d = d.select("doc_id", F.explode_outer(found).alias("f"))
    n = F.length("f.value")
    return d.select(
        "doc_id", F.col("f.start").cast("long").alias("start"), (F.col("f.start") + n).cast("long").alias("end"), n.alias("length"),
        F.round("f.score", 6).alias("score"), (F.col("f.score") >= threshold).alias("is_secret"), F.sha2("f.value", 256).alias("value_sha256"),
    )


def redact(docs: DataFrame, forest: list[Node], threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; other rows and columns are as before."""
    source = F.col("source") if "source" in docs.columns else F.lit("").alias("source")
    d = scored(docs.select(F.struct("*").alias("whole"), "text", source), forest)
    marked = lambda i: F.when(F.get("_scores", i) >= threshold, mark).otherwise(F.get("_values", i))
    joined = F.array_join(F.transform("_pieces", lambda p, i: F.concat(p, F.coalesce(marked(i), F.lit("")))), "")
    text = F.when(F.col("_values").isNull(), F.col("text")).otherwise(joined)
    return d.select(*(text.alias(c) if c == "text" else F.col("whole")[c].alias(c) for c in docs.columns))


def op2(docs: DataFrame) -> DataFrame:
    return findings(docs, fit(docs.sparkSession))
