"""Named queries over the standard tables. Documents play files, conversations play session logs, events play commands.

Each query applies one operator to a whole table. ``oracles`` holds the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, commands, edits, lines, maps, outline, ranges, reads, search, segments, symbols
from ..operators.outline.model import KINDS
from ..sources.tables import table
from . import composed, indexed, oracles, samples, stored, structures

Query = Callable[[SparkSession, str], DataFrame]

WORD, LITERAL, COMMON = "[Tt]ion", "Licensed under", "the"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and canonical text."""
    return lines.normalised(table(spark, folder, "documents")).select("doc_id", "text")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Anchored lines of every document, within the head budget."""
    return lines.anchored(lines.head(documents(spark, folder)))


def lines_numbered(spark: SparkSession, folder: str) -> DataFrame:
    return lines.lines(documents(spark, folder))


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.size(T.line_array("text")).cast("long").alias("n_lines"))


def lines_hashed(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.anchored(lines.lines(documents(spark, folder)))
    return found.select("doc_id", "line_no", "hash")


def lines_anchored(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder).select("doc_id", "line_no", "anchor", "truncated")


def read_slice(spark: SparkSession, folder: str) -> DataFrame:
    return lines.lines(documents(spark, folder), offset=3, limit=4)


def read_head_budget(spark: SparkSession, folder: str) -> DataFrame:
    return lines.head(documents(spark, folder), most_lines=40, most_bytes=4096).drop("text")


def text_profile(spark: SparkSession, folder: str) -> DataFrame:
    d = lines.normalised(table(spark, folder, "documents"))
    parts = T.line_array("text")
    return d.select(
        "doc_id", "has_bom", "ending", "bare_cr", "is_binary", F.size(parts).cast("long").alias("n_lines"),
        F.size(F.filter(parts, lambda x: T.trimmed(x) == "")).cast("long").alias("blank_lines"),
        F.array_max(F.transform(parts, lambda x: F.length(x))).cast("long").alias("longest"), F.octet_length("text").cast("long").alias("n_bytes"),
    )


def grep_regex(spark: SparkSession, folder: str) -> DataFrame:
    return search.grep(documents(spark, folder), WORD).select("doc_id", "line_no", "text")


def grep_literal_ci(spark: SparkSession, folder: str) -> DataFrame:
    return search.grep(documents(spark, folder), LITERAL.lower(), literal=True, ignore_case=True).select("doc_id", "line_no", "text")


def grep_context_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return search.grep(documents(spark, folder), LITERAL, literal=True, context=2)


def grep_cap_per_file(spark: SparkSession, folder: str) -> DataFrame:
    return search.grep(documents(spark, folder), COMMON, literal=True, context=1, cap=True).select("doc_id", "line_no", "kind", "gap")


def grep_more_matches(spark: SparkSession, folder: str) -> DataFrame:
    return search.more_matches(documents(spark, folder), COMMON, literal=True)


def grep_summary(spark: SparkSession, folder: str) -> DataFrame:
    return search.summary(documents(spark, folder), WORD)


def grep_limit(spark: SparkSession, folder: str) -> DataFrame:
    return search.first_matches(documents(spark, folder), WORD)


def grep_rendered(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder)
    found = search.grep(d, LITERAL, literal=True, context=1, cap=True)
    return search.rendered(lines.anchored(found), search.more_matches(d, LITERAL, literal=True))


def grep_limit_notice(spark: SparkSession, folder: str) -> DataFrame:
    return search.limit_notice(documents(spark, folder), WORD)


def _some_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in which a NUL stands for each occurrence of the literal."""
    return lines.normalised(table(spark, folder, "documents").select("doc_id", F.replace("text", F.lit(LITERAL), F.lit("\0")).alias("text")))


def grep_text_only(spark: SparkSession, folder: str) -> DataFrame:
    return search.summary(search.text_only(_some_binary(spark, folder)), WORD)


def grep_binary_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return search.binary_warnings(_some_binary(spark, folder))


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Five requests a document: all of it, lines from a start, a symbol with a start, a symbol with a map, a map."""
    start = (F.col("doc_id") % 30 + 1).cast("int")
    asked = [(None, None, None, False), (start, 5, None, False), (start, None, "name", False), (None, None, "name", True), (None, 3, None, True)]
    rows = [
        F.struct(F.lit(i).alias("request"), *((x if isinstance(x, F.Column) else F.lit(x)).cast(t).alias(n) for x, (n, t) in zip(r, (c.split() for c in reads.REQUEST.split(", ")), strict=True)))
        for i, r in enumerate(asked)
    ]
    d = documents(spark, folder)
    found = reads.answered(d, d.select("doc_id", F.inline(F.array(*rows))), most_lines=40, most_bytes=4096)
    return found.select("doc_id", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("symbol", F.lit("")).alias("symbol"), "map", "status", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("first_line", F.lit(0)).alias("first_line"), F.coalesce("last_line", F.lit(0)).alias("last_line"), "truncated", "with_map")


def _match_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A range from each matching line to two lines on."""
    found = search.grep(documents(spark, folder), WORD)
    return found.select("doc_id", F.col("line_no").alias("start_line"), (F.col("line_no") + 2).alias("end_line"))


def range_merge(spark: SparkSession, folder: str) -> DataFrame:
    return ranges.merged(_match_ranges(spark, folder))


def range_expand(spark: SparkSession, folder: str) -> DataFrame:
    return ranges.expanded(range_merge(spark, folder), documents(spark, folder))


def _keyed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their content, without blanks, as the mark that anchors carry."""
    return lines_numbered(spark, folder).select("doc_id", "line_no", F.md5(T.squeezed("text").cast("binary")).alias("mark"))


def _moved_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """An anchor to every line, three lines off."""
    return _keyed_lines(spark, folder).select("doc_id", (F.col("line_no") + 3).alias("line_no"), "mark")


def anchor_verify(spark: SparkSession, folder: str) -> DataFrame:
    return anchors.verified(_moved_anchors(spark, folder), _keyed_lines(spark, folder), mark="mark")


def anchor_relocate(spark: SparkSession, folder: str) -> DataFrame:
    """new_line is 0 where there is none."""
    found = anchors.relocated(_moved_anchors(spark, folder), _keyed_lines(spark, folder), mark="mark")
    return found.withColumn("new_line", F.coalesce("new_line", F.lit(0)))


def anchor_parse(spark: SparkSession, folder: str) -> DataFrame:
    refs = table(spark, folder, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" : a"), (F.col("doc_id") % 10).cast("string"), F.lit("|"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("ref"))
    return refs.select("doc_id", lines.parsed_anchor("ref").alias("a")).select("doc_id", F.coalesce("a.line", F.lit(0)).alias("line"), "a.hash", "a.content")


def similar_lines_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The lines most like each line, itself among them."""
    d = documents(spark, folder)
    every = lines.lines(d).select("doc_id", "line_no", F.col("text").alias("content"))
    return anchors.similar(every.where(T.trimmed("content") != ""), d).select("doc_id", "line_no", "found_line", F.round("score", 6).alias("score"), "rank")


def duplicate_canonical_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line contents, without blanks, that several documents share."""
    return _keyed_lines(spark, folder).groupBy("mark").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n_docs > 1")


def lang_detect_by_ext(spark: SparkSession, folder: str) -> DataFrame:
    exts = F.array(*(F.lit(x) for x in (*sorted(outline.LANGUAGES), ".xyz")))
    path = F.concat(F.regexp_replace(F.col("url"), r"\?.*$", ""), F.get(exts, (F.col("page_id") % F.size(exts)).cast("int")))
    return table(spark, folder, "pages").select("page_id", path.alias("path")).select("page_id", outline.language(F.col("path")).alias("language_id"), outline.language(F.col("path"), 1).alias("language"))


def url_dir_counts(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"\?.*$", "")
    d = table(spark, folder, "pages").select(T.directory(bare).alias("dir"))
    return d.rollup("dir").agg(F.count("*").alias("n_files"))


def _markdown_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as Markdown: a line a tag, headings and fences marked."""
    html = F.regexp_replace("html", "<h([1-6])>", "\n#$1 ")
    text = F.regexp_replace(F.regexp_replace(html, "</?(?:script|style)>", "\n```\n"), "<(?:p|li|nav|article|footer)[^>]*>", "\n##2 ")
    text = F.regexp_replace(text, r"\n#1 ", "\n# ")
    return lines.lines(table(spark, folder, "pages").select("page_id", F.regexp_replace(text, r"##2 ", "## ").alias("text")), "page_id")


def fence_headings(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("page_id").orderBy("line_no")
    fence = F.startswith(F.col("text"), F.lit("```"))
    d = _markdown_lines(spark, folder).withColumn("inside", F.sum(fence.cast("int")).over(w) % 2)
    d = d.where(~fence & (F.col("inside") == 0)).select("page_id", "line_no", F.length(F.regexp_extract("text", r"^(#{1,6})\s+.+$", 1)).alias("level"))
    return d.where("level > 0")


def heading_parent(spark: SparkSession, folder: str) -> DataFrame:
    """For each heading the last one before it of lower level, 0 where there is none."""
    w = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    above = F.lit(None).cast("int")
    for k in range(1, 6):
        above = F.greatest(above, F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("line_no")), True).over(w)))
    return fence_headings(spark, folder).withColumn("parent_line", F.coalesce(above, F.lit(0)))


def sections_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """For each line the last heading at or before it, 0 where there is none."""
    head = F.when(F.col("text").rlike("^#{1,6} "), F.col("line_no"))
    heads = _markdown_lines(spark, folder).select("page_id", "line_no", head.alias("head"))
    found = segments.scans(heads, "page_id", ["line_no"], {"section_line": (F.col("head"), "last")})
    return found.select("page_id", "line_no", F.coalesce("section_line", F.lit(0)).alias("section_line"))


def lead_end_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Sections end on the line before the next."""
    w = Window.partitionBy("page_id").orderBy("line_no")
    d = _markdown_lines(spark, folder)
    d = d.withColumn("total", F.count("*").over(Window.partitionBy("page_id"))).where(F.col("text").rlike("^#{1,6} "))
    return d.select("page_id", F.col("line_no").alias("start_line"), F.coalesce(F.lead("line_no").over(w) - 1, F.col("total")).cast("long").alias("end_line"))


def session_turn_spans(spark: SparkSession, folder: str) -> DataFrame:
    """User turns reach to the turn before the next one."""
    flat = F.btrim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    d = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", T.truncate(flat, 80)).alias("preview"))
    user = F.when(F.col("role") == "user", F.col("turn"))
    d = segments.scans(d, "conv_id", ["turn"], {"following": (user, "last"), "final": (F.col("turn"), "max")}, reverse=True, exclusive=True)
    return d.where("role = 'user'").select("conv_id", F.col("turn").alias("start_turn"), F.coalesce(F.col("following") - 1, F.greatest("turn", "final")).alias("end_turn"), "preview")


def session_stats(spark: SparkSession, folder: str) -> DataFrame:
    roles = {r: F.count_if(F.col("role") == r) for r in ("user", "assistant", "system")}
    d = table(spark, folder, "conversations").groupBy("conv_id").agg(*(c.alias(f"n_{r}") for r, c in roles.items()))
    parts = F.array(*(F.when(F.col(f"n_{r}") > 0, F.concat(F.col(f"n_{r}").cast("string"), F.lit(f" {r}"))) for r in roles))
    return d.withColumn("stats", F.concat(F.lit("Stats: "), F.array_join(F.array_compact(parts), ", ")))


def json_props_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Keys and value types of the events' JSON."""
    d = table(spark, folder, "events").select("event_type", F.explode(F.from_json("props", "map<string, variant>")).alias("key", "value"))
    kind = F.schema_of_variant("value")
    named = F.when(kind.rlike("BIGINT|DECIMAL|DOUBLE"), "number").otherwise(F.lower(kind))
    return d.groupBy("event_type", "key", named.alias("type")).agg(F.count("*").alias("n"))


def csv_shape(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as one CSV text a region, and its shape."""
    cell = F.concat(F.lit('"'), "n_name", F.lit('"'))
    row = F.concat_ws(",", F.col("n_nationkey").cast("string"), cell, F.col("n_regionkey").cast("string"))
    d = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    text = F.concat(F.lit("n_nationkey,n_name,n_regionkey\n"), F.array_join(F.transform("x", lambda x: x["r"]), "\n"))
    docs = d.select(F.col("n_regionkey").cast("long").alias("doc_id"), text.alias("text"), F.lit("csv").alias("language_id"))
    found = outline.symbols(outline.file_maps(docs))
    shape = F.max(F.when(F.col("kind") == "table", F.col("name"))).alias("shape")
    return found.groupBy("doc_id").agg(shape, F.count_if(F.col("kind") == "property").alias("n_columns"), F.max(F.when(F.col("kind") == "variable", F.col("name"))).alias("sample"))


LOOKUPS = ("cold widget", "Widget", "SMALL", "bolt", "dge", "large gear", "zzz")


def _part_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as symbols of their brand's document."""
    d = table(spark, folder, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("sym_id"), F.col("p_name").alias("name"), (F.col("p_partkey") + 1).alias("start_line"))
    return d.select("*", F.col("start_line").alias("end_line"), F.array("name").alias("path"))


def symbol_lookup_tiers(spark: SparkSession, folder: str) -> DataFrame:
    queries = spark.createDataFrame([(q,) for q in LOOKUPS], "query string")
    return symbols.matches(_part_symbols(spark, folder), queries).where(F.col("rank") <= symbols.SHOWN).select("query", "doc_id", "sym_id", "tier", "hits", "rank")


def symbol_lookup_many(spark: SparkSession, folder: str) -> DataFrame:
    """As many lookups as there are parts: each part by its name and line, and by its path."""
    parts = _part_symbols(spark, folder).drop("path").join(table(spark, folder, "part").select(F.col("p_partkey").alias("sym_id"), "p_type"), "sym_id")
    parts = parts.withColumn("path", F.array("p_type", "name"))
    by_line = parts.select(F.concat("name", F.lit("@"), F.col("start_line").cast("string")).alias("query"))
    asked = by_line.union(parts.select(F.concat_ws(".", "p_type", "name"))).distinct()
    return symbols.matches(parts.drop("p_type"), asked).select("query", "doc_id", "sym_id", "tier", "hits", "rank")


#: A command by event type, for queries over events.
COMMANDS = {
    "error": "eslint src", "signup": "npm install", "purchase": "make all", "view": "git log", "click": "find . -name x", "login": "cargo test",
    "logout": "curl http://x", "search": "rsync -av a b", "add_to_cart": "docker build .", "page_view": "git status",
}


def _command(event_type) -> F.Column:  # noqa: ANN001
    c = F.lit(None).cast("string")
    for kind, command in COMMANDS.items():
        c = F.when(event_type == kind, command).otherwise(c)
    return F.coalesce(c, F.concat(F.lit("run "), event_type))


def command_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as commands with coloured output: a finding of a linter, and lines that say what happened."""
    e = table(spark, folder, "events")
    finding = F.concat(F.lit("src/f"), (F.col("user_id") % 17).cast("string"), F.lit(".ts:"), (F.col("event_id") % 90 + 1).cast("string"), F.lit(":5: bad [rule-"), (F.col("event_id") % 7).cast("string"), F.lit("]"))
    output = F.concat(F.lit("\x1b[31m"), finding, F.lit("\x1b[0m\n"), F.lit("added "), F.col("value").cast("int").cast("string"), F.lit(" packages\n\x1b]0;t\x07"), "props")
    return e.select("event_id", _command(F.col("event_type")).alias("command"), output.alias("output"))


def command_route(spark: SparkSession, folder: str) -> DataFrame:
    return commands.routed(command_events(spark, folder)).select("event_id", "command", "route")


def command_condensed(spark: SparkSession, folder: str) -> DataFrame:
    return commands.condensed(command_events(spark, folder)).select("event_id", "route", "condensed", "saved")


def ansi_strip(spark: SparkSession, folder: str) -> DataFrame:
    return command_events(spark, folder).select("event_id", T.strip_ansi("output").alias("stripped"))


def savings(spark: SparkSession, folder: str) -> DataFrame:
    plain = T.strip_ansi("output")
    d = command_events(spark, folder).select("command", (T.utf16_length("output") - T.utf16_length(plain)).alias("saved"))
    return d.groupBy("command").agg(F.sum("saved").alias("saved"), F.count("*").alias("n"))


def test_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    output = F.concat(F.lit("ok\n"), (F.col("event_id") % 9).cast("string"), F.lit(" passed, "), (F.col("user_id") % 3).cast("string"), F.lit(" failed"))
    return commands.test_summaries(e.select("event_id", F.lit("pytest -q").alias("command"), output.alias("output"))).select("event_id", "summary")


def lint_top_rules(spark: SparkSession, folder: str) -> DataFrame:
    return commands.top_counts(commands.lint_issues(command_events(spark, folder)), "rule", 5)


def lint_top_files(spark: SparkSession, folder: str) -> DataFrame:
    return commands.top_counts(commands.lint_issues(command_events(spark, folder)), "file", 10)


def log_compact(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", commands.condensed_log(F.col("text")).alias("log"))


def truncate_lines_middle(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", T.truncate_middle("text", 6).alias("text"))


def positional_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Lines at the same place of a document and of itself with blanks evened out; what differs, counted."""
    d = documents(spark, folder).select("doc_id", T.line_array("text").alias("a"), T.line_array(F.regexp_replace(F.regexp_replace("text", "[.,]", ""), "\n\n+", "\n")).alias("b"))
    differs = F.zip_with("a", "b", lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    changed = F.size(F.filter(differs, lambda x: x == 1))
    return d.select("doc_id", changed.cast("long").alias("changed_lines"), F.array_position(differs, 1).cast("long").alias("first_changed"))


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    """For each document: its first line marked, a line put after the second, and one text replaced."""
    found = lines.anchored(lines.lines(documents(spark, folder), limit=2)).select("doc_id", "line_no", F.concat(F.col("line_no").cast("string"), F.lit(":"), "hash").alias("anchor"), "text")
    none = F.lit(None).cast("string")
    change = found.select(
        "doc_id", F.col("line_no").alias("idx"), F.when(F.col("line_no") == 1, "set_line").otherwise("insert_after").alias("op"), "anchor", none.alias("end_anchor"),
        none.alias("old_text"), F.when(F.col("line_no") == 1, F.concat(F.lit("* "), "text")).otherwise("(inserted)").alias("new_text"), F.lit(False).alias("replace_all"),
    )
    replace = documents(spark, folder).where(F.contains(F.col("text"), F.lit(LITERAL))).select(
        "doc_id", F.lit(9).alias("idx"), F.lit("replace").alias("op"), none.alias("anchor"), none.alias("end_anchor"), F.lit(LITERAL).alias("old_text"), F.lit("Under").alias("new_text"), F.lit(True).alias("replace_all"),
    )
    return change.unionByName(replace)


def edit_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Documents after their edits. Of the columns those that plain SQL can give."""
    found = edits.applied(documents(spark, folder), _edits(spark, folder))
    return found.select("doc_id", "status", "text", F.col("first_changed").cast("long").alias("first_changed"))


def edit_diffs(spark: SparkSession, folder: str) -> DataFrame:
    return edits.applied(documents(spark, folder), _edits(spark, folder)).select("doc_id", "diff", "warnings")


def markup_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of the pages, read as Markdown."""
    text = _markdown_lines(spark, folder)
    docs = lines.rendered(text, "page_id", "text").select("page_id", "text", F.lit("markdown").alias("language_id"))
    return outline.symbols(outline.file_maps(docs, "page_id"), "page_id").select("page_id", "sym_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "start_line", "end_line")


def map_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Maps of the pages in a budget of 2 KB, so that all levels are used."""
    text = lines.rendered(_markdown_lines(spark, folder), "page_id", "text")
    docs = text.select("page_id", "text", F.lit("markdown").alias("language_id"))
    found = outline.file_maps(docs, "page_id").join(text.select("page_id", F.octet_length("text").alias("total_bytes")), "page_id")
    return maps.rendered(found.withColumn("name", F.lit("page.md")), "page_id", most=2048)


def session_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as session logs, and their outline."""
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    entry = F.to_json(F.struct(F.lit("message").alias("type"), message.alias("message")))
    d = table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))).alias("x"))
    head = F.lit('{"type":"session","cwd":"/w","timestamp":"2024-01-02T03:04:05Z"}\n')
    text = F.concat(head, F.array_join(F.transform("x", lambda x: x["e"]), "\n"))
    return outline.symbols(outline.file_maps(d.select("conv_id", text.alias("text"), F.lit("jsonl").alias("language_id")), "conv_id"), "conv_id").select("conv_id", "sym_id", "name", "kind", "start_line", "end_line")


def kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each kind of symbol occurs in the session outlines; kinds that don't occur count 0."""
    kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string")
    found = session_outline(spark, folder).groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


NAMES = (
    "lines_numbered", "line_counts", "lines_hashed", "lines_anchored", "read_slice", "read_head_budget", "text_profile", "grep_regex", "grep_literal_ci",
    "grep_context_dedup", "grep_cap_per_file", "grep_more_matches", "grep_summary", "grep_limit", "grep_limit_notice", "grep_text_only", "grep_binary_warnings", "read_requests", "grep_rendered", "range_merge", "range_expand",
    "anchor_verify", "anchor_relocate", "anchor_parse", "similar_lines_topk", "duplicate_canonical_lines", "lang_detect_by_ext", "url_dir_counts",
    "fence_headings", "heading_parent", "sections_forward_fill", "lead_end_lines", "session_turn_spans", "session_stats", "json_props_schema", "csv_shape",
    "symbol_lookup_tiers", "symbol_lookup_many", "command_route", "command_condensed", "ansi_strip", "savings", "test_summary", "lint_top_rules", "lint_top_files", "log_compact",
    "truncate_lines_middle", "positional_diff", "edit_apply", "edit_diffs", "markup_outline", "map_budget", "session_outline", "kind_counts",
)


def queries() -> dict[str, Query]:
    return {name: globals()[name] for name in NAMES} | samples.queries() | composed.queries() | structures.queries() | indexed.queries() | stored.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | samples.oracle_sql() | composed.oracle_sql() | structures.oracle_sql() | indexed.oracle_sql() | stored.oracle_sql()
