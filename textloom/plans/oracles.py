"""SQL that gives the same rows as the catalogue's queries, for an independent engine over the same tables.

It is written from the rules, not from the Spark plans, and only with what standard SQL engines have: windows, list
functions and regular expressions. Queries without an entry have no reasonable SQL form; tests cover those.
"""

from __future__ import annotations

from ..functions.linehash import P1, P2, P3, P4, P5
from ..operators.outline import LANGUAGES
from ..operators.outline.model import KINDS

_BLANK = r"[\t\n\x0b\x0c\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_LF = "chr(10)"
_D = """d AS (
  SELECT doc_id, replace(replace(CASE WHEN starts_with(coalesce(text, ''), chr(65279)) THEN substr(text, 2) ELSE coalesce(text, '') END,
    chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text
  FROM documents)"""
_L = (
    _D
    + """, l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM d)"""
)
_TION, _LICENSE, _THE = "regexp_matches(text, '[Tt]ion')", "contains(text, 'Licensed under')", "contains(text, 'the')"


def _squeezed(c: str) -> str:
    return f"regexp_replace({c}, '{_BLANK}', '', 'g')"


_K = _L + f", k AS (SELECT doc_id, line_no, md5({_squeezed('text')}) AS mark FROM l)"
_A = _K + ", a AS (SELECT doc_id, line_no + 3 AS line_no, mark FROM k)"


def _shown(test: str, context: int, more: str = "") -> str:
    return f"""{_L}, h AS (SELECT doc_id, line_no FROM l WHERE {test}){more},
s AS (SELECT DISTINCT l.doc_id, l.line_no, l.text FROM l JOIN h ON l.doc_id = h.doc_id AND abs(l.line_no - h.line_no) <= {context})"""


_KIND_GAP = "CASE WHEN {} THEN 'match' ELSE 'context' END AS kind, coalesce(line_no > lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) + 1, false) AS gap"
_MERGED = f"""{_L}, r AS (SELECT doc_id, line_no AS start_line, line_no + 2 AS end_line FROM l WHERE {_TION}),
f AS (SELECT *, max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_line) AS island FROM f),
m AS (SELECT doc_id, min(start_line) AS start_line, max(end_line) AS end_line FROM i GROUP BY doc_id, island)"""


# --- the line hash ---------------------------------------------------------------------------------------------------

_MOD = 4294967296


def _rotate(x: str, by: int) -> str:
    return f"(({x} * {2**by}) % {_MOD} + {x} // {2 ** (32 - by)})"


def _word(at: str) -> str:
    """The little-endian word at a byte of the hex text ``h``."""
    digits = "||".join(f"substr(h, (2 * ({at}) + {k})::BIGINT, 2)" for k in (7, 5, 3, 1))
    return f"('0x' || {digits})::UBIGINT::HUGEINT"


def _hash_sql(lines: str) -> str:
    """CTEs that give ``hashed(s, hash)`` for each distinct squeezed text of ``lines`` (a relation with a column s)."""
    lane = lambda i: f"({_rotate(f'((a[{i}] + w[{i}] * {P2}) % {_MOD})', 13)} * {P1}) % {_MOD}"
    first = f"[{(P1 + P2) % _MOD}, {P2}, 0, {_MOD - P1}]::HUGEINT[]"
    stripes = f"list_reduce(list_concat([{first}], list_transform(range(n // 16), lambda i: [{', '.join(_word(f'16 * i + {4 * k}') for k in range(4))}])), lambda a, w: [{', '.join(lane(i) for i in range(1, 5))}])"
    start = " + ".join(_rotate(f"v[{i}]", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18)))
    words = f"list_transform(range((n % 16) // 4), lambda i: {_word('n - n % 16 + 4 * i')})"
    rest = "list_transform(range(n % 4), lambda i: ('0x' || substr(h, (2 * (n - n % 4 + i) + 1)::BIGINT, 2))::UBIGINT::HUGEINT)"
    mixed = lambda x, shift: f"xor(({x})::UBIGINT, ({x})::UBIGINT >> {shift})::HUGEINT"
    return f"""
h0 AS (SELECT DISTINCT s, hex(encode(s)) AS h, strlen(s)::BIGINT AS n FROM {lines}),
h1 AS (SELECT *, {stripes} AS v FROM h0),
h2 AS (SELECT *, ((CASE WHEN n >= 16 THEN {start} ELSE {P5} END + n) % {_MOD})::HUGEINT AS x FROM h1),
h3 AS (SELECT *, list_reduce(list_concat([x], {words}), lambda a, w: ({_rotate(f'((a + w * {P3}) % {_MOD})', 17)} * {P4}) % {_MOD}) AS y FROM h2),
h4 AS (SELECT *, list_reduce(list_concat([y], {rest}), lambda a, w: ({_rotate(f'((a + w * {P5}) % {_MOD})', 11)} * {P1}) % {_MOD}) AS z FROM h3),
h5 AS (SELECT *, ({mixed('z', 15)} * {P2}) % {_MOD} AS z1 FROM h4),
h6 AS (SELECT *, ({mixed('z1', 13)} * {P3}) % {_MOD} AS z2 FROM h5),
hashed AS (SELECT s, format('{{:02x}}', ({mixed('z2', 16)} % 256)::INT) AS hash FROM h6)"""


_HEAD = """c AS (SELECT doc_id, line_no, text, sum(length(line_no::VARCHAR) + 4 + strlen(text) + CASE WHEN line_no > 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY line_no) AS bytes, count(*) OVER (PARTITION BY doc_id)::INT AS total FROM l),
k AS (SELECT * FROM c WHERE bytes <= {} AND line_no <= {}),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) < total AS truncated FROM k)"""

# --- pages as Markdown -----------------------------------------------------------------------------------------------

_M = """t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<h([1-6])>', chr(10) || '#\\1 ', 'g'),
    '</?(?:script|style)>', chr(10) || '```' || chr(10), 'g'), '<(?:p|li|nav|article|footer)[^>]*>', chr(10) || '##2 ', 'g') AS text FROM pages),
m AS (SELECT page_id, string_split(replace(replace(text, chr(10) || '#1 ', chr(10) || '# '), '##2 ', '## '), chr(10)) AS x FROM t),
l AS (SELECT page_id, unnest(x) AS text, generate_subscripts(x, 1)::INT AS line_no, len(x) AS total FROM m)"""
_HEADINGS = (
    _M
    + """, p AS (SELECT *, sum(CASE WHEN starts_with(text, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no) % 2 AS inside FROM l),
g AS (SELECT page_id, line_no, length(regexp_extract(text, '^(#{1,6})\\s+.+$', 1))::INT AS level, total FROM p
  WHERE NOT starts_with(text, '```') AND inside = 0 AND regexp_matches(text, '^#{1,6}\\s+.+$'))"""
)
_ABOVE = "(SELECT max(o.line_no) FROM g o WHERE o.page_id = g.page_id AND o.line_no < g.line_no AND o.level < g.level)"

# --- events as commands ----------------------------------------------------------------------------------------------

_COMMAND = """CASE event_type WHEN 'error' THEN 'eslint src' WHEN 'signup' THEN 'npm install' WHEN 'purchase' THEN 'make all' WHEN 'view' THEN 'git log'
  WHEN 'click' THEN 'find . -name x' WHEN 'login' THEN 'cargo test' WHEN 'logout' THEN 'curl http://x' WHEN 'search' THEN 'rsync -av a b'
  WHEN 'add_to_cart' THEN 'docker build .' WHEN 'page_view' THEN 'git status' ELSE 'run ' || event_type END"""
_FINDING = "'src/f' || (user_id % 17) || '.ts:' || (event_id % 90 + 1) || ':5: bad [rule-' || (event_id % 7) || ']'"
_PLAIN = f"{_FINDING} || chr(10) || 'added ' || trunc(value)::INT || ' packages' || chr(10) || props"
_COLOURED = f"chr(27) || '[31m' || {_FINDING} || chr(27) || '[0m' || chr(10) || 'added ' || trunc(value)::INT || ' packages' || chr(10) || chr(27) || ']0;t' || chr(7) || props"

_FLAT = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))"
_PREVIEW = f"CASE WHEN length({_FLAT}) <= 80 THEN {_FLAT} ELSE {_FLAT}[:77] || '...' END"
_EXTS = [*sorted(LANGUAGES), ".xyz"]
_QUERIES = ("cold widget", "Widget", "SMALL", "bolt", "dge", "large gear", "zzz")
_QUOTED = "', '"

SQL = {
    "lines_numbered": f"WITH {_L} SELECT doc_id, line_no, text FROM l",
    "line_counts": f"WITH {_D} SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM d",
    "lines_hashed": f"WITH {_L}, q AS (SELECT doc_id, line_no, {_squeezed('text')} AS s FROM l), {_hash_sql('q')} SELECT doc_id, line_no, hash FROM q JOIN hashed USING (s)",
    "lines_anchored": f"""WITH {_L}, {_HEAD.format(51200, 2000)}, q AS (SELECT *, {_squeezed('text')} AS s FROM b), {_hash_sql('q')}
SELECT doc_id, line_no, line_no || ':' || hash || '|' || text AS anchor, truncated FROM q JOIN hashed USING (s)""",
    "read_slice": f"WITH {_L} SELECT doc_id, line_no, text FROM l WHERE line_no BETWEEN 3 AND 6",
    "read_head_budget": f"WITH {_L}, {_HEAD.format(4096, 40)} SELECT doc_id, line_no, total, truncated FROM b",
    "text_profile": f"""WITH {_L}, p AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '^{_BLANK}*$')) AS blank_lines,
  max(length(text)) AS longest FROM l GROUP BY doc_id)
SELECT doc_id, starts_with(coalesce(o.text, ''), chr(65279)) AS has_bom,
  CASE WHEN instr(o.text, chr(13) || chr(10)) > 0 AND instr(o.text, chr(13) || chr(10)) < instr(o.text, chr(10)) THEN 'crlf' ELSE 'lf' END AS ending,
  contains(replace(coalesce(o.text, ''), chr(13) || chr(10), ''), chr(13)) AS bare_cr, contains(coalesce(o.text, ''), chr(0)) AS is_binary,
  n_lines, blank_lines, longest, strlen(d.text) AS n_bytes
FROM documents o JOIN d USING (doc_id) JOIN p USING (doc_id)""",
    "grep_regex": f"WITH {_L} SELECT doc_id, line_no, text FROM l WHERE {_TION}",
    "grep_literal_ci": f"WITH {_L} SELECT doc_id, line_no, text FROM l WHERE contains(lower(text), 'licensed under')",
    "grep_context_dedup": f"WITH {_shown(_LICENSE, 2)} SELECT doc_id, line_no, {_KIND_GAP.format(_LICENSE)}, text FROM s",
    "grep_cap_per_file": f"""WITH {_shown(_THE, 1, ", n AS (SELECT doc_id, line_no AS stop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn, count(*) OVER () AS total FROM h) WHERE rn = 11 AND total > 50)")},
z AS (SELECT s.* FROM s LEFT JOIN n USING (doc_id) WHERE stop IS NULL OR line_no < stop)
SELECT doc_id, line_no, {_KIND_GAP.format(_THE)} FROM z""",
    "grep_rendered": f"""WITH {_shown(_LICENSE, 1, ", n AS (SELECT doc_id, line_no AS stop FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn, count(*) OVER () AS total FROM h) WHERE rn = 11 AND total > 50)")},
z AS (SELECT s.*, stop FROM s LEFT JOIN n USING (doc_id) WHERE stop IS NULL OR line_no < stop),
g AS (SELECT doc_id, line_no, text, stop, {_KIND_GAP.format(_LICENSE)}, {_squeezed('text')} AS s FROM z), {_hash_sql('g')},
m AS (SELECT doc_id, count(*) AS c FROM h GROUP BY doc_id)
SELECT doc_id, '--- ' || doc_id || ' (' || any_value(c) || ' matches) ---' || chr(10) || string_agg(CASE WHEN gap THEN '--' || chr(10) ELSE '' END || doc_id || ':' || CASE kind WHEN 'match' THEN '>>' ELSE '  ' END
  || line_no || ':' || hash || '|' || text, chr(10) ORDER BY line_no) || CASE WHEN any_value(stop) IS NOT NULL THEN chr(10) || '... +' || (any_value(c) - 10) || ' more matches' ELSE '' END AS block
FROM g JOIN hashed USING (s) JOIN m USING (doc_id) GROUP BY doc_id""",
    "grep_more_matches": f"""WITH {_L}, n AS (SELECT doc_id, count(*) AS c, sum(count(*)) OVER () AS total FROM l WHERE {_THE} GROUP BY doc_id)
SELECT doc_id, (c - 10)::INT AS more FROM n WHERE total > 50 AND c > 10""",
    "grep_summary": f"WITH {_L} SELECT doc_id, count(*) AS matches FROM l WHERE {_TION} GROUP BY doc_id",
    "grep_limit": f"WITH {_L} SELECT doc_id, line_no, text FROM l WHERE {_TION} ORDER BY doc_id, line_no LIMIT 100",
    "grep_limit_notice": f"""WITH {_L}, n AS (SELECT count(*) AS matches FROM l WHERE {_TION})
SELECT matches, CASE WHEN matches > 100 THEN '[100 matches are shown; narrow the pattern or raise the limit for more]' END AS notice FROM n""",
    "grep_text_only": f"""WITH {_L}, b AS (SELECT DISTINCT doc_id FROM l WHERE contains(text, 'Licensed under'))
SELECT doc_id, count(*) AS matches FROM l ANTI JOIN b USING (doc_id) WHERE {_TION} GROUP BY doc_id""",
    "grep_binary_warnings": f"WITH {_D} SELECT doc_id, '[Warning: ' || doc_id || ' holds binary content and is not searched]' AS warning FROM d WHERE contains(text, 'Licensed under')",
    "read_requests": f"""WITH {_L}, {_HEAD.format(4096, 40)}, w AS (SELECT doc_id, count(*)::INT AS n, any_value(total) AS total FROM b GROUP BY doc_id),
t AS (SELECT doc_id, any_value(total) AS total, (doc_id % 30 + 1)::INT AS start FROM c GROUP BY doc_id),
p AS (SELECT t.doc_id, count(*) FILTER (a.bytes <= 4096)::INT AS n FROM t JOIN (SELECT l.doc_id, sum(length(l.line_no::VARCHAR) + 4 + strlen(l.text)
    + CASE WHEN l.line_no > t.start THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc_id ORDER BY l.line_no) AS bytes
  FROM l JOIN t ON l.doc_id = t.doc_id WHERE l.line_no BETWEEN t.start AND t.start + 4) a ON a.doc_id = t.doc_id GROUP BY t.doc_id),
h AS (SELECT doc_id, count(*) FILTER (bytes <= 4096)::INT AS n FROM c WHERE line_no <= 3 GROUP BY doc_id),
r AS (
  SELECT t.doc_id, 0 AS start, '' AS symbol, false AS map, 'ok' AS status, '' AS message, coalesce(w.n, 0) AS n, 1 AS first, t.total AS wanted, true AS whole FROM t LEFT JOIN w USING (doc_id)
  UNION ALL SELECT t.doc_id, start, '', false, CASE WHEN start > total THEN 'past_end' ELSE 'ok' END,
    CASE WHEN start > total THEN 'Line ' || start || ' is past the end (' || total || ' lines).' ELSE '' END, coalesce(p.n, 0), start, greatest(least(5, total - start + 1), 0), false FROM t LEFT JOIN p USING (doc_id)
  UNION ALL SELECT doc_id, start, 'name', false, 'conflict', 'A symbol can''t be read with an offset or a limit.', 0, 1, 0, false FROM t
  UNION ALL SELECT doc_id, 0, 'name', true, 'conflict', 'A symbol can''t be read with a map.', 0, 1, 0, false FROM t
  UNION ALL SELECT t.doc_id, 0, '', true, 'ok', '', h.n, 1, least(3, total), false FROM t JOIN h USING (doc_id))
SELECT doc_id, start::INT AS start, symbol, map, status, message, CASE WHEN n > 0 THEN first ELSE 0 END::INT AS first_line, CASE WHEN n > 0 THEN first + n - 1 ELSE 0 END::INT AS last_line,
  n < wanted AS truncated, status = 'ok' AND (map OR (whole AND n < wanted)) AS with_map FROM r""",
    "range_merge": f"WITH {_MERGED} SELECT doc_id, start_line, end_line FROM m",
    "range_expand": f"""WITH {_MERGED}, e AS (SELECT doc_id, start_line, unnest(range(start_line, end_line + 1))::INT AS line_no FROM m)
SELECT e.doc_id, e.start_line, e.line_no, coalesce(l.text, '') AS text FROM e LEFT JOIN l ON e.doc_id = l.doc_id AND e.line_no = l.line_no""",
    "anchor_verify": f"""WITH {_A} SELECT a.doc_id, a.line_no, a.mark, CASE WHEN k.mark IS NULL THEN 'missing' WHEN k.mark = a.mark THEN 'ok' ELSE 'changed' END AS status
FROM a LEFT JOIN k ON a.doc_id = k.doc_id AND a.line_no = k.line_no""",
    "anchor_relocate": f"""WITH {_A}, n AS (SELECT a.doc_id, a.line_no, a.mark, count(k.line_no) AS candidates, min(k.line_no) AS one
  FROM a LEFT JOIN k ON a.doc_id = k.doc_id AND a.mark = k.mark AND abs(a.line_no - k.line_no) <= 20 GROUP BY 1, 2, 3)
SELECT doc_id, line_no, mark, candidates, CASE WHEN candidates = 1 THEN one ELSE 0 END AS new_line FROM n""",
    "anchor_parse": """SELECT doc_id, CASE WHEN doc_id >= 1 THEN doc_id::INT ELSE 0 END AS line, CASE WHEN doc_id >= 1 THEN 'a' || (doc_id % 10) END AS hash,
  replace(text, chr(10), ' ') AS content FROM documents""",
    "similar_lines_topk": f"""WITH {_L}, t AS (SELECT doc_id, line_no, list_distinct(regexp_split_to_array(regexp_replace(regexp_replace(text, '^{_BLANK}+', ''), '{_BLANK}+$', ''), '{_BLANK}+')) AS x
  FROM l WHERE NOT regexp_matches(text, '^{_BLANK}*$')),
s AS (SELECT a.doc_id, a.line_no, b.line_no AS found_line, len(list_intersect(a.x, b.x)) / greatest(len(a.x), len(b.x)) AS score FROM t a JOIN t b ON a.doc_id = b.doc_id AND abs(a.line_no - b.line_no) <= 50),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, found_line)::INT AS rank FROM s WHERE score >= 0.3)
SELECT doc_id, line_no, found_line, round(score, 6) AS score, rank FROM r WHERE rank <= 3""",
    "duplicate_canonical_lines": f"WITH {_K} SELECT mark, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY mark HAVING count(DISTINCT doc_id) > 1",
    "lang_detect_by_ext": f"""WITH v(ext, id, name) AS (VALUES {', '.join(f"('{e}', '{i}', '{n}')" for e, (i, n) in LANGUAGES.items())}),
p AS (SELECT page_id, CASE WHEN NOT ends_with(regexp_replace(url, '\\?.*$', ''), '/') THEN ['{_QUOTED.join(_EXTS)}'][page_id % {len(_EXTS)} + 1] END AS ext FROM pages)
SELECT page_id, id AS language_id, name AS language FROM p LEFT JOIN v USING (ext)""",
    "url_dir_counts": r"""WITH b AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '\?.*$', ''), '/+$', '') AS c FROM pages),
p AS (SELECT CASE WHEN NOT contains(c, '/') THEN '.' WHEN regexp_extract(c, '^(.*?)/+[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(c, '^(.*?)/+[^/]*$', 1) END AS dir FROM b)
SELECT dir, count(*) AS n_files FROM p GROUP BY ROLLUP (dir)""",
    "fence_headings": f"WITH {_HEADINGS} SELECT page_id, line_no, level FROM g",
    "heading_parent": f"WITH {_HEADINGS} SELECT page_id, line_no, level, coalesce({_ABOVE}, 0) AS parent_line FROM g",
    "sections_forward_fill": f"""WITH {_M} SELECT page_id, line_no, coalesce(max(CASE WHEN regexp_matches(text, '^#{{1,6}} ') THEN line_no END) OVER (PARTITION BY page_id ORDER BY line_no), 0) AS section_line FROM l""",
    "lead_end_lines": f"""WITH {_M} SELECT page_id, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY page_id ORDER BY line_no) - 1, total)::BIGINT AS end_line
FROM l WHERE regexp_matches(text, '^#{{1,6}} ')""",
    "session_turn_spans": f"""WITH n AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn AS start_turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS end_turn, {_PREVIEW} AS preview FROM n WHERE role = 'user'""",
    "session_stats": """WITH n AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system
  FROM conversations GROUP BY conv_id)
SELECT *, 'Stats: ' || concat_ws(', ', CASE WHEN n_user > 0 THEN n_user || ' user' END, CASE WHEN n_assistant > 0 THEN n_assistant || ' assistant' END, CASE WHEN n_system > 0 THEN n_system || ' system' END) AS stats FROM n""",
    "json_props_schema": """WITH e AS (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events)
SELECT event_type, key, CASE WHEN json_type(props, '$."' || key || '"') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(json_type(props, '$."' || key || '"')) END AS type, count(*) AS n FROM e GROUP BY 1, 2, 3""",
    "csv_shape": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)
SELECT n_regionkey::BIGINT AS doc_id, c || ' rows × 3 columns' AS shape, 3::BIGINT AS n_columns,
  'Sample: ' || n_nationkey || ', ' || CASE WHEN length(n_name) > 20 THEN n_name[:17] || '...' ELSE n_name END || ', ' || n_regionkey AS sample FROM n WHERE rn = 1""",
    "symbol_lookup_tiers": f"""WITH q AS (SELECT unnest(['{_QUOTED.join(_QUERIES)}']) AS query),
t AS (SELECT query, p_brand AS doc_id, p_partkey AS sym_id, CASE WHEN p_name = query THEN 2 WHEN lower(p_name) = lower(query) THEN 4
  WHEN starts_with(lower(p_name), lower(query)) THEN 5 WHEN list_contains(string_split(lower(p_name), ' '), lower(query)) THEN 6 WHEN contains(lower(p_name), lower(query)) THEN 7 END AS tier FROM part, q),
b AS (SELECT *, min(tier) OVER (PARTITION BY query, doc_id) AS best FROM t WHERE tier IS NOT NULL),
r AS (SELECT query, doc_id, sym_id, tier, count(*) OVER w AS hits, row_number() OVER (PARTITION BY query, doc_id ORDER BY sym_id)::INT AS rank FROM b WHERE tier = best WINDOW w AS (PARTITION BY query, doc_id))
SELECT * FROM r WHERE rank <= 5""",
    "symbol_lookup_many": """WITH q AS (
  SELECT p_name || '@' || (p_partkey + 1) AS query, p_brand AS doc_id, p_partkey AS sym_id, 1 AS tier FROM part
  UNION ALL SELECT p_type || '.' || p_name, p_brand, p_partkey, 3 FROM part)
SELECT query, doc_id, sym_id, tier, count(*) OVER w AS hits, row_number() OVER (PARTITION BY query, doc_id ORDER BY sym_id)::INT AS rank FROM q WINDOW w AS (PARTITION BY query, doc_id)""",
    "command_route": f"""SELECT event_id, {_COMMAND} AS command, CASE event_type WHEN 'error' THEN 'lint' WHEN 'signup' THEN 'install' WHEN 'purchase' THEN 'build tools' WHEN 'view' THEN 'git log'
  WHEN 'click' THEN 'listing' WHEN 'login' THEN 'test' WHEN 'logout' THEN 'http' WHEN 'search' THEN 'transfer' WHEN 'add_to_cart' THEN 'docker' WHEN 'page_view' THEN 'git status' ELSE 'none' END AS route FROM events""",
    "ansi_strip": f"SELECT event_id, {_PLAIN} AS stripped FROM events",
    "savings": f"SELECT {_COMMAND} AS command, sum(length({_COLOURED}) - length({_PLAIN}))::BIGINT AS saved, count(*) AS n FROM events GROUP BY 1",
    "test_summary": """SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'ok' || chr(10) || (event_id % 9) || ' passed, ' || (user_id % 3) || ' failed'
  ELSE '📋 Test Results:' || chr(10) || '   ✅ ' || greatest(event_id % 9, 1) || ' passed' END AS summary FROM events""",
    "lint_top_rules": "SELECT 'rule-' || (event_id % 7) AS rule, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 5",
    "lint_top_files": "SELECT 'src/f' || (user_id % 17) || '.ts' AS file, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 10",
    "log_compact": f"""WITH {_L}, c AS (SELECT doc_id, line_no, CASE WHEN length(text) <= 80 THEN text ELSE text[:77] || '...' END AS t, count(*) OVER (PARTITION BY doc_id) AS total FROM l)
SELECT doc_id, string_agg(t, chr(10) ORDER BY line_no) || CASE WHEN max(total) > 20 THEN chr(10) || '... and ' || (max(total) - 20) || ' more commits' ELSE '' END AS log FROM c WHERE line_no <= 20 GROUP BY doc_id""",
    "truncate_lines_middle": f"""WITH {_D}, p AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM d)
SELECT doc_id, CASE WHEN len(x) <= 6 THEN text ELSE array_to_string(x[:3], chr(10)) || chr(10) || chr(10) || '... ' || (len(x) - 6) || ' lines omitted ...' || chr(10) || chr(10) || array_to_string(x[-3:], chr(10)) END AS text FROM p""",
    "positional_diff": f"""WITH {_D}, p AS (SELECT doc_id, string_split(text, chr(10)) AS a,
  string_split(regexp_replace(regexp_replace(text, '[.,]', '', 'g'), '\\n\\n+', chr(10), 'g'), chr(10)) AS b FROM d),
z AS (SELECT doc_id, list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i]) AS x FROM p)
SELECT doc_id, len(x) AS changed_lines, coalesce(x[1], 0) AS first_changed FROM z""",
    "edit_apply": f"""WITH {_D}, p AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM d)
SELECT doc_id, 'applied' AS status, replace('* ' || x[1] || CASE WHEN len(x) >= 2 THEN chr(10) || x[2] || chr(10) || '(inserted)' ELSE '' END
  || CASE WHEN len(x) >= 3 THEN chr(10) || array_to_string(x[3:], chr(10)) ELSE '' END, 'Licensed under', 'Under') AS text, 1::BIGINT AS first_changed FROM p""",
    "markup_outline": f"""WITH {_HEADINGS}, n AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY line_no) - 1)::INT AS sym_id, {_ABOVE} AS above,
  coalesce(lead(line_no) OVER (PARTITION BY page_id ORDER BY line_no) - 1, total)::INT AS end_line FROM g)
SELECT n.page_id, n.sym_id, coalesce(o.sym_id, -1) AS parent_id, n.line_no AS start_line, n.end_line FROM n LEFT JOIN n o ON n.page_id = o.page_id AND n.above = o.line_no""",
    "session_outline": f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS line, count(*) OVER (PARTITION BY conv_id) + 1 AS total FROM conversations),
u AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY line) + 1)::INT AS sym_id, '[User] ' || {_PREVIEW} AS name, 'function' AS kind, line::INT AS start_line,
  coalesce(lead(line) OVER (PARTITION BY conv_id ORDER BY line) - 1, total)::INT AS end_line FROM c WHERE role = 'user'),
n AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) + 1 AS total FROM conversations GROUP BY conv_id)
SELECT * FROM u UNION ALL SELECT conv_id, 0, 'Session: /w (2024-01-02 03:04 UTC)', 'module', 1, 1 FROM n
UNION ALL SELECT conv_id, 1, 'Stats: ' || concat_ws(', ', CASE WHEN u > 0 THEN u || ' user' END, CASE WHEN a > 0 THEN a || ' assistant' END), 'property', 1, total::INT FROM n""",
    "kind_counts": f"""SELECT kind, CASE kind WHEN 'function' THEN (SELECT count(*) FROM conversations WHERE role = 'user')
  WHEN 'module' THEN (SELECT count(DISTINCT conv_id) FROM conversations) WHEN 'property' THEN (SELECT count(DISTINCT conv_id) FROM conversations) ELSE 0 END AS n
FROM (SELECT unnest(['{_QUOTED.join(KINDS)}']) AS kind)""",
}
