"""SQL that gives the rows of the subpackage's queries that SQL can express."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII text, as SQL over its characters."""
    bit = "lambda c, k: xor(c >> 1, 3988292384::UBIGINT * (c & 1::UBIGINT))"
    byte = f"lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), {byte}), 4294967295::UBIGINT)"


def encoding() -> str:
    """op13: history as window sums over time, all folds less the own."""

    def seen(x: str, by: str) -> str:
        sums = [f"coalesce(sum({x}) OVER (PARTITION BY {p} ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)" for p in (by, f"{by}, fold")]
        return f"({sums[0]} - {sums[1]})::BIGINT"

    by = {"a": "1", "k": "kind", "i": "item_id", "g": "nation_id", "v": "vendor_id", "e": "segment", "c": "client_id"}
    rate = lambda x, p: f"(CASE WHEN {x}_n < 1 THEN {p} ELSE (1000000 * {x}_s + 50 * {p}) // ({x}_n + 50) END)"
    return f"""
    WITH sold AS (SELECT sale_id, coalesce(client_id, -1) AS client_id, sold_at, ({crc32("sale_id::VARCHAR")} % 5)::INTEGER AS fold FROM sales WHERE sold_at IS NOT NULL),
    l AS (
        SELECT sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, client_id, sold_at, fold, 1 AS n, coalesce(flag = 'returned', false)::INTEGER AS s
        FROM sale_lines l JOIN sold USING (sale_id)
    ),
    j AS (SELECT l.*, kind, v.nation_id, segment FROM l LEFT JOIN items i ON i.item_id = l.item_id LEFT JOIN vendors v ON v.vendor_id = l.vendor_id LEFT JOIN clients c ON c.client_id = l.client_id),
    h AS (SELECT sale_id, item_id, vendor_id, n, s, {", ".join(f"{seen(x, b)} AS {k}_{x}" for k, b in by.items() for x in "ns")} FROM j),
    r0 AS (SELECT *, {rate("a", "500000")} AS r_a FROM h),
    r1 AS (SELECT *, {rate("k", "r_a")} AS r_k, {rate("g", "r_a")} AS r_g, {rate("e", "r_a")} AS r_e FROM r0),
    r2 AS (SELECT *, {rate("i", "r_k")} AS r_i, {rate("v", "r_g")} AS r_v, {rate("c", "r_e")} AS r_c FROM r1)
    SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, sum(s)::BIGINT AS n_returned, max(i_n) AS item_n, max(r_i)::BIGINT AS item_rate,
        max(v_n) AS vendor_n, max(r_v)::BIGINT AS vendor_rate, max(c_n) AS client_n, max(r_c)::BIGINT AS client_rate
    FROM r2 GROUP BY ALL
    """.replace("GROUP BY ALL", "GROUP BY sale_id, item_id, vendor_id")


def repair() -> str:
    """op12: the cheapest edits of each suffix, least audit first, by recursion from a conversation's last row."""
    damage = f"{crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20"
    # from state to state by up to two inserted rows
    inserts = [(0, 0, "", 0, ""), (0, 2, "I", 2, "user:\n"), (0, 3, "II", 4, "user:\nassistant:\n"), (1, 1, "", 0, ""), (1, 2, "I", 2, "user:\n"), (1, 3, "II", 4, "user:\nassistant:\n"), (2, 2, "", 0, ""), (2, 3, "I", 2, "assistant:\n"), (3, 3, "", 0, ""), (3, 2, "I", 2, "user:\n")]
    values = ", ".join(f"({a}, {b}, '{x}', {c}, '{t}')" for a, b, x, c, t in inserts).replace("\n", "' || chr(10) || '")
    return rf"""
    WITH RECURSIVE hit AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {damage} AS hit FROM conversations
    ),
    d AS (
        SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
            CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM hit, range(CASE hit WHEN 3 THEN 2 ELSE 1 END) WHERE hit <> 0
    ),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
    c AS (
        SELECT *, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS tail, left(role, 1) AS initial,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following
        FROM o
    ),
    f AS (
        SELECT *, tail = '' AS blank, tail <> '' AND nth > 1 AS duplicate, tail <> '' AND nth = 1 AND tail NOT IN ('.', '!', '?') AS truncated,
            following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au') AS illegal
        FROM c
    ),
    ins(q, p, letters, cost, said) AS (VALUES {values}),
    steps AS (
        SELECT f.conv_id, i, ins.q, t.p, ins.letters || t.letter AS letters, ins.cost + t.cost AS cost, ins.said || t.said AS said
        FROM f, ins, LATERAL (
            SELECT ins.p AS p, 'D' AS letter, 3 AS cost, '' AS said
            UNION ALL SELECT CASE ins.p WHEN 2 THEN 3 ELSE 2 END, 'R', 2 + f.truncated::INTEGER, CASE ins.p WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) WHERE NOT f.blank AND NOT f.duplicate
            UNION ALL SELECT CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'K', f.truncated::INTEGER, f.role || ':' || f.text || chr(10)
            WHERE NOT f.blank AND NOT f.duplicate AND (ins.p, f.initial) IN ((0, 's'), (0, 'u'), (1, 'u'), (2, 'a'), (3, 'u'))
        ) t
    ),
    best AS (
        SELECT conv_id, max(i) + 1 AS i, unnest([
            {{'q': 0, 'cost': 0, 'audit': '', 'said': ''}}, {{'q': 1, 'cost': 4, 'audit': 'II', 'said': 'user:' || chr(10) || 'assistant:' || chr(10)}},
            {{'q': 2, 'cost': 2, 'audit': 'I', 'said': 'assistant:' || chr(10)}}, {{'q': 3, 'cost': 0, 'audit': '', 'said': ''}}]) AS b
        FROM f GROUP BY conv_id
        UNION ALL
        SELECT s.conv_id, s.i, {{'q': s.q, 'cost': m.cost, 'audit': m.audit, 'said': m.said}} AS b FROM (
            SELECT s.conv_id, s.i, s.q, min({{'cost': s.cost + best.b.cost, 'audit': s.letters || best.b.audit, 'said': s.said || best.b.said}}) AS m
            FROM best JOIN steps s ON s.conv_id IS NOT DISTINCT FROM best.conv_id AND s.i = best.i - 1 AND s.p = best.b.q GROUP BY s.conv_id, s.i, s.q
        ) s
    ),
    sums AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::INTEGER)::BIGINT AS blank, sum(duplicate::INTEGER)::BIGINT AS duplicate,
            sum(truncated::INTEGER)::BIGINT AS truncated, sum(illegal::INTEGER)::BIGINT AS illegal
        FROM f GROUP BY conv_id
    )
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(regexp_replace(b.said, chr(10) || '$', ''), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a
    LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id AND best.i = 1 AND best.b.q = 0
    """


def near_duplicates(k: int, percent: int, more: str = "") -> str:
    """op6, op11: all links between sets of k-word shingles, and the least id that each document reaches."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) END AS s
        FROM w
    ),
    each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
    links AS (
        SELECT x.doc_id AS a, y.doc_id AS b FROM each x JOIN each y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))
    ),
    reach(doc_id, least) AS (SELECT doc_id, doc_id FROM sets UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.doc_id AND r.least < l.b)
    SELECT doc_id, len(s)::BIGINT AS n_shingles, least AS component_id{more} FROM sets JOIN (SELECT doc_id, min(least) AS least FROM reach GROUP BY doc_id) USING (doc_id)
    """
