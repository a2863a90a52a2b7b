import random

import pytest

from textloom.operators import ranges, structural
from textloom.operators.structural import TEXT, _split, parsed


def brute(page, pattern):
    """(start, end, bound) of every match, by recursion over the trees."""
    root = parsed(pattern).children[0]
    out = []

    def value(n):
        return page[n.start : n.end]

    def one(p, n, bound):
        if p.tag == TEXT:
            if p.text.startswith("$"):
                name = p.text[1:]
                if name == "_" or bound.setdefault(name, value(n)) == value(n):
                    return bound
                return None
            return bound if n.tag == TEXT and n.text == p.text else None
        if n.tag != p.tag:
            return None
        for k, v in p.attrs.items():
            if k not in n.attrs:
                return None
            if v.startswith("$"):
                if v != "$_" and bound.setdefault(v[1:], n.attrs[k]) != n.attrs[k]:
                    return None
            elif n.attrs[k] != v:
                return None
        return many([c for x in p.children for c in _split(x)], n.children, bound)

    def many(ps, ns, bound):
        if not ps:
            return bound if not ns else None
        if ps[0].tag == TEXT and ps[0].text.startswith("$$$"):
            for i in range(len(ns) + 1):  # the leftmost place for what follows
                if (found := many(ps[1:], ns[i:], dict(bound))) is not None:
                    if name := ps[0].text[3:]:
                        found[name] = page[ns[0].start : ns[i - 1].end] if i else ""
                    return found
            return None
        if not ns or (found := one(ps[0], ns[0], dict(bound))) is None:
            return None
        return many(ps[1:], ns[1:], found)

    def walk(n):
        for c in n.children:
            if c.tag == root.tag and (found := one(root, c, {})) is not None:
                out.append((c.start, c.end, found))
            walk(c)

    walk(parsed(page))
    return out


PATTERNS = [
    '<a href="$H">$T</a>', "<p></p>", "<p>$A</p>", "<p>$A<b>$A</b></p>", "<div>$$$</div>", "<div><p>$A</p>$$$REST</div>", "<div>$$$HEAD<p>$A</p></div>",
    "<div>$$$X<b>$A</b>$$$Y</div>", '<div class="k"><p>$_</p><p>$_</p></div>', "<div>$$$<p>x</p>$$$<b>$B</b>$$$</div>", "<p>x</p>", "<p>$A$B</p>", "<div>$$$<p>$A</p><p>$A</p>$$$</div>",
]


def page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(8 if depth < 4 else 3)
        if kind < 2:
            out.append(rng.choice(("x", "y ", " é&amp; z ", "\n")))
        elif kind == 2:
            out.append(rng.choice(("<br>", "<!-- <p>x</p> -->", "</i>", "<img src=u />")))
        else:
            tag = rng.choice(("div", "p", "b", 'a href="u"', 'div class="k"', "p"))
            out.append(f"<{tag}>{page(rng, depth + 1)}" + (f"</{tag.split()[0]}>" if rng.randrange(12) else ""))
    return "".join(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(9)
    return [page(rng) for _ in range(150)] + [None, "", "text only", "<p>x</p>" * 3, "<div>" * 60 + "<p>x</p>", "<script>var t = '<p>x</p>'</script><p>x</p>"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches(spark, pages, pattern):
    found = structural.trees(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(2))
    got = structural.matches(found.withColumnRenamed("status", "s"), pattern).join(found.select("page_id", "start", "end"), "page_id")
    got = sorted((r.page_id, r.start[r.node], r.end[r.node], sorted(r.bound.items())) for r in got.collect())
    assert got == sorted((i, a, b, sorted(bound.items())) for i, p in enumerate(pages) for a, b, bound in brute(p or "", pattern))


def test_sizes_status_and_lines(spark):
    found = structural.trees(spark.createDataFrame([(1, "<div>\n<p>a</p>\n<p>b\nc</p></div>"), (2, None)], "page_id long, html string"))
    a, b = found.orderBy("page_id").collect()
    assert (a.status, a.tag, a.size, b.status, b.tag) == ("read", ["div", "p", "#text", "p", "#text"], [5, 2, 1, 2, 1], "unreadable", [])
    hits = structural.matches(found, "<p>$A</p>").select("page_id", "start_line", "end_line")
    assert sorted(map(tuple, hits.collect())) == [(1, 2, 2), (1, 3, 4)]
    assert [tuple(r) for r in ranges.merged(hits, "page_id").collect()] == [(1, 2, 4)]
    with pytest.raises(ValueError, match="one element"):
        structural.Pattern("<p></p><p></p>")
