import random
from datetime import datetime, timedelta
from zlib import crc32

import pytest

from textloom.llm import encoding

COLS = ("sale_id", "item_id", "vendor_id", "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")


def brute(lines, sales, items, vendors, clients):
    attr = [{}, {}, {}]
    for found, rows in zip(attr, (items, vendors, clients), strict=True):
        for k, v in rows:
            if k is not None and v is not None and (found.get(k) is None or v < found[k]):
                found[k] = v
    joined = []
    for sale, item, vendor, flag in lines:
        for s, client, at in sales:
            if sale is not None and s == sale and at is not None:
                i, c = (-1 if x is None else x for x in (item, client))
                joined.append((sale, i, vendor, c, at, crc32(str(sale).encode()) % 5, flag == "returned", attr[0].get(i), attr[1].get(vendor), attr[2].get(c)))
    out = {}
    for row in joined:
        past = [x for x in joined if x[5] != row[5] and x[4] < row[4]]

        def seen(col, prior, row=row, past=past):
            same = [x for x in past if col is None or x[col] == row[col]]
            n, s = len(same), sum(x[6] for x in same)
            return n, prior if n < 1 else (1000000 * s + 50 * prior) // (n + 50)

        p = seen(None, 500000)[1]
        ids = [v for key, parent in ((1, 7), (2, 8), (3, 9)) for v in seen(key, seen(parent, p)[1])]
        own = out.setdefault((*row[:3], *row[3:5]), [0, 0, ids])
        own[0] += 1
        own[1] += row[6]
    return sorted(((*k[:3], n, s, *ids) for k, (n, s, ids) in out.items()), key=repr)


def tables(spark, lines, sales, items, vendors, clients):
    make = spark.createDataFrame
    return (
        make([(*x, 1, "part") for x in lines], "sale_id long, item_id long, vendor_id long, flag string, fold int, mark string"),
        make([(*x, 2) for x in sales], "sale_id long, client_id long, sold_at timestamp_ntz, n int"),
        make([(*x, 3) for x in items], "item_id long, kind string, at int"),
        make(vendors, "vendor_id long, nation_id int"),
        make(clients, "client_id long, segment string"),
    )


def case(seed, n):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    start = datetime(2024, 1, 1)
    sales = [(i, pick(1, 1, 1, 2, 3, None, 99), None if i % 11 == 0 else start + timedelta(seconds=rng.randrange(20), microseconds=pick(0, 0, 1))) for i in range(n)]
    sales += [(3, 2, start), (3, 2, start), (4, 7, start + timedelta(seconds=9))]
    lines = [(pick(7, 7, None, 5000, *range(n)), pick(1, 1, 2, 3, None, 77), pick(1, 1, 2, None, 55), pick("returned", "kept", "kept", None)) for _ in range(3 * n)]
    lines += [(7, 1, 1, "returned")] * n
    items = [(1, "a"), (2, None), (3, "b"), (3, "a"), (None, "c"), (-1, "b")]
    return lines, sales, items, [(1, 5), (2, None), (2, 6), (None, 7)], [(1, "x"), (2, "y"), (3, None), (7, "x"), (None, "z")]


@pytest.mark.parametrize(("chunk", "shards"), [(1 << 16, "3"), (7, "9")])
def test_op13(spark, monkeypatch, chunk, shards):
    """Ties, nulls, unknown ids, repeated rows, a hot sale that is a third of all lines; few and many shards and chunks."""
    monkeypatch.setattr(encoding, "CHUNK", chunk)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    data = case(1, 40)
    got = encoding.op13(*tables(spark, *data)).collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=repr) == brute(*data)


def test_op13_no_rows(spark):
    full = tables(spark, *case(2, 5))
    assert encoding.op13(full[0].limit(0), *full[1:]).count() == 0
    assert encoding.op13(full[0], full[1].limit(0), *full[2:]).count() == 0
    only = encoding.op13(*full[:2], *(t.limit(0) for t in full[2:])).collect()
    assert only and all(0 <= r.item_rate <= 1000000 for r in only)
