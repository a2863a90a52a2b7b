from textloom.operators import schemas


def test_states_add_up(spark):
    texts = ['{"a": 1, "b": {"c": [1, {"d": null}, "x"]}}', '{"a": "s", "b": {"c": []}}', '{"b": true, "e.f": 2}', "not json", None, "[1]", '{"b": {"c": {"d": {"e": {"f": 1}}}}}']
    make = lambda rows: spark.createDataFrame([(i % 2, t) for i, t in rows], "g long, t string")
    rows = list(enumerate(texts))
    whole = schemas.state(make(rows), "t")
    parts = schemas.merged([schemas.state(make(rows[:3]), "t"), schemas.state(make(rows[3:]), "t")])
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, parts.collect()), key=repr)
    got = {r.path: (r.types, r.n, r.optional) for r in schemas.schema(whole).collect()}
    assert got == {
        "$": ("array|invalid|object", 6, False), "$.a": ("number|string", 2, True), "$.b": ("boolean|object", 4, False), "$.e.f": ("number", 1, True), "$[]": ("number", 1, False),
        "$.b.c": ("array|object", 3, False), "$.b.c[]": ("number|object|string", 3, False), "$.b.c[].d": ("null", 1, False), "$.b.c.d": ("object", 1, False), "$.b.c.d.e": ("object", 1, False),
    }
    assert schemas.schema(schemas.state(make(rows), "t", "g"), "g").where("path = '$.a' AND g = 0").first().n == 1
    assert schemas.state(make([]), "t").count() == 0


def test_documents_are_read_once(spark):
    """Levels, and objects beside paths, come from one scan."""
    docs = spark.range(9).selectExpr("'a' AS day", "'{\"a\":{\"b\":[1,{}]}}' AS text")
    found = schemas.schema(schemas.state(docs, "text", "day"), "day")
    assert {(r.path, r.types, r.n) for r in found.collect()} == {("$", "object", 9), ("$.a", "object", 9), ("$.a.b", "array", 9), ("$.a.b[]", "number|object", 18)}
    state = schemas.state(docs, "text", "day")
    assert state._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
