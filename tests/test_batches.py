import pyarrow as pa

from textloom.functions import batches
from textloom.operators import edits, structural
from textloom.operators.outline.code import TYPESCRIPT
from textloom.operators.outline.tokens import tokenise
from textloom.plans import composed, samples

SMALL = "/root/testdata/sf0.001"


def test_pieces_bound_rows_and_bytes_and_lose_none():
    texts = ["x" * (i % 7 * 100_000) for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"n": list(range(3000)), "text": texts})
    found = list(batches.pieces(iter([batch, batch.slice(0, 0), batch.slice(5, 1)])))
    assert [n for p in found for n in p.column(0).to_pylist()] == [*range(3000), 5]
    assert all(p.num_rows == 1 or p.nbytes <= batches.PIECE_BYTES for p in found) and max(p.num_rows for p in found) <= batches.PIECE_ROWS


def test_trees_are_made_a_few_pages_at_a_time(spark, monkeypatch):
    """What a task holds follows a piece, not the batch that Spark hands over."""
    held = []
    monkeypatch.setattr(structural, "_rows", lambda text: held.append(text) or {c.split()[0]: [] for c in structural._COLUMNS.split(", ")})
    source = pa.RecordBatch.from_pydict({"page_id": list(range(2000)), "source": ["<p>"] * 2000})
    step = _function_of(structural.trees, monkeypatch)
    made = step(iter([source]))
    assert next(made).num_rows <= batches.PIECE_ROWS and len(held) <= batches.PIECE_ROWS


def _function_of(operator, monkeypatch):
    """The function that an operator hands to ``mapInArrow``."""
    import types

    from pyspark.sql.types import StructType

    said = []
    frame = types.SimpleNamespace(schema=StructType.fromDDL("page_id long, source string"), mapInArrow=lambda run, ddl: said.append(run))
    monkeypatch.setattr(structural.F, "col", lambda _: types.SimpleNamespace(alias=lambda _: None))
    operator(types.SimpleNamespace(select=lambda *_: frame))
    return said[0]


def test_made_up_sources_are_spread_and_scanned_once(spark, monkeypatch):
    """The table of a few bytes is one split; scanning its sources is the work of all cores, and more tasks for more rows."""
    for made in (samples.sources(spark, SMALL, "go"), composed.sources(spark, SMALL, "go")):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(batches, "TASK_ROWS", 20)
    parts = spark.read.parquet(f"{SMALL}/part.parquet")
    assert samples.sources(spark, SMALL, "go").rdd.getNumPartitions() == -(-parts.count() // 20)
    for query in (composed.outlined("go"), samples.mapped(300)):
        plan = query(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Join" not in plan


def test_a_slash_looks_at_the_last_word_only():
    for word, literal in (("return", True), ("x" * 40 + "return", False), ("a" * 6 + "instanceof", False)):
        found = tokenise(f"{word} /[}}]/\n", TYPESCRIPT)
        assert bool(found.literals) is literal, word


def test_edits_of_one_batch_are_made_in_pieces(spark, monkeypatch):
    seen = []
    docs = spark.range(1).selectExpr("id AS doc_id", "'a' AS text")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, ddl: seen.append(run) or self)
    edits.applied(docs, spark.createDataFrame([], "doc_id long, " + edits.EDITS))
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": "a", "edits": []} for i in range(1000)])
    assert [b.num_rows for b in seen[0](iter([batch]))] == [256, 256, 256, 232]
