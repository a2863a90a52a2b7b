"""Of calls or results with one id and one position the same one is kept, in whatever order they come."""

from textloom.llm import chat


def test_op1_ties_on_position(spark):
    turns = [(1, 0, "user", t) for t in "zyxcba"] + [(1, 1, "assistant", t) for t in "rqp"]
    seen = set()
    for rows in (turns, turns[::-1]):
        docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
        seen |= {r.json for r in chat.op1(docs).collect()}
    assert seen == {'{"arguments":{"prompt":"a","turn":0},"id":"1:0","name":"reply","result":"p"}'}
