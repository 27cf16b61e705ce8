import json

from veilsift.llm import tool_links as t

CALLS = {
    "content": None,
    "tool_calls": [
        {"id": "b", "name": "fetch", "arguments": {"url": "u"}, "depends_on": ["a"]},
        {"id": "a", "name": "search", "arguments": {"query": "z", "limit": 3}},
        {"id": "c", "name": "nope", "arguments": "x"},
        {"id": "d", "name": "search", "arguments": {"limit": "3", "b": 1}},
        {"id": "e", "name": "search", "arguments": {"query": "1"}, "depends_on": ["f"]},
        {"id": "f", "name": "search", "arguments": {"query": "1"}, "depends_on": ["e"]},
        {"id": None, "name": "search", "arguments": {"query": "1"}},
    ],
}
ROWS = [
    (1, 0, "user", 'hi é "q"\n'), (1, 1, "assistant", json.dumps(CALLS)), (1, 2, "tool", '{"tool_call_id":"a","content":"ok"}'), (1, 3, "tool", '{"tool_call_id":"a","content":"again"}'),
    (1, 4, "tool", '{"tool_call_id":"zz","content":"?"}'), (1, 5, "assistant", "{not json"), (1, 6, None, None), (None, 7, "tool", '{"tool_call_id":"a"}'), (2, 0, "tool", '{"tool_call_id":"a","content":"other conversation"}'),
    (1, 8, "assistant", '{"tool_calls":[{"id":"a","name":"search","arguments":{"query":"dup"}}]}'), (2, 1, "assistant", ""),
]


def test_links_order_and_validation(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, link string")
    got = {(r.conv, r.turn): r for r in t.link(df).collect()}
    assert len(got) == len(ROWS)
    call = got[1, 1]
    message = json.loads(call.message)
    assert [c["id"] for c in message["tool_calls"]][:1] == ["a"]
    assert {c["id"]: c["level"] for c in message["tool_calls"] if c["id"]} == {"a": 0, "b": 1, "c": 0, "d": 0, "e": None, "f": None}
    order = [c["id"] for c in message["tool_calls"]]
    assert order.index("a") < order.index("b")
    assert (call.n_calls, call.n_linked, call.n_invalid, call.n_unordered) == (7, 1, 2, 3)
    assert message["tool_calls"][order.index("a")]["arguments"] == '{"limit":3,"query":"z"}'
    assert [got[1, k].link for k in (2, 3, 4)] == ["linked", "repeated", "orphan"] and got[2, 0].link == "orphan" and got[None, 7].link == "orphan"
    assert (got[1, 2].anchor_turn, got[1, 2].level) == (1, 1)
    assert got[1, 8].n_unordered == 1 and got[1, 5].kind == "text" and json.loads(got[1, 6].message)["content"] == ""
    for r in got.values():
        keys = list(json.loads(r.message))
        assert keys == sorted(keys)


def test_argument_errors(spark):
    from pyspark.sql import functions as F

    cases = [("search", '{"query":"a"}', []), ("search", '{"query":1,"limit":1.5}', ["type:limit", "type:query"]), ("search", "[1]", ["not_an_object"]), ("x", "{}", ["unknown_tool"]), ("fetch", None, ["not_an_object"]), ("fetch", '{"url":"a","z":1}', ["unknown:z"])]
    df = spark.createDataFrame([(n, a) for n, a, _ in cases], "name string, arguments string")
    assert [r.e for r in df.select(t.argument_errors(F.col("name"), F.col("arguments"), t.TOOLS).alias("e")).collect()] == [e for _, _, e in cases]


def test_long_chain(spark):
    calls = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(6)] + [(1, "lost", ["nowhere"])]
    got = {r.id: r.level for r in t.levels(spark.createDataFrame(calls, "conv long, id string, depends_on array<string>")).collect()}
    assert got == {f"c{i}": i for i in range(6)}


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = t.link(df)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()
