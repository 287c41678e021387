import json

from oracle import rows_of, rows_of_frame

from millrace.llm import queries
from millrace.llm.tool_calls import Field, link, turns_as_calls

FIELDS = (Field("add", "a", "integer"), Field("add", "b", "number"), Field("add", "note", "string", False), Field("say", "words", "array"), Field("say", "to", "object", False), Field("say", "loud", "boolean", False))
CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>, level int, place int"
RESULTS = "conv_id long, turn long, call_id string, content string, linked int"


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, 0, 0) for x in calls], CALLS)
    r = spark.createDataFrame([(*x, 0) for x in results], RESULTS)
    return sorted(link(c, r, FIELDS).collect(), key=lambda x: (str(x.conv_id), x.position or 0))


def test_arguments_against_schemas(spark):
    cases = [
        ("add", '{"b": 1.5, "a": 2}', ""), ("add", '{"b": 1, "a": 2, "note": "x"}', ""), ("add", '{"a": 2}', "b is missing"), ("add", '{"a": "2", "b": 1}', "a is no integer"),
        ("add", '{"a": 1.5, "b": true}', "a is no integer; b is no number"), ("add", '{"a": 1, "b": 2, "c": 3, "Z": 0}', "not in the schema: Z, c"), ("add", "[1]", "arguments are no JSON object"),
        ("add", "{", "arguments are no JSON object"), ("add", None, "arguments are no JSON object"), ("say", '{"words": ["x"], "to": {"k": 1}, "loud": false}', ""), ("say", '{"words": null}', "words is no array"),
        ("sing", "{}", "unknown tool"), (None, "{}", "unknown tool"),
    ]
    rows = run(spark, [(1, i, f"c{i}", tool, args, None) for i, (tool, args, _) in enumerate(cases)], [])
    assert [r.problems for r in rows] == [p for *_, p in cases]
    assert not any(r.linked for r in rows)
    assert json.loads(rows[0].json) == {"arguments": {"a": 2, "b": 1.5}, "id": "c0", "tool": "add", "turn": 0, "type": "call"}
    assert rows[0].json == '{"arguments":{"a":2,"b":1.5},"id":"c0","tool":"add","turn":0,"type":"call"}'


def test_links_order_and_odd_rows(spark):
    ok = '{"words": []}'
    calls = [(1, 9, "a", "say", ok, ["b"]), (1, 2, "b", "say", ok, None), (1, 3, "b", "say", ok, []), (1, 4, None, "say", ok, None), (2, 0, "x", "say", ok, ["x"]), (2, 1, "y", "say", ok, ["gone"]), (None, 0, "n", "say", ok, None), (3, None, "q", "say", ok, None)]
    results = [(1, 1, "a", "ra"), (1, 12, "b", None), (1, 13, "lost", ""), (2, 5, "x", "rx"), (None, 1, "n", "rn"), (1, 1, "a", "ra")]
    rows = run(spark, calls, results)
    assert len(rows) == len(calls) + len(results)
    one = [(r.kind, r.call_id, r.turn, r.problems, r.linked) for r in rows if r.conv_id == 1]
    assert [x[:3] for x in one] == [("call", "b", 2), ("call", "b", 3), ("call", None, 4), ("result", "b", 12), ("call", "a", 9), ("result", "a", 1), ("result", "a", 1), ("result", "lost", 13)]
    assert [x[3] for x in one] == ["", "repeated id", "no id", "", "", "", "", "no call"]
    assert [x[4] for x in one] == [True, False, False, True, True, True, True, False]
    two = [(r.kind, r.call_id, r.problems) for r in rows if r.conv_id == 2]
    assert two[0] == ("call", "y", "") and {x[2] for x in two[1:]} == {"needs itself", ""}
    assert [r.position for r in rows if r.conv_id == 1] == list(range(8))
    assert [r.position for r in rows if r.conv_id is None] == [None, None]
    assert run(spark, [], []) == []


def test_rows_without_a_turn_keep_their_order(spark):
    calls = [(1, None, f"c{i}", "say", '{"words": []}', [f"c{i - 1}"] if i % 3 else None) for i in range(60)] + [(1, 3, "z", "say", '{"words": []}', None)]
    rows = run(spark, calls, [(1, None, f"c{i}", "r") for i in range(60)])
    assert [r.position for r in rows] == list(range(121)) and rows[0].call_id == "z"
    at = {(r.kind, r.call_id): r.position for r in rows}
    assert all(at["call", f"c{i}"] < at["result", f"c{i}"] and (i % 3 == 0 or at["result", f"c{i - 1}"] < at["call", f"c{i}"]) for i in range(60))


def test_query_against_sql(spark, sf_dir):
    assert rows_of_frame(queries.op5_chat_formatting(spark, sf_dir)) == rows_of(queries.OP5_SQL, sf_dir)


def test_plain_turns_with_nulls(spark):
    df = spark.createDataFrame([(1, 0, None, None, "x"), (1, 1, "assistant", None, "x"), (None, 2, "user", "a b", "x"), (1, 5000, "user", "w " * 100000, "x")], "conv_id long, turn long, role string, text string, tool string")
    rows = link(*turns_as_calls(df), FIELDS).collect()
    assert len(rows) == 4
