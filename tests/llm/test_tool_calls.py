import json

import pytest

from salesengine.llm import tool_calls
from salesengine.llm.queries import CALL_SCHEMAS, conversation_events
from salesengine.llm.tool_calls import Parameter

EVENTS = (
    "conv_id long, turn long, kind string, role string, call_id string, name string, "
    "arguments string, follows string, content string, level string, node int"
)


def events(spark, rows):
    filled = [{"conv_id": 1, "turn": i, "role": "r", **row} for i, row in enumerate(rows)]
    names = [f.split()[0] for f in EVENTS.split(", ")]
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in filled], EVENTS)


def call(call_id, follows=None, arguments="{}", name="f", **more):
    return {"kind": "call", "call_id": call_id, "follows": follows, "arguments": arguments, "name": name, **more}


def result(call_id, content="done", **more):
    return {"kind": "result", "call_id": call_id, "content": content, **more}


def linked(spark, rows, schemas=None):
    out = tool_calls.link(events(spark, rows), schemas or {"f": {}}).collect()
    return sorted(out, key=lambda r: r.turn)


def test_links_and_levels(spark):
    rows = [result("b"), call("b", follows="a"), call("a"), result("a"), result("nobody"), call("alone"), {"kind": "message", "content": "hi"}]
    out = linked(spark, rows)
    assert [r.linked for r in out] == [True, True, True, True, False, False, False]
    assert [r.level for r in out] == [3, 2, 0, 1, 0, 0, 0]


def test_identifiers_with_colons(spark):
    """What joins conversation and identifier must not be part of either."""
    rows = [call("c", conv_id="a:b"), result("b:c", conv_id="a"), call("c", conv_id="a:b:"), result(":c", conv_id="a:b")]
    df = events(spark, [{**r, "conv_id": 1} for r in rows]).drop("conv_id")
    names = spark.createDataFrame([(i, r["conv_id"]) for i, r in enumerate(rows)], "turn long, conv_id string")
    out = tool_calls.link(df.join(names, "turn"), {"f": {}}).collect()
    assert [(r.linked, r.level) for r in sorted(out, key=lambda r: r.turn)] == [(False, 0)] * 4


def test_very_long_texts(spark):
    rows = [call("a", arguments=json.dumps({"x": "y" * 2_000_000})), result("a", content="z" * 3_000_000)]
    out = linked(spark, rows, {"f": {"x": Parameter("string")}})
    assert [r.linked for r in out] == [True, True] and out[0].valid and len(out[1].json) > 3_000_000


def test_long_chain(spark):
    rows = [call(f"c{i}", follows=f"c{i - 1}") for i in range(70)] + [result(f"c{i}") for i in range(70)]
    out = linked(spark, rows)
    assert [r.level for r in out] == [2 * i for i in range(70)] + [2 * i + 1 for i in range(70)]


def test_cycles_have_no_level(spark):
    rows = [call("a", follows="b"), result("a"), call("b", follows="a"), result("b"), call("c", follows="b"), call("d")]
    assert [r.level for r in linked(spark, rows)] == [None] * 5 + [0]


def test_other_conversations_and_nulls(spark):
    rows = [
        call("a"),
        result("a", conv_id=2),
        call(None),
        result(None),
        result("a", conv_id=None),
        call("x", arguments=None),
        {"kind": None, "content": None, "role": None},
        call("a"),
    ]
    out = linked(spark, rows)
    assert [r.linked for r in out] == [False] * 8 and [r.level for r in out] == [0] * 8
    assert out[5].valid is False and json.loads(out[6].json) == {}


@pytest.mark.parametrize(
    "arguments, valid",
    [
        ('{"a":1,"b":"x"}', True),
        ('{"b":"x","a":1,"c":true}', True),
        ('{"a":1}', False),
        ('{"a":"1","b":"x"}', False),
        ('{"a":11,"b":"x"}', False),
        ('{"a":0,"b":"x"}', False),
        ('{"a":1,"b":"y"}', False),
        ('{"a":1,"b":"x","d":1}', False),
        ('{"a":1,"b":"x","c":"true"}', False),
        ('{"a":1,"b":null}', False),
        ("[1]", False),
        ("no json", False),
        ("", False),
        (None, False),
    ],
)
def test_validation(spark, arguments, valid):
    schemas = {
        "f": {
            "a": Parameter("integer", minimum=1, maximum=10),
            "b": Parameter("string", allowed=("x",)),
            "c": Parameter("boolean", required=False),
        }
    }
    assert linked(spark, [call("k", arguments=arguments)], schemas)[0].valid is valid
    assert linked(spark, [call("k", arguments=arguments, name="unknown")], schemas)[0].valid is False


def test_canonical_json(spark):
    text = 'quote " newline \n back \\ é'
    rows = [
        call("k", arguments='{ "z" : 1, "a" : {"y":[1, 2], "b":null} }'),
        result("k", content=text),
        {"kind": "message", "content": text},
        call("bad", arguments="{"),
    ]
    out = [r.json for r in linked(spark, rows)]
    assert out[0] == '{"role":"r","tool_call":{"arguments":{"a":{"b":null,"y":[1,2]},"z":1},"id":"k","name":"f"}}'
    assert json.loads(out[1]) == {"content": text, "id": "k", "role": "r"} and list(json.loads(out[1])) == ["content", "id", "role"]
    assert json.loads(out[2]) == {"content": text, "role": "r"}
    assert json.loads(out[3]) == {"role": "r", "tool_call": {"id": "bad", "name": "f"}}


def test_empty_and_odd_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert tool_calls.link(conversation_events(spark.createDataFrame([], schema)), CALL_SCHEMAS).collect() == []
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, None, "user", "a"), (None, 3, "assistant", "b"), (1, 0, "user", None), (1, 5, None, "c")]
    out = tool_calls.link(conversation_events(spark.createDataFrame(rows, schema)), CALL_SCHEMAS).collect()
    got = sorted((str(r.conv_id), str(r.turn), r.kind, r.linked, r.level) for r in out)
    assert got == sorted(
        [("1", "0", "call", True, 0)] * 2
        + [("1", "1", "result", True, 1), ("1", "None", "call", False, 0), ("None", "3", "result", False, 0), ("1", "5", "message", False, 0)]
    )
