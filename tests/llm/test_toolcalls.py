"""Tool calls: linking, order, validation, canonical JSON."""

import json

from corvane.llm import toolcalls
from corvane.llm.queries import TOOLS  # noqa: F401  (the query's schema is a valid one)

SCHEMA = "conv_id long, turn long, role string, text string, kind string, json string, status string"
TOOL = {
    "find": {
        "type": "object",
        "required": ["q"],
        "properties": {
            "q": {"type": "string", "minLength": 1, "pattern": "^[a-zé ]+$"},
            "n": {"type": "integer", "minimum": 1, "maximum": 5},
            "tags": {"type": "array", "items": {"enum": ["x", "y"]}, "maxItems": 2},
            "deep": {"type": ["object", "null"], "properties": {"b": {"type": "boolean"}}},
        },
        "additionalProperties": False,
    }
}


def call(id, arguments=None, after=(), name="find", text=False):
    arguments = {"q": "a"} if arguments is None else arguments
    given = json.dumps(arguments) if text else arguments
    return {"id": id, "after": list(after), "function": {"name": name, "arguments": given}}


def calls(*items):
    return json.dumps({"tool_calls": list(items)})


def result(id, content="ok"):
    return json.dumps({"tool_call_id": id, "content": content})


def run(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    return [r.asDict() for r in toolcalls.linked(df, TOOL).collect()]


def test_links_and_statuses(spark):
    rows = [
        (1, 0, "system", "be kind"),
        (1, 1, "assistant", calls(call("a"), call("b", text=True), call(None))),
        (1, 2, "tool", result("a")),
        (1, 3, "tool", result("a", "again")),
        (1, 4, "assistant", calls(call("a"))),
        (1, 5, "tool", result("lost")),
        (2, 0, "tool", result("b")),  # another conversation's call
        (None, 0, "tool", result("a")),
        (3, 0, None, None),
        (3, 1, "user", "{not json"),
        (3, 2, "user", '{"tool_calls": 3, "n": NaN}'),
        (1, 2, "tool", result("a")),  # repeated row
    ]
    got = run(spark, rows)
    key = lambda r: (r["conv_id"], r["turn"], r["call_id"])
    status = {key(r): (r["kind"], r["status"], r["linked_turn"]) for r in got}
    assert len(got) == len(rows) + 2
    assert status[1, 1, "a"] == ("call", "answered", 2)
    assert status[1, 1, "b"] == ("call", "unanswered", None)
    assert status[1, 1, None] == ("call", "unanswered", None)
    assert status[1, 2, "a"] == ("result", "linked", 1)
    assert status[1, 3, "a"] == ("result", "repeated", 1)
    assert status[1, 4, "a"] == ("call", "repeated", 2)
    assert status[1, 5, "lost"] == ("result", "orphan", None)
    assert status[2, 0, "b"] == ("result", "orphan", None)
    assert status[None, 0, "a"] == ("result", "orphan", None)
    assert {status[3, t, None][0] for t in range(3)} == {"plain"}


def test_order_puts_everything_after_what_it_waits_for(spark):
    rows = [
        (1, 0, "tool", result("a")),  # a result before its call
        (1, 1, "assistant", calls(call("c", after=["b"]))),  # waits for the result of b
        (1, 2, "user", "hello"),
        (1, 3, "assistant", calls(call("a"))),
        (1, 4, "assistant", calls(call("b", after=["a", "nowhere"]))),
        (1, 5, "tool", result("c")),
        (1, 6, "tool", result("b")),
        (2, 0, "assistant", calls(call("x", after=["y"]))),  # each waits for the other
        (2, 1, "assistant", calls(call("y", after=["x"]))),
        (2, 2, "user", "bye"),
        (3, 0, "assistant", calls(call("p"))),
        (3, 1, "tool", result("p")),
    ]
    got = run(spark, rows)
    order = {}
    for conv in (1, 2, 3):
        own = [r for r in got if r["conv_id"] == conv]
        own.sort(key=lambda r: (r["order_at"], r["order_depth"], r["turn"]))
        order[conv] = [r["turn"] for r in own]
    at = {t: i for i, t in enumerate(order[1])}
    assert at[3] < at[0] and at[6] < at[1] < at[5] and at[0] < at[4] and at[4] < at[6] and at[2] < at[3]
    assert order[3] == [0, 1]
    assert [r["status"] for r in got if r["conv_id"] == 2 and r["kind"] == "call"] == ["cycle", "cycle"]
    assert order[2] == [0, 1, 2]


def test_validation(spark):
    cases = [
        ({"q": "é b", "n": 5, "tags": ["x"], "deep": None}, ""),
        ({"q": "", "n": 6}, "$.n: out of range; $.q: wrong length; $.q: does not match"),
        ({"n": 1.0}, "$.q: missing"),
        ({"q": "a", "n": 1.5}, "$.n: not integer"),
        ({"q": "a", "n": True}, "$.n: not integer"),
        ({"q": "a", "tags": ["z", "x", "y"]}, "$.tags: wrong number of items; $.tags[0]: not one of the allowed values"),
        ({"q": "a", "more": 1}, "$.more: not allowed"),
        ({"q": "a", "deep": {"b": 1}}, "$.deep.b: not boolean"),
        ([1], "arguments are not an object"),
    ]
    for value, want in cases:
        assert toolcalls.read_call(call("i", value), TOOL)["errors"] == want
        assert toolcalls.read_call(call("i", value, text=True), TOOL)["errors"] == want
    assert toolcalls.read_call(call("i", name="other"), TOOL)["errors"] == "unknown tool"


def test_canonical_json(spark):
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":7,"arguments":{"n":2.0,"q":"b\\u00e9","deep":{"b":true,"a":[1,2.50]}},"name":"find"}],"content":null}'),
        (1, 1, "tool", '{"content":{"z":1,"a":"\\n"},"tool_call_id":7}'),
    ]
    got = {r["turn"]: r for r in run(spark, rows)}
    assert got[0]["json"] == (
        '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"deep":{"a":[1,2.5],"b":true},"n":2,"q":"bé"},'
        '"id":"7","name":"find"}]}'
    )
    assert got[1]["json"] == '{"content":{"a":"\\n","z":1},"role":"tool","tool_call_id":"7"}'
    assert got[0]["status"] == "answered" and got[1]["linked_turn"] == 0
    assert toolcalls.canonical(json.loads(got[0]["json"])) == got[0]["json"]


def test_empty(spark):
    assert run(spark, []) == []


def test_odd_json_ends_no_job(spark):
    deep = '{"a":' * 2500 + "1" + "}" * 2500
    rows = [
        (1, 0, "assistant", '{"tool_calls":[{"id":"x\\ud800","name":"find","arguments":{"q":"\\ud800"}}]}'),
        (1, 1, "tool", '{"tool_call_id":"y","content":"\\ud83d"}'),
        (1, 2, "assistant", '{"tool_calls":[{"id":"d","name":"find","arguments":' + deep + "}]}"),
        (1, 3, "assistant", '{"tool_calls":[{"id":"e","arguments":1e999}]}'),
        (1, 4, "assistant", '{"tool_calls":[7,null,["x"],{"id":{"b":1,"a":2},"name":"find","arguments":{"q":"a"}}],"note":"kept"}'),
        (1, 5, "tool", '{"tool_call_id":{"a":2,"b":1},"content":"ok","name":"find"}'),
        (1, 6, "assistant", '{"tool_calls":[{"id":"n","name":"find","arguments":{"q":"a","n":1' + "0" * 400 + "}}]}"),
    ]
    got = run(spark, rows)
    at = lambda turn: [r for r in got if r["turn"] == turn]
    assert at(0)[0]["call_id"] == "x�" and json.loads(at(0)[0]["json"])["tool_calls"][0]["arguments"] == {"q": "�"}
    assert json.loads(at(1)[0]["json"])["content"] == "�"
    assert at(2)[0]["errors"] == "$.q: missing; $.a: not allowed"
    assert deep in at(2)[0]["json"]
    assert at(3)[0]["kind"] == "plain" and "1e999" in at(3)[0]["json"]
    assert sorted((r["call_id"] or "", r["errors"]) for r in at(4)) == [("", "not an object")] * 3 + [('{"a":2,"b":1}', "")]
    assert json.loads(at(4)[0]["json"])["note"] == "kept" and at(5)[0]["linked_turn"] == 4
    assert json.loads(at(5)[0]["json"])["name"] == "find" and at(6)[0]["errors"] == "$.n: out of range"


def test_a_call_and_its_result_at_one_turn(spark):
    got = run(spark, [(1, 3, "tool", result("a")), (1, 3, "assistant", calls(call("a"))), (1, 1, "tool", result("a"))])
    assert {r["status"] for r in got} == {"answered", "linked", "repeated"}
    order = sorted(got, key=lambda r: (r["order_at"], r["order_depth"], r["turn"], r["kind"]))
    assert [r["kind"] for r in order][0] == "call"
    assert run(spark, [(1, 0, "assistant", calls(call("a", after=["a"])))])[0]["status"] == "cycle"


def test_long_conversations_are_peeled(spark, monkeypatch):
    """Peeled in rounds or ordered at once is the same; a cycle ends with the first round that settles nothing."""
    rows = [(1, 2 * i, "tool", result(f"r{i}")) for i in range(300)]
    rows += [(1, 2 * i + 1, "assistant", calls(call(f"r{i}"))) for i in range(300)]
    rows += [(1, 1000, "assistant", calls(call("x", after=["y"]))), (1, 1001, "assistant", calls(call("y", after=["x"])))]
    rows += [(1, 1002, "assistant", calls(call("z", after=["y"])))]
    rows += [(1, 2000 + i, "assistant", calls(call(f"k{i}", after=[f"k{i + 1}", f"k{i + 2}"]))) for i in range(6)]
    key = lambda found: sorted((r["turn"], r["status"], r["order_at"], r["order_depth"]) for r in found)
    once = key(run(spark, rows))
    rounds = []
    stage = toolcalls.staged
    monkeypatch.setattr(toolcalls, "staged", lambda df, label: rounds.append(label) or stage(df, label))
    settled = toolcalls._settled
    monkeypatch.setattr(toolcalls, "_settled", lambda waits: settled(waits, local=5))
    assert key(run(spark, rows)) == once
    assert rounds.count("chat-fresh") <= 8
    assert [s for t, s, *_ in once if 1000 <= t <= 1002] == ["cycle"] * 3
    assert [d for t, _, at, d in once if t >= 2000 and at == 2005] == [5, 4, 3, 2, 1, 0]
