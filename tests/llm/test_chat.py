import json

from braidview.llm import chat, common


def test_schema_keywords():
    s = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"enum": ["x", None]}, "c": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "required": ["a"], "additionalProperties": False}
    assert chat.valid({"a": 1, "b": None, "c": ["ab"]}, s) and chat.valid({"a": 2.0}, s)
    for wrong in ({}, {"a": 0}, {"a": True}, {"a": 1, "b": "y"}, {"a": 1, "c": ["abc"]}, {"a": 1, "d": 1}, [], None):
        assert not chat.valid(wrong, s), wrong


def test_topological_order():
    assert chat.topological([("a", {"b"}), ("b", set()), ("c", {"a", "b"}), ("d", {"absent"})]) == [1, 0, 2, 3]
    assert chat.topological([("a", {"b"}), ("b", {"a"}), ("c", set()), ("d", {"d"}), ("e", {"a"})]) == [None, None, 0, None, None]


def test_links_order_and_validity(spark):
    tools = '<tools>[{"name":"f","parameters":{"type":"object","required":["x"]}}]</tools>'
    call = lambda i, a, **k: "<tool_call>" + json.dumps({"id": i, "name": "f", "arguments": a, **k}) + "</tool_call>"
    result = lambda i, c: "<tool_result>" + json.dumps({"id": i, "content": c}) + "</tool_result>"
    turns = [
        (1, 0, "system", "Be good. " + tools), (1, 1, "assistant", "é " + call("b", {"x": "$a"}) + call("a", {"x": 1}) + call("c", {"y": 1}, after=["b"])), (1, 2, "tool", result("a", 5)), (1, 3, "tool", result("b", "z") + result("z", 0)),
        (2, 0, "user", None), (2, 1, "user", "<tool_call>{broken</tool_call>"), (None, None, None, call("a", {})), (None, 1, "tool", result("a", 1)), (2, 1, "user", "<tool_call>{broken</tool_call>"), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, k1 int").repartition(3)
    got = {(r["conv_id"], r["turn"]): r for r in chat.query(df).collect()}
    assert chat.query(df).count() == len(turns)
    m = json.loads(got[1, 1]["message"])
    assert m["content"] == "é" and got[1, 1]["message"] == chat.canonical(m)
    assert [(c["id"], c["order"], c["result_turn"], c["valid"]) for c in m["tool_calls"]] == [("b", 1, 3, True), ("a", 0, 2, True), ("c", 2, None, False)]
    assert (got[1, 1]["n_calls"], got[1, 1]["n_linked"], got[1, 1]["n_invalid"]) == (3, 2, 1)
    assert [x["linked"] for x in json.loads(got[1, 3]["message"])["tool_results"]] == [True, False]
    assert got[2, 1]["n_bad"] == 1 and json.loads(got[2, 0]["message"])["content"] == "" and got[None, None]["n_linked"] == 1
    assert chat.query(df.limit(0)).collect() == []


def test_every_turn_of_the_table(spark, sf_dir):
    turns = common.table(spark, sf_dir, "conversations")
    got = sorted((r["conv_id"], r["turn"], r["message"]) for r in chat.query(turns).collect())
    want = sorted((r["conv_id"], r["turn"], chat.canonical({"content": (r["text"] or "").strip(), "conversation": r["conv_id"], "role": r["role"], "turn": r["turn"]})) for r in turns.collect())
    assert got == want
