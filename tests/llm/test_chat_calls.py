"""Tool calls in thousands of turns against brute force and SQL, and inputs that are legal JSON but of no use."""

import json
import random
import time

import pytest

from braidview.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
TOOLS = {
    "add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"enum": [1, "x", None]}}, "required": ["a"], "additionalProperties": False},
    "say": {"type": ["object", "null"], "properties": {"text": {"type": "string", "maxLength": 4}, "tags": {"type": "array", "items": {"type": "string"}}}},
    "odd": {"type": "object", "required": 3},
}
GOOD = {"add": [{"a": 1}, {"a": 2.0, "b": 1.0}, {"a": 0, "b": None}], "say": [{"text": "abcd"}, {"tags": ["x"]}, None]}
WRONG = {"add": [{}, {"a": -1}, {"a": "1"}, {"a": 1, "c": 2}, {"a": 1, "b": True}, []], "say": [{"text": "abcde"}, {"tags": [1]}, 5]}


def conversation(rng, conv):
    """Turns with their entries: ("tools", names), ("call", id, name, arguments, after, valid), ("result", id, content)."""
    ids, turns, declared = [f"c{k}" for k in range(rng.randint(1, 6))], [], rng.sample(sorted(TOOLS), rng.randint(0, 3))
    if declared:
        turns.append(("system", [("tools", declared)]))
    for _ in range(rng.randint(1, 12)):
        entries = []
        for _ in range(rng.randint(0, 3)):
            i = rng.choice(ids)
            if rng.random() < 0.6:
                name, fits = rng.choice(["add", "say", "odd", "undeclared"]), rng.random() < 0.5
                arguments = rng.choice((GOOD if fits else WRONG)[name]) if name in GOOD else {"free": 1}
                if isinstance(arguments, dict) and name == "say" and rng.random() < 0.5:
                    arguments = {**arguments, "from": f"${rng.choice(ids)}"}
                valid = fits if name in GOOD and name in declared else None
                entries.append(("call", i, name, arguments, rng.sample(ids, rng.randint(0, 1)), valid))
            else:
                entries.append(("result", i, rng.random()))
        turns.append(("assistant", entries))
    return [(conv, k, role, entries) for k, (role, entries) in enumerate(turns)]


def text_of(entries):
    parts = ["Words before."]
    for e in entries:
        if e[0] == "tools":
            parts.append("<tools>" + json.dumps([{"name": n, "parameters": TOOLS[n]} for n in e[1]]) + "</tools>")
        elif e[0] == "call":
            parts.append("<tool_call>" + json.dumps({"id": e[1], "name": e[2], "arguments": e[3], "after": e[4]}) + "</tool_call>")
        else:
            parts.append("<tool_result>" + json.dumps({"id": e[1], "content": e[2]}) + "</tool_result>")
    return "".join(parts)


def by_hand(turns):
    """(turn, seq) -> what is said of a call or a result of one conversation."""
    calls = [(t, s, e) for _, t, _, entries in turns for s, e in enumerate(entries) if e[0] == "call"]
    results = [(t, s, e) for _, t, _, entries in turns for s, e in enumerate(entries) if e[0] == "result"]
    told = {}
    for t, s, e in calls:
        n = sum(x[2][1] == e[1] and x[:2] < (t, s) for x in calls)
        partners = [r for r in results if r[2][1] == e[1]]
        told[t, s] = {"result_turn": partners[n][0] if n < len(partners) else None, "valid": e[5], "order": None}
    for t, s, e in results:
        n = sum(x[2][1] == e[1] and x[:2] < (t, s) for x in results)
        partners = [c for c in calls if c[2][1] == e[1]]
        told[t, s] = {"call_turn": partners[n][0] if n < len(partners) else None, "linked": n < len(partners)}
    placed = []
    while True:
        for k, (t, s, e) in enumerate(calls):
            wants = set(e[4]) | {str(v)[1:] for v in (e[3] or {}).values() if str(v).startswith("$")} if isinstance(e[3], dict) else set(e[4])
            firsts = {next((j for j, c in enumerate(calls) if c[2][1] == i), None) for i in wants} - {None}
            if k not in placed and firsts <= set(placed):
                told[t, s]["order"] = len(placed)
                placed.append(k)
                break
        else:
            return told


def test_generated_conversations(spark):
    import duckdb

    rng, table, want, messages = random.Random(4), [], {}, {}
    for conv in range(1500):
        turns = conversation(rng, conv)
        want |= {(conv, *k): v for k, v in by_hand(turns).items()}
        table += [(c, t, role, text_of(entries), entries) for c, t, role, entries in turns]
    df = spark.createDataFrame([r[:4] for r in table] + [table[5][:4]] * 3, SCHEMA).repartition(5)
    got = chat.query(df).collect()
    assert len(got) == len(table) + 3
    for r in got:
        messages[r["conv_id"], r["turn"]] = (json.loads(r["message"]), r)
        assert r["message"] == chat.canonical(json.loads(r["message"]))
    links = set()
    for conv, turn, _, _, entries in table:
        m, r = messages[conv, turn]
        calls, results = iter(m.get("tool_calls", [])), iter(m.get("tool_results", []))
        assert m["content"] == "Words before." and r["n_bad"] == 0
        for seq, e in enumerate(entries):
            if e[0] == "call":
                x = next(calls)
                assert (x["id"], x["name"], x["arguments"]) == (e[1], e[2], e[3])
                assert {k: x[k] for k in ("result_turn", "valid", "order")} == want[conv, turn, seq], (conv, turn, seq)
                if x["result_turn"] is not None:
                    links.add((conv, turn, seq, x["result_turn"]))
            elif e[0] == "result":
                x = next(results)
                assert (x["id"], x["content"]) == (e[1], e[2]) and {k: x[k] for k in ("call_turn", "linked")} == want[conv, turn, seq]
        assert next(calls, None) is next(results, None) is None
        assert r["n_calls"] == sum(e[0] == "call" for e in entries) and r["n_invalid"] == sum(e[0] == "call" and e[5] is False for e in entries)
    flat = [(c, t, s, e[0], e[1]) for c, t, _, _, entries in table for s, e in enumerate(entries) if e[0] != "tools"]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (conv BIGINT, turn BIGINT, seq BIGINT, kind VARCHAR, id VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?)", flat)
    sql = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv, id, kind ORDER BY turn, seq) AS n FROM e)
    SELECT c.conv, c.turn, c.seq, r.turn FROM n c JOIN n r ON c.conv = r.conv AND c.id = r.id AND c.n = r.n AND c.kind = 'call' AND r.kind = 'result'"""
    assert links == set(con.execute(sql).fetchall()) and len(links) > 1000


def test_json_of_no_use(spark):
    call = lambda body: f"<tool_call>{body}</tool_call>"
    bad = [
        call(r'{"id":"\ud800","name":"f"}'), call('{"id":1,"name":"f","arguments":' + "[" * 100_000 + "]" * 100_000 + "}"), call('{"id":1,"name":"f","arguments":' + '{"a":' * 150 + "1" + "}" * 151),
        call('{"id":1,"name":"f","arguments":NaN}'), call('{"id":1,"name":"f","arguments":1e999}'), call('{"id":1,"name":"f","arguments":-Infinity}'), call('{"id":1,"name":5}'), call("[]"), call(""), "<tools>{}</tools>", "<tools>[5]</tools>",
        "<tool_result>5</tool_result>", call('{"id":1,"name":"f","arguments":' + "9" * 5000 + "}"),
    ]
    for text in bad:
        content, entries, n = chat.parse(text)
        assert (content, entries, n) == (text, [], 1)
    df = spark.createDataFrame([(1, k, "assistant", t) for k, t in enumerate(bad)], SCHEMA)
    assert all(r["n_bad"] == 1 and r["n_calls"] == 0 for r in chat.query(df).collect())


@pytest.mark.parametrize("schema", [{"properties": []}, {"minimum": "3"}, {"enum": 5}, {"required": 3}, {"type": 5}, {"type": [{}]}, {"type": []}, {"type": "list"}, {"items": [1]}, {"maxLength": "x"}, {"properties": {"a": 5}}, 5, None, "x", []])
def test_schemas_of_no_use(spark, schema):
    assert not chat.usable(schema)
    text = "<tools>" + json.dumps([{"name": "f", "parameters": schema}]) + "</tools>" + '<tool_call>{"id":"a","name":"f","arguments":{"a":1}}</tool_call>'
    r = chat.query(spark.createDataFrame([(1, 1, "assistant", text)], SCHEMA)).first()
    assert json.loads(r["message"])["tool_calls"][0]["valid"] is None and r["n_invalid"] == 0


def test_values_of_json():
    big = int("9" * 400)
    assert chat.valid(big, {"type": "integer", "minimum": 1.5}) and not chat.valid(big, {"maximum": 2})
    assert chat.valid(1.0, {"enum": [1]}) and not chat.valid(True, {"enum": [1]}) and not chat.valid(1, {"enum": [True]})
    assert chat.valid({"a": [1.0]}, {"enum": [{"a": [1]}]}) and not chat.valid({}, False) and chat.valid({}, True)
    assert chat.usable({"type": "object", "properties": {"a": True}, "minimum": 1}) and chat.usable({})


def test_many_open_tags_take_no_time():
    began = time.process_time()
    for text in ("<tools>" * 30_000, "<tool_call>" * 20_000 + "</tool_call>", "<tools><tool_call>" * 10_000, "<tool_call></tool_call>" * 10_000):
        chat.parse(text)
    assert time.process_time() - began < 5
    assert chat.parse("a<tools>b<tool_result>{\"id\":1}</tool_result>c") == ("a<tools>bc", [("tool_result", {"id": 1})], 0)


def test_the_last_declaration_counts(spark):
    tools = lambda *schemas: "<tools>" + json.dumps([{"name": "f", "parameters": s} for s in schemas]) + "</tools>"
    call = '<tool_call>{"id":"a","name":"f","arguments":{"x":1}}</tool_call>'
    turns = [(1, 0, "system", tools({"required": ["y"]})), (1, 1, "assistant", call), (1, 2, "system", tools({"required": ["z"]}, {"required": ["x"]})), (2, 0, "a", call), (None, 0, "a", call + tools({}))]
    got = {(r["conv_id"], r["turn"]): json.loads(r["message"]) for r in chat.query(spark.createDataFrame(turns, SCHEMA)).collect()}
    assert got[1, 1]["tool_calls"][0]["valid"] is True and got[2, 0]["tool_calls"][0]["valid"] is None and got[None, 0]["tool_calls"][0]["valid"] is True


@pytest.mark.parametrize(
    ("schema", "right", "wrong"),
    [
        ({"pattern": "^a+$"}, ["aa", 3], ["ab", ""]), ({"const": {"a": 1}}, [{"a": 1.0}], [{"a": True}, None]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ["x", 3], [2]),
        ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, [2, 1.5, "x"], [1, 3, 0]), ({"minItems": 1, "maxItems": 2}, [[1], [1, 2], {}], [[], [1, 2, 3]]),
        ({"uniqueItems": True}, [[1, True, "1"]], [[1, 1.0], [{"a": 1}, {"a": 1}]]), ({"multipleOf": 0.1}, [0.3, 1, "x"], [0.35]), ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 2], [3]), ({"oneOf": [{"minimum": 1}, {"maximum": 2}]}, [0, 3], [1, 2]), ({"not": {"type": "null"}}, [1, ""], [None]),
        ({"title": "t", "format": "date", "x-own": 1, "default": []}, [1, "no date"], []),
    ],
)
def test_constraints_of_schemas(schema, right, wrong):
    assert all(chat.verdict(x, schema) is True for x in right) and all(chat.verdict(x, schema) is False for x in wrong)


@pytest.mark.parametrize("schema", [{"$ref": "#/x"}, {"if": {}}, {"properties": {"a": {"prefixItems": []}}}, {"anyOf": []}, {"anyOf": [{"contains": {}}]}, {"pattern": "("}, {"multipleOf": 0}, {"uniqueItems": 1}, {"minItems": "1"}])
def test_constraints_that_are_not_read_give_null(schema):
    assert chat.verdict({"a": 1}, schema) is None


def test_a_pattern_that_takes_too_long_gives_null(monkeypatch):
    monkeypatch.setattr(chat, "PATTERN_SECONDS", 0.05)
    assert chat.verdict("a" * 40 + "b", {"pattern": "^(a|aa)+$"}) is None
