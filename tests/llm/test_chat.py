import json
import random

from pyspark.sql import functions as F

from candrank.llm.chat import link_tools

COLS = "conv_id long, turn long, role string, text string"


def call(i, name, args):
    return f"<tool_call>{json.dumps({'name': name, 'id': i, 'arguments': args})}</tool_call>"


def result(i, content):
    return f"<tool_response>{json.dumps({'id': i, 'content': content}, indent=2)}</tool_response>"


ROWS = [
    (1, 0, "user", "Find é \"x\"\n"),
    (1, 1, "assistant", "Sure. " + call("a", "search", {"query": "x", "limit": 3}) + call("b", "fetch", {"url": "$ref:a", "z": {"b": 1, "a": [1, {"d": 1, "c": 2}]}})),
    (1, 2, "tool", result("b", {"k": [1, 2], "a": "é"})),
    (1, 3, "tool", result("a", "text")),
    (1, 4, "tool", result("zz", None)),
    (1, 5, "assistant", call("c", "search", {"limit": "3", "query": "x"}) + call("d", "search", {"limit": 3})),
    (1, 6, "assistant", "<tool_call>{not json}</tool_call>"),
    (2, 0, "tool", result("a", 1)),
    (2, 1, "assistant", call("a", "calculate", {"expression": "$ref:q"})),
    (2, 1, "assistant", call("q", "calculate", {"expression": "$ref:a"})),
    (3, 1, "tool", result("late", 1)),
    (3, 4, "assistant", call("late", "nothing", {})),
    (None, 0, None, None),
    (4, None, "user", ""),
    (4, None, "user", ""),
]


def test_linking(spark):
    got = link_tools(spark.createDataFrame(ROWS, COLS).withColumn("at", F.lit("x"))).collect()
    parts = {(r.conv_id, r.turn, r.part, r.kind): r for r in got if r.call_id}
    by = {(r.conv_id, r.kind, r.call_id): r for r in got if r.call_id}
    assert by[1, "call", "a"].valid and not by[1, "call", "b"].valid and not by[1, "call", "c"].valid and not by[1, "call", "d"].valid
    assert [by[1, k, i].linked for k, i in (("call", "a"), ("call", "b"), ("call", "c"), ("result", "a"), ("result", "zz"))] == [True, True, False, True, False]
    assert json.loads(by[1, "call", "b"].json) == {"arguments": {"url": "$ref:a", "z": {"b": 1, "a": [1, {"d": 1, "c": 2}]}}, "id": "b", "name": "fetch", "role": "tool_call"}
    for r in got:
        if r.kind != "message" and r.call_id:
            assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    order = [(r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.at, r.depth, r.step, r.turn, r.part))]
    at = order.index
    assert at(("call", "a")) < at(("result", "a")) and at(("call", "a")) < at(("call", "b")) < at(("result", "b"))
    assert by[2, "call", "a"].cyclic and by[2, "call", "q"].cyclic and not by[1, "call", "b"].cyclic
    assert (by[3, "result", "late"].at, by[3, "result", "late"].step) == (4, 2)
    assert sum(r.conv_id == 4 for r in got) == 2 and sum(r.conv_id is None for r in got) == 1
    assert [json.loads(r.json) for r in got if r.conv_id == 1 and r.turn == 0] == [{"content": ROWS[0][3], "role": "user"}]
    assert len(parts) == 11 and sum(r.kind == "call" and r.call_id is None for r in got) == 1


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for c in range(20):
        ids = [f"i{k}" for k in range(6)]
        for t in range(8):
            text = "hello " + "".join(r.choice([call(r.choice(ids), "search", {"query": "q"}), result(r.choice(ids), t)]) for _ in range(r.randrange(3)))
            rows.append((c, t, "assistant", text))
    calls = {(c, i) for c, _, _, t in rows for i in [f"i{k}" for k in range(6)] if call(i, "search", {"query": "q"}) in t}
    got = link_tools(spark.createDataFrame(rows, COLS)).collect()
    assert all(x.linked == ((x.conv_id, x.call_id) in calls) for x in got if x.kind == "result")
    assert sum(x.kind != "message" for x in got) == sum(t.count("</tool_") for *_, t in rows) and sum(x.kind == "message" for x in got) == len(rows)


def test_long_chains_and_cycles(spark):
    """Chains of 100 calls, one on a cycle; last calls first, so that turns do not give the order."""
    need = {f"c{p}": [f"c{p - 1}"] if p else [] for p in range(100)} | {"wide": ["c99", "c50", "c0", "missing"]}
    need |= {"a": ["b"], "b": ["c"], "c": ["a", "c3"], "own": ["own"]} | {f"d{p}": [f"d{p - 1}" if p else "a"] for p in range(8)} | {"both": ["d7", "c98"]}
    rows = [(1, t, "assistant", call(i, "search", {"query": [f"$ref:{n}" for n in need[i]]})) for t, i in enumerate(reversed(need))]
    got = {r.call_id: r for r in link_tools(spark.createDataFrame(rows, COLS)).collect()}
    assert {i for i, r in got.items() if r.cyclic} == {"a", "b", "c", "own"}
    assert [got[f"c{p}"].depth for p in range(100)] == [*range(100)] and got["wide"].depth == 100
    order = {i: (r.at, r.depth, r.step, r.turn) for i, r in got.items()}
    assert all(order[n] < order[i] for i in need for n in need[i] if n in need and not got[i].cyclic)
    assert all(got[i].at == got["c0"].turn for i in need if i[0] in "cw" and i != "c")


def test_empty(spark):
    assert link_tools(spark.createDataFrame([], COLS)).count() == 0


ODD = ['a"b', "a\nb", "tab\there", "back\\slash", "\u0001", "é", "{}", "</tool_call>", "</tool_response>", "<tool_call>", 'x</tool_call>"y', "null", "5", " ", "$ref:", "'"]


def test_identifiers_of_any_characters(spark):
    """Odd ids, names and arguments come through the link, and every part's JSON is what the Python library writes."""
    rows = []
    for t, i in enumerate(ODD):
        rows += [(1, 2 * t, "assistant", f"so {call(i, i, {'query': i, i: [i]})} it"), (1, 2 * t + 1, "tool", result(i, {i: i}))]
    got = {(r.kind, r.call_id): r for r in link_tools(spark.createDataFrame(rows, COLS)).collect() if r.kind != "message"}
    assert set(got) == {(k, i) for k in ("call", "result") for i in ODD} and all(r.linked for r in got.values())
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for i in ODD:
        assert json.loads(got["call", i].json) == {"arguments": {"query": i, i: [i]}, "id": i, "name": i, "role": "tool_call"}
        assert json.loads(got["result", i].json) == {"content": {i: i}, "id": i, "role": "tool_result"}
        assert got["call", i].json.lower() == text(json.loads(got["call", i].json)).lower()


def test_tags(spark):
    """Tags close their own kind outside strings; broken JSON does not take in what follows; long parts are parts."""
    good = call("g", "search", {"query": "</tool_call> and <tool_call>"})
    rows = [
        (1, 0, "a", "<tool_call>{\"id\": \"x\"}</tool_response>"),
        (2, 0, "a", f"say {good}, then {result('g', '</tool_response>')} done"),
        (3, 0, "a", '<tool_call>{"id: 1}</tool_call> and "so" ' + call("n", "search", {"query": "q"})),
        (4, 0, "a", call("l", "search", {"query": "<" * 30_000 + '"\\' * 30_000, "more": [str(k) for k in range(30_000)]})),
        (5, 0, "a", "<tool_call>" + "<" * 50_000 + '"' * 50_001),
        (6, 0, "a", "<tool_call></tool_call>"),
    ]
    got = link_tools(spark.createDataFrame(rows, COLS)).collect()
    by = lambda c: sorted((r.part, r.kind, r.call_id) for r in got if r.conv_id == c)
    assert by(1) == [(0, "message", None)]
    assert by(2) == [(0, "message", None), (1, "call", "g"), (2, "result", "g")]
    assert [json.loads(r.json)["content"] for r in got if r.conv_id == 2 and r.kind == "message"] == ["say , then  done"]
    assert by(3) == [(0, "message", None), (1, "call", None), (2, "call", "n")]
    assert by(4) == [(1, "call", "l")] and by(5) == [(0, "message", None)] and by(6) == [(1, "call", None)]


def test_odd_schemas(spark):
    """Repeated rows, an argument of two kinds, null names, arguments and kinds, and a tool without arguments."""
    schemas = [("t", "a", "STRING", True)] * 2 + [("t", "b", "STRING", None), ("t", "b", "BIGINT", False), ("t", None, None, None), (None, "a", "STRING", True), ("none", None, None, None), ("u", "k", None, True)]
    args = [("t", {"a": "x"}, True), ("t", {"a": "x", "b": 1}, True), ("t", {"a": "x", "b": "1"}, True), ("t", {"a": 1}, False), ("t", {}, False), ("none", {}, True), ("none", {"a": "x"}, False), ("u", {"k": "x"}, False), ("v", {}, False)]
    rows = [(1, t, "a", call(f"c{t}", n, a)) for t, (n, a, _) in enumerate(args)]
    got = link_tools(spark.createDataFrame(rows, COLS), spark.createDataFrame(schemas, "name string, argument string, kind string, needed boolean").withColumn("valid", F.lit(1))).collect()
    assert [r.valid for r in sorted(got, key=lambda r: r.turn)] == [v for *_, v in args]
