import json

import __spark_entry__ as entry
from lettermill.llm import chat
from lettermill.llm.chat import link_tool_calls

CALLS = "conv_id long, turn long, call_id string, tool string, arguments string, depends array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, kind string"
SCHEMAS = {"f": {"n": ("integer", True), "s": ("string", False), "x": ("number", False), "o": ("object", False),
                 "l": ("array", False), "b": ("boolean", False)}, "g": {}}


def linked(spark, calls, results):
    got = link_tool_calls(spark.createDataFrame([(*c, "?") for c in calls], CALLS),
                          spark.createDataFrame([(*r, "?") for r in results], RESULTS), SCHEMAS).collect()
    return sorted(got, key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place))


def test_order_and_status(spark):
    calls = [(1, 1, "a", "g", "{}", ["c"]), (1, 3, "b", "g", "{}", None), (1, 5, "c", "g", "{}", ["b", "gone"]),
             (1, 7, "d", "g", "{}", ["e"]), (1, 8, "e", "g", "{}", ["d"]), (1, 9, "f", "g", "{}", ["e"]),
             (1, 11, "b", "g", "{}", []), (2, 1, "a", "g", "{}", ["a2", None]), (2, 2, "a2", "g", "{}", [])]
    results = [(1, 2, "a", "early"), (1, 4, "b", "x"), (1, 0, "c", "before its call"), (1, 6, "z", "lost"),
               (1, 12, "b", "again"), (1, 13, "d", "y"), (2, 3, "a", None)]
    rows = linked(spark, calls, results)
    assert [(r.conv_id, r.place) for r in rows] == [(1, k) for k in range(13)] + [(2, k) for k in range(3)]
    at = {(r.conv_id, r.kind, r.call_id, r.turn): r.place for r in rows}
    assert at[1, "call", "b", 3] < at[1, "result", "b", 4] < at[1, "call", "c", 5] < at[1, "result", "c", 0]
    assert at[1, "result", "c", 0] < at[1, "call", "a", 1] < at[1, "result", "a", 2]
    assert at[2, "call", "a2", 2] < at[2, "call", "a", 1] < at[2, "result", "a", 3]
    status = {(r.conv_id, r.kind, r.call_id, r.turn): r.status for r in rows}
    assert status == {
        (1, "call", "a", 1): "ok", (1, "call", "b", 3): "ok", (1, "call", "c", 5): "ok", (1, "result", "a", 2): "ok",
        (1, "result", "b", 4): "ok", (1, "result", "c", 0): "ok", (1, "call", "d", 7): "circular",
        (1, "call", "e", 8): "circular", (1, "call", "f", 9): "circular", (1, "result", "d", 13): "circular",
        (1, "call", "b", 11): "repeated", (1, "result", "b", 12): "repeated", (1, "result", "z", 6): "orphan",
        (2, "call", "a", 1): "ok", (2, "call", "a2", 2): "unanswered", (2, "result", "a", 3): "ok"}


def test_arguments(spark):
    cases = {'{"n": 1}': "", '{"s":"é\\n\\"", "n" : 2, "x": 1.5}': "", '{"n": "1"}': "n is not integer", "{}": "missing n",
             '{"n": null}': "missing n", "[1]": "not an object", "{": "not JSON", None: "not JSON",
             '{"n":1,"zz":2,"aa":{}}': "unexpected aa zz", '{"n":1,"x":"y","b":0}': "b is not boolean x is not number",
             '{"n":1,"o":{"k":[]},"l":[1,{"q":null}],"b":true,"x":3}': "", '{"n":1,"o":[],"l":{}}':
             "l is not array o is not object"}
    calls = [(1, k, f"c{k}", "f", a, None) for k, a in enumerate(cases)] + [(1, 90, "u", "h", "{}", None),
                                                                            (1, 91, "v", None, "{}", None)]
    rows = {r.turn: r for r in linked(spark, calls, [])}
    for k, (given, faults) in enumerate(cases.items()):
        assert " ".join(rows[k].faults) == faults, given
        assert rows[k].status == ("invalid" if faults else "unanswered")
        said = json.loads(rows[k].message)
        assert rows[k].message == json.dumps(said, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if "not JSON" not in faults:
            assert said["arguments"] == json.loads(given)
        else:
            assert said.get("raw_arguments") == given
    assert rows[90].faults == rows[91].faults == ["unknown tool"]


def test_odd_tables(spark):
    rows = linked(spark, [(None, 1, "a", "f", "{}", None), (1, None, "a", "f", "{}", None), (1, 1, None, "f", "{}", None),
                          (1, 2, "a", "g", "{}", None), (1, 2, "a", "g", "{}", None)], [(None, None, None, None)] * 2)
    assert sorted(r.status for r in rows) == ["unanswered"] + ["unnamed"] * 4
    assert linked(spark, [], []) == []


def test_blocks_do_not_matter(spark, monkeypatch):
    calls = [(k % 2, k, f"c{k}", "g", "{}", [f"c{k + 8}"] if k % 6 == 1 else None) for k in range(60)]
    results = [(k % 2, k + 1, f"c{k}", "r") for k in range(0, 60, 3)]
    want = linked(spark, calls, results)
    monkeypatch.setattr(chat, "BLOCK_TURNS", 5)
    assert linked(spark, calls, results) == want


def test_query_agrees_with_sql(spark):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in sorted(os.listdir(sf)):
        db.execute(f"create view {name[:-8]} as select * from read_parquet('{sf}/{name}')")
    got = entry.queries()["op10_tool_calls"](spark, sf).toPandas()
    want = db.execute(entry.oracle_sql()["op10_tool_calls"]).df()
    key = ["conv_id", "place"]
    text = [t[got.columns].astype(str).sort_values(key).reset_index(drop=True) for t in (got, want)]
    assert text[0].equals(text[1])


def test_query_takes_every_turn(spark, tmp_path):
    """Opening turns, other roles, and null roles and turns all come out."""
    rows = [(1, 0, "system", "s"), (1, 1, "assistant", "call"), (1, 2, None, "result"), (1, None, "user", "x"),
            (None, 3, "user", "y"), (2, 0, "user", "opening"), (2, None, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = entry.queries()["op10_tool_calls"](spark, str(tmp_path)).collect()
    status = {(r.conv_id, r.turn, r.kind): r.status for r in got}
    assert len(got) == len(rows) == len(status) and status.pop((1, 1, "call")) in ("ok", "invalid")
    assert status == {
        (1, 0, "result"): "orphan", (1, 2, "result"): "ok", (1, None, "result"): "unnamed",
        (None, 3, "result"): "unnamed", (2, 0, "result"): "orphan", (2, None, "call"): "unnamed"}
