import json

from strandwork.llm.tool_calls import levels, link

SCHEMAS = {"add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}}
CALL = "call_id string, session long, name string, arguments string, needs array<string>, content int"


def test_links_orders_validates_and_serialises(spark):
    calls = spark.createDataFrame(
        [
            ("c1", 1, "add", '{"b": 2.5, "a": 1}', [], 9),
            ("c2", 1, "add", '{"a": "x"}', ["c1"], 9),
            ("c3", 1, "add", '{"a": 1, "z": [2, {"y": 1, "x": null}]}', ["c2", "c1"], 9),
            ("c4", None, "other", "no json", ["c4"], 9),
            ("c5", 1, None, None, ["gone"], 9),
            (None, 1, "add", '{"a": 1}', None, 9),
            ("c1", 1, "add", '{"b": 2.5, "a": 1}', [], 9),
        ],
        CALL,
    )
    results = spark.createDataFrame([("c1", "two"), ("c1", "one"), ("c9", "?"), ("c3", None)], "call_id string, content string")
    rows = link(calls, results, SCHEMAS).collect()
    by = {}
    for r in rows:
        by.setdefault(r["call_id"], []).append(r)
    assert len(rows) == 8 and len(by["c1"]) == 2
    assert [by[c][0]["level"] for c in ("c1", "c2", "c3", "c4", "c5")] == [0, 1, 2, None, None]
    assert by["c1"][0]["valid"] and by["c1"][0]["n_results"] == 2
    assert by["c2"][0]["problems"] == ["a is not integer"] and by["c2"][0]["status"] == "no_result"
    assert by["c3"][0]["problems"] == ["not known: z"]
    assert by["c4"][0]["problems"] == ["no schema"] and by["c9"][0]["status"] == "orphan_result"
    assert by["c1"][0]["canonical"] == '{"arguments":{"a":1,"b":2.5},"call_id":"c1","name":"add","result":"one"}'
    assert json.loads(by["c3"][0]["canonical"])["arguments"] == {"a": 1, "z": [2, {"x": None, "y": 1}]}


def test_empty_tables(spark):
    calls = spark.createDataFrame([], CALL)
    results = spark.createDataFrame([], "call_id string, content string")
    assert link(calls, results, SCHEMAS).count() == 0


def test_chain_levels_take_cycles_and_gaps(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(40)] + [("a",), ("b",), ("m",), ("n",)], "id string")
    edges = [(str(i), str(i - 1)) for i in range(1, 40)] + [("a", "b"), ("b", "a"), ("m", "gone"), ("n", "m")]
    got = {r["id"]: r["level"] for r in levels(nodes, spark.createDataFrame(edges, "id string, needs string")).collect()}
    assert got == {str(i): i for i in range(40)} | {"a": None, "b": None, "m": None, "n": None}
