import json

from loomspan.operators.changefeed import apply_changes, checked_changes, json_leaves

DECISION = "decision_id long, unit_id string, revision int, operations array<struct<op:string,collection:string,id:string,field:string,before:string,value:string,reason:string>>, at string, op string"


def op(kind, id_, field=None, value=None):
    return (kind, None, id_, field, None, value if value is None or isinstance(value, str) else json.dumps(value), None)


def state(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DECISION)
    return {(r["unit_id"], r["record_id"], r["field"]): (r["value"], r["revision"]) for r in apply_changes(df).collect()}


def test_order_of_changes(spark):
    rows = [
        (2, "u", 2, [op("set", "a", "x", "new"), op("set", "gone", "x", "1")]),
        (1, "u", 1, [op("add", "a", value={"id": "a", "x": "old", "n": {"q": "deep", "id": "kept"}})]),
        (1, "u", 1, [op("add", "a", value={"id": "a", "x": "old", "n": {"q": "deep", "id": "kept"}})]),
    ]
    assert state(spark, rows) == {("u", "a", "x"): ("new", 2), ("u", "a", "n.q"): ("deep", 1), ("u", "a", "n.id"): ("kept", 1)}


def test_removed_and_begun_anew(spark):
    rows = [
        (1, "u", 1, [op("add", "a", value={"x": "1", "y": "2"}), op("remove", "a"), op("set", "a", "x", "lost"), op("add", "a", value={"x": "3"})]),
        (2, "u", 2, [op("add", "b", value={"x": "1"}), op("remove", "b")]),
    ]
    assert state(spark, rows) == {("u", "a", "x"): ("3", 1)}


def test_odd_rows(spark):
    rows = [
        (1, None, 1, [op("add", "a", value={"x": None, "l": [1, {"y": 2}], "b": True})]),
        (2, "u", None, [op("add", "a", value={"x": "first"})]),
        (3, "u", 1, [op("set", "a", "x", "then"), op("set", "a", None, "no"), op(None, "a"), op("add", None, value={"x": "1"}), op("add", "bad", value="{broken")]),
        (4, "u", 2, None),
        (5, "u", 3, []),
    ]
    found = state(spark, rows)
    assert found == {(None, "a", "x"): (None, 1), (None, "a", "l"): ('[1,{"y":2}]', 1), (None, "a", "b"): ("true", 1), ("u", "a", "x"): ("then", 1)}


def test_merge_into_base(spark):
    rows = [
        (1, "u", 1, [op("add", "a", value={"x": "1", "y": "2"}), op("add", "b", value={"x": "1"}), op("add", "c", value={"x": "1"})]),
        (2, "u", 2, [op("set", "a", "x", "3"), op("remove", "c")]),
        (3, "u", 3, [op("set", "a", "y", "4"), op("remove", "b"), op("add", "c", value={"z": "5"}), op("set", "c", "z", "6")]),
        (4, None, None, [op("add", "a", value={"x": "n"})]),
    ]
    frame = lambda part: spark.createDataFrame([(*r, "clash", "clash") for r in part], DECISION)
    whole = {tuple(r) for r in apply_changes(frame(rows)).collect()}
    for cut in range(5):
        base = apply_changes(frame(rows[:cut]))
        assert {tuple(r) for r in apply_changes(frame(rows[cut:]), base.union(base)).collect()} == whole
    odd = spark.createDataFrame([("u", None, "x", "1", 1), ("u", "a", None, "1", 1), ("v", "k", "f", None, 7)], "unit_id string, record_id string, field string, value string, revision int")
    assert [tuple(r) for r in apply_changes(frame([]), odd).collect()] == [("v", "k", "f", None, 7)]


def test_empty_feed(spark):
    assert state(spark, []) == {}


def test_leaves_of_deep_value():
    text = '{"a":' * 500 + "1" + "}" * 500
    assert json_leaves(text) == [(".".join("a" * 500), "1")]
    text = '{"a":' * 50_000 + "[" * 20_000 + "]" * 20_000 + "}" * 50_000
    assert json_leaves(text) == [(".".join("a" * 50_000), "[" * 20_000 + "]" * 20_000)]
    assert json_leaves("[1]") == json_leaves("x") == json_leaves(None) == json_leaves("") == []


def test_stated_values_are_checked(spark):
    def change(kind, field=None, value=None, before=None):
        return (kind, None, "a", field, before, value if value is None or isinstance(value, str) else json.dumps(value), None)

    rows = [
        (1, "u", 1, [change("set", "x", "0", "y"), change("add", value={"x": "1", "n": {"q": "2"}}), change("set", "x", "3", "1"), change("set", "x", "4", "1"), change("set", "n.q", "5", "2"), change("set", "z", "6")]),
        (1, "u", 1, [change("set", "x", "0", "y")]),
        (2, "u", 2, [change("set", "x", "7", "4"), change("remove"), change("set", "x", "8", "7"), change("add", value={"w": "1"}), change("set", "x", "9", "7")]),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in [rows[0], rows[0], rows[2]]], DECISION)
    got = sorted((r["revision"], r["pos"], r["field"], r["verdict"]) for r in checked_changes(df).collect())
    assert got == [(1, 0, "x", "no_record"), (1, 2, "x", "holds"), (1, 3, "x", "differs"), (1, 4, "n.q", "holds"), (1, 5, "z", "unstated"), (2, 0, "x", "holds"), (2, 2, "x", "no_record"), (2, 4, "x", "differs")]
    assert checked_changes(df.limit(0)).collect() == []
