import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspan.operators.nested import GRAPH, _linked, _Nodes, node_table, nodes_within, parse_object


def nodes(spark, graphs):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(graphs)], "doc int, graph string")
    return [r.asDict() for r in node_table(df, "graph", ["doc"]).collect()]


def test_shapes(spark):
    graph = {
        "entities": {"id": "e0"},
        "events": [None, {"id": "v1", "trigger": ["a", "b"], "arguments": [None, {"target": "e0"}, "text"]}, {"id": "v2", "trigger": None, "arguments": {"target": 5}}, 7],
        "uncertainties": [{"id": "q", "alternatives": {"alternatives": [None, {"target": "x"}]}}],
        "literals": "no array",
    }
    found = {(n["kind"], n["owner_id"], n["path"]) for n in nodes(spark, [json.dumps(graph)])}
    assert found == {
        ("entity", None, "0"), ("event", None, "1"), ("event", None, "2"), ("event", None, "3"), ("trigger", "v1", "0"), ("argument", "v1", "1"), ("argument", "v1", "2"),
        ("argument", "v2", "0"), ("uncertainty", None, "0"), ("alternative", "q", "0"), ("alternative", "q", "0.1"),
    }


def test_what_gives_nothing(spark):
    assert nodes(spark, [None, "", "null", "[]", "{", '{"entities": []} x', '{"entities": null}', '{"entities": [NaN]}', "ERROR {}"]) == []
    assert nodes(spark, []) == []


def test_clashing_column(spark):
    df = spark.createDataFrame([("k", "{}")], "kind string, graph string")
    with pytest.raises(ValueError, match="kind"):
        node_table(df, "graph", ["kind"])


def test_containment_join(spark):
    graph = json.dumps({"events": [{"id": "a", "arguments": [{}, {}]}, {"id": "b", "arguments": [{}]}]})
    df = spark.createDataFrame([(1, graph), (2, graph)], "doc int, graph string")
    pairs = nodes_within(node_table(df, "graph", ["doc"]), "doc", "event", "argument").collect()
    assert sorted((r["doc"], r["outer_id"], r["path"]) for r in pairs) == [(d, o, p) for d in (1, 2) for o, p in (("a", "0"), ("a", "1"), ("b", "0"))]


ALTERNATIVES = st.recursive(st.fixed_dictionaries({"target": st.text(max_size=2)}), lambda inner: st.fixed_dictionaries({"alternatives": st.one_of(inner, st.lists(st.one_of(st.none(), inner), max_size=3))}), max_leaves=8)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(ALTERNATIVES, max_size=3), min_size=1, max_size=4))
def test_paths_against_recursion(documents):
    table = _Nodes()
    want = []
    for row, alternatives in enumerate(documents):
        table.walk(row, {"uncertainties": [{"id": "q", "alternatives": alternatives}]}, GRAPH)

        def below(value, path, row=row):
            for i, x in [(0, value)] if isinstance(value, dict) else enumerate(value or []):
                if x is not None:
                    want.append((row, ".".join(map(str, [*path, i]))))
                    below(x.get("alternatives"), [*path, i])

        below(alternatives, [])
    made = _linked(table)
    kinds, paths = made["kind"].to_pylist(), made["path"].to_pylist()
    assert sorted((r, p) for r, k, p in zip(table.row, kinds, paths, strict=True) if k == "alternative") == sorted(want)


def test_leading_blanks():
    for blanks in (" " * 64, "\n" * 500, "\r\n\t " * 100):
        assert parse_object(blanks + '{"entities": []}') == {"entities": []}
    assert parse_object(" " * 100) is None and parse_object('[{"a": 1}]') is None and parse_object("x {}") is None


def test_depth_is_not_bounded(spark):
    deep = '{"entities": [{"id": "e", "x": ' + '{"y":' * 50_000 + "1" + "}" * 50_000 + '}], "uncertainties": [{"id": "q", "alternatives": ' + '[{"alternatives": ' * 6_000 + "null" + "}]" * 6_000 + "}]}"
    table = _Nodes()
    table.walk(0, parse_object(deep), GRAPH)
    made = _linked(table)
    paths = [p for k, p in zip(made["kind"].to_pylist(), made["path"].to_pylist(), strict=True) if k == "alternative"]
    assert len(paths) == 6_000 and max(map(len, paths)) == 11_999 and made["kind"].to_pylist().count("entity") == 1
    assert set(made["owner_id"].to_pylist()) == {None, "q"}
    assert len(nodes(spark, ['{"entities": [{"id": ' + "[" * 12_000 + "]" * 12_000 + "}]}"])[0]["id"]) == 24_000
