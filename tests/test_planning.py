import math
import pytest

from loomspan.functions import guards
from loomspan.operators import planning
from loomspan.sources.dataset import Dataset


def test_guards(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert guards.public_projection(df, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(ValueError, match="not public"):
        guards.public_projection(df, ["a"])
    with pytest.raises(ValueError, match="x.0.secret"):
        guards.without_keys({"x": [{"secret": 1}]}, {"secret"})
    assert guards.abstracted({"id": "e1", "of": ["e2", {"to": "e1"}]}, {"e1": {"c": "dog"}}) == {"of": ["e2", {"to": {"c": "dog"}}]}
    assert guards.exactly_one(df) is df
    with pytest.raises(ValueError, match="no row"):
        guards.exactly_one(df.limit(0))
    assert guards.one_to_one(df, df.select("a"), ["a"]).count() == 1
    with pytest.raises(ValueError, match="one to one"):
        guards.one_to_one(df, df.select("a").limit(0), ["a"])
    assert guards.declared_groups({"B", "C"}, explicit=["C", "B"]) == ["B", "C"] == guards.declared_groups({"B", "C"}, "x", {"x": ["B", "C"]})
    for bad in ({"explicit": ["B", "B"]}, {"explicit": ["Z"]}, {}, {"comparison": "x", "explicit": ["B"]}):
        with pytest.raises(ValueError):
            guards.declared_groups({"B", "C"}, **bad)
    assert sum(map(abs, guards.numeric_slots(-3.0))) > 0 > sum(guards.numeric_slots(-3.0)) and not any(guards.numeric_slots(float("nan")))
    assert guards.numeric_slots(1.0, "a").index(guards.numeric_slots(1.0, "a")[0] or math.log1p(1)) == guards.numeric_slots(3.0, "a").index(math.log1p(3))
    assert sorted(guards.numeric_slots({"a": [1, True, "x"], "b": None}))[-1] == math.log1p(1)
    assert guards.walltime_seconds("1-00:01:02") == 86462 and guards.walltime_seconds("03:58") == 238


def test_waves_and_covers(spark):
    w = planning.Worker
    workers = [w("a1", "a", "gpu"), w("a2", "a", "gpu"), w("b1", "b", "gpu"), w("c1", "b", "cpu", 2), w("d", "a", "gpu", 1, ("a1",)), w("big", "a", "gpu", 9)]
    assert planning.choose_wave(workers, set(), {"gpu": 2, "cpu": 4}, {"a": 1, "b": 1}) == ["a1", "b1", "a2"][:2] + ["c1"]
    done, waves = set(), 0
    while len(done) < 5:
        done |= set(planning.choose_wave(workers, done, {"gpu": 1, "cpu": 2}, {"a": 2, "b": 1}))
        waves += 1
    assert "big" not in done and waves <= 5
    assert planning.greedy_cover({"x": {1, 2}, "y": {2, 3, 4}, "z": {1}}) == ["y", "x"] and planning.greedy_cover({}) == []
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("t", "x"), (None, "a")], "s string, d string")
    assert {tuple(r) for r in planning.follow(chain, "s", "d").collect()} == {("a", "c"), ("b", "c"), ("x", None), ("y", None), ("t", None)}


def test_readout_and_dataset(spark, data):
    rows = [([float(i % 3 == k) + 0.01 * i for k in range(3)], "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y string")
    out = planning.linear_readout(df, df.union(spark.createDataFrame([([0.0] * 3, "new")], "x array<double>, y string")), "x", "y", 0.001)
    assert out.where("label_index = predicted").count() >= 57 and out.where("label_index IS NULL").count() == 1
    ids = spark.createDataFrame([([1, 2], [1, 2, 3]), ([2], [1, 2])], "p array<int>, w array<int>")
    assert [r[0] for r in ids.select(planning.stable_prefix("p", "w")).collect()] == [True, False]
    opened = Dataset(spark, data)
    assert opened.records("relation").count() <= opened.table("relation").count() and opened.stories().count() > 0
    with pytest.raises(ValueError, match="unknown"):
        opened.records("other")
    with pytest.raises(ValueError, match="digest"):
        Dataset(spark, data, {"region": "0"})
