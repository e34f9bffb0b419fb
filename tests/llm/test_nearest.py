import math
import random

import numpy as np
import pytest

from loomspan.llm import nearest


def test_index_against_searchsorted():
    rng = np.random.default_rng(2)
    parts = [np.sort(rng.exponential(1, n).cumsum()) for n in (0, 1, 2, 33, 500, 64)] + [np.repeat([1.0, 5.0], 40), np.sort(np.r_[np.zeros(100), rng.random(3) * 1e6])]
    hi = np.cumsum([len(p) for p in parts])
    lo = np.r_[0, hi[:-1]]
    index = nearest.PiecewiseIndex(np.concatenate(parts), lo, hi)
    which = rng.integers(len(parts), size=4000)
    query = np.where(rng.random(4000) < 0.3, [rng.choice(parts[w]) if len(parts[w]) else 0 for w in which], rng.random(4000) * 600 - 20)
    assert (index.left(which, query) == [lo[w] + np.searchsorted(parts[w], q) for w, q in zip(which, query, strict=True)]).all()


def run(spark, records, targets, tolerance=0.9):
    r = spark.createDataFrame(records, "source_id string, entity string, at double")
    t = spark.createDataFrame(targets, "entity string, at double, target int")
    return {(x["source_id"], x["target"]) for x in nearest.nearest_in_time(r, t, tolerance).collect()}


@pytest.mark.parametrize("dense", [nearest.DENSE_ROWS, 40])
def test_against_brute_force(spark, monkeypatch, dense):
    rng = random.Random(3)
    monkeypatch.setattr(nearest, "SHARD_SECONDS", 16.0)
    monkeypatch.setattr(nearest, "DENSE_ROWS", dense)
    monkeypatch.setattr(nearest, "FINEST", 2)
    targets = [(f"e{rng.randrange(3)}", rng.choice([round(rng.uniform(-40, 200), 3), None, math.nan, math.inf]), i) for i in range(900)]
    records = [(f"r{i}", rng.choice(["e0", "e1", "e2", "e9", None]), rng.choice([round(rng.uniform(-50, 210), 3), 16.0, 32.0, None, math.nan])) for i in range(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = run(spark, records + records[:20], targets + targets[:30])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for i, e, at in records:
        if e is None or at is None or math.isnan(at):
            continue
        near = [(abs(t - at), t, k) for x, t, k in targets if x == e and t is not None and math.isfinite(t)]
        if near and min(near)[0] <= 0.9:
            want.add((i, min(near)[2]))
    assert got == want


def test_dense_shard_is_cut(spark, monkeypatch):
    monkeypatch.setattr(nearest, "DENSE_ROWS", 20_000)
    t = spark.range(100_000).selectExpr("'e' entity", "id / 200.0 at", "cast(id as int) target")
    r = spark.range(100_000).selectExpr("cast(id as string) source_id", "'e' entity", "id / 200.0 + 0.001 at")
    got = nearest.nearest_in_time(r, t, 0.9)
    assert got.where("cast(source_id as int) = target").count() == 100_000
    assert nearest._pieces(t.select("entity", "at").unionByName(r.select("entity", "at")), 0.9).collect()[0]["pieces"] == 20
    assert nearest._pieces(t.select("entity", "at").limit(5), 0.9) is None


def test_ties_edges_and_empty(spark):
    assert run(spark, [("a", "e", 1.0)], [("e", 0.5, 7), ("e", 1.5, 8), ("e", 0.5, 3)]) == {("a", 3)}
    assert run(spark, [("a", "e", 511.95), ("b", "e", 512.1)], [("e", 512.3, 1), ("e", 511.8, 2)]) == {("a", 2), ("b", 1)}
    assert run(spark, [], [("e", 1.0, 1)]) == set() == run(spark, [("a", "e", 1.0)], []) == run(spark, [("a", "e", 1.0)], [("e", 1.0, None)])
