import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomspan.operators import hierarchy
from loomspan.operators.graph import closure, equivalence_classes, waves

CONTEXT = "id string, story string, parents array<string>, n int, chunk string, label string"


def made(spark, parents, position=True, scope=lambda i: "s"):
    rows = [(i, scope(i), p, n, "clash", "clash") for n, (i, p) in enumerate(parents)]
    df = spark.createDataFrame(rows, CONTEXT)
    return hierarchy.links(df, "id", "parents", "story", df["n"] if position else None)


def brute(parents):
    known = {i: {p for p in ps or [] if p in dict(parents)} for i, ps in dict(parents).items()}
    out, state = {}, {}

    def above(i):
        seen, queue = {i: 0}, deque([i])
        while queue:
            x = queue.popleft()
            for p in known[x]:
                if p not in seen:
                    seen[p] = seen[x] + 1
                    queue.append(p)
        return seen

    for i in known:
        state[i] = above(i)
    loops = {i for i in known if any(i in state[p] for p in known[i])}
    for i in known:
        out[i] = {("cycle", -1)} if loops & state[i].keys() else {(r, d) for r, d in state[i].items() if not known[r]}
    return {(i, r, d) for i, s in out.items() for r, d in s}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(hierarchy, "CHUNK_SPAN", 7)  # many groups, so values cross their borders
    names = [f"n{i}" for i in range(60)]
    parents = [(n, [rng.choice(names[: max(1, i)]) if rng.random() < 0.97 else rng.choice(names) for _ in range(rng.choice([0, 1, 1, 2]))] + rng.choice([[], [None], ["absent"]])) for i, n in enumerate(names)]
    parents += [parents[5]]
    nodes = made(spark, parents, position=seed != 2, scope=lambda i: i[-1])
    assert {tuple(r) for r in hierarchy.hierarchy(nodes).collect()} == brute(parents)


def test_chain_across_groups(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK_SPAN", 40)
    parents = [(f"n{i:03d}", [f"n{i - 1:03d}"] if i else None) for i in range(120)]
    nodes = made(spark, parents)
    assert {tuple(r) for r in hierarchy.hierarchy(nodes).collect()} == {(f"n{i:03d}", "n000", i) for i in range(120)}
    below = hierarchy.descendants(nodes)
    sizes = {r["id"]: (r["n_descendants"], r["height"]) for r in hierarchy.subtree_sizes(below).collect()}
    assert sizes == {f"n{i:03d}": (119 - i, 119 - i) for i in range(120)}


def test_chain_without_positions(spark, monkeypatch):
    rounds = []
    swept = hierarchy._local
    monkeypatch.setattr(hierarchy, "_local", lambda rows, mode: rounds.append(mode) or swept(rows, mode))
    parents = [(f"n{i:05d}", [f"n{i - 1:05d}"] if i else None) for i in range(10_000)]
    random.Random(1).shuffle(parents)
    found = {r["id"]: (r["root"], r["depth"]) for r in hierarchy.hierarchy(made(spark, parents, position=False)).collect()}
    assert found == {f"n{i:05d}": ("n00000", i) for i in range(10_000)}
    assert len(rounds) <= 10_000 // hierarchy.CHUNK_SPAN + 1


def test_star(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BUNDLE", 5_000)
    df = spark.range(100_000).selectExpr("cast(id as string) id", "'s' story", "case when id = 0 then null else array('0') end parents")
    for position in (None, F.lit(1)):
        nodes = hierarchy.links(df, "id", "parents", "story", position)
        assert [tuple(r) for r in hierarchy.hierarchy(nodes).groupBy("root", "depth").count().orderBy("depth").collect()] == [("0", 0, 1), ("0", 1, 99_999)]
    sizes = hierarchy.subtree_sizes(hierarchy.descendants(nodes))
    assert [tuple(r) for r in sizes.groupBy("n_descendants", "height").count().orderBy("height").collect()] == [(0, 0, 99_999), (99_999, 1, 1)]


@pytest.mark.parametrize("seed", [3, 5])
def test_descendants_against_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(hierarchy, "CHUNK_SPAN", 7)
    monkeypatch.setattr(hierarchy, "BUNDLE", 5)
    rng = random.Random(seed + 10)
    names = [f"n{i:02d}" for i in range(50)]
    parents = dict((n, [names[rng.randrange(i)] if i and rng.random() < 0.88 else rng.choice(names) for _ in range(rng.choice([0, 1, 1, 2]))]) for i, n in enumerate(names))
    below = {n: {n: 0} for n in names}
    for n in names:
        queue = deque([n])
        while queue:
            x = queue.popleft()
            for c in names:
                if x in parents[c] and c not in below[n]:
                    below[n][c] = below[n][x] + 1
                    queue.append(c)
    loops = {n for n in names if any(n in below[p] and p in below[n] and (p != n or n in parents[n]) for p in parents[n])}
    want = {(n, d, k) for n in names if not loops & below[n].keys() for d, k in below[n].items()} | {(n, None, -1) for n in names if loops & below[n].keys()}
    got = hierarchy.descendants(made(spark, list(parents.items()), position=seed == 3))
    assert {tuple(r) for r in got.collect()} == want and loops


def test_paths_and_loops(spark):
    parents = [("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("x", ["y"]), ("y", ["x"]), ("z", ["x", "a"]), ("self", ["self"]), ("up", []), ("x2", ["x2", "up"]), (None, ["a"])]
    nodes = made(spark, parents)
    assert {tuple(r) for r in hierarchy.paths(nodes).collect()} == {("a", "a", 0), ("b", "a/b", 1), ("c", "a/c", 1), ("c", "a/b/c", 2), ("up", "up", 0)}
    found = {tuple(r) for r in hierarchy.hierarchy(nodes).collect()}
    assert found == {("a", "a", 0), ("b", "a", 1), ("c", "a", 1), ("up", "up", 0), *((i, "cycle", -1) for i in ("x", "y", "z", "self", "x2"))}
    below = {(r["id"], r["descendant"], r["distance"]) for r in hierarchy.descendants(nodes).collect()}
    assert {("up", None, -1), ("x", None, -1), ("z", "z", 0), ("a", "c", 1)} <= below


def test_empty(spark):
    assert hierarchy.hierarchy(made(spark, [])).collect() == []


def test_closure_classes_and_waves(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "a"), ("x", None)], "s string, d string")
    assert {(r["src"], r["dst"]) for r in closure(edges, "s", "d").collect()} == {(x, y) for x in "abcd" for y in "abc"}
    same = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("p", "p")], "l string, r string")
    different = spark.createDataFrame([("a", "c")], "l string, r string")
    assert {tuple(r) for r in equivalence_classes(same, different, "l", "r").collect()} == {("a", "a"), ("b", "b"), ("c", "c"), ("x", "x"), ("y", "x")}
    jobs = spark.createDataFrame([(c,) for c in "abcdef"], "job string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "gone")], "job string, need string")
    assert {tuple(r) for r in waves(jobs, needs, "job", "need").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", None), ("e", None), ("f", 0)}
