import random

from pyspark.sql import functions as F

from loomspan.llm import splits

RECORD = "id string, story_id string, narrator_id string, recording_id string, ok boolean, record string, label string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], RECORD)


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, s, n, r, _ in rows:
        if s is not None:
            find(("s", s))
            for kind, v in (("n", n), ("r", r)):
                if v is not None and v.strip().lower() not in splits.NO_IDENTITY:
                    parent[find(("s", s))] = find((kind, v.strip().lower()))
    groups = {}
    for x in list(parent):
        if x[0] == "s":
            groups.setdefault(find(x), set()).add(x[1])
    return groups.values()


def test_random_ties(spark):
    rng = random.Random(4)
    odd = [None, "", " ", "-", "N/A", "Unknown", "none"]
    rows = [(f"u{i}", rng.choice([f"s{i % 40:02d}", None]) if i % 9 == 0 else f"s{i % 40:02d}", rng.choice([*odd, f" Nar{rng.randrange(60)} "]), rng.choice([*odd, f"rec{rng.randrange(60)}"]), rng.random() < 0.7) for i in range(200)]
    groups = splits.tied_groups(frame(spark, rows), "story_id", ["narrator_id", "recording_id"])
    got = {tuple(r) for r in splits.tied_pairs(groups, 3).collect()}
    assert got == {(a, b) for g in brute(rows) for a in g for b in g if a < b}


def test_long_chain_and_hot_group(spark):
    rows = [(f"u{i}", f"s{i:03d}", f"n{i}", f"r{i // 2}" if i % 2 else f"r{(i - 1) // 2}", True) for i in range(60)]
    rows = [(f"u{i}", f"s{i:03d}", f"n{i // 2}", f"r{(i + 1) // 2}", True) for i in range(60)]
    groups = splits.tied_groups(frame(spark, rows), "story_id", ["narrator_id", "recording_id"])
    assert {r["label"] for r in groups.collect()} == {"s000"}
    assert splits.tied_pairs(groups, 8).distinct().count() == 60 * 59 // 2


def test_assignment(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", f"s{i // 5}", f"n{i // 15}", None, rng.random() < 0.3) for i in range(3000)] + [("lone1", None, None, None, None), ("lone2", None, None, None, True)]
    df = frame(spark, rows + rows[:50])
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1), ("none", 0.0), (None, None)], "split string, share double")
    groups = splits.tied_groups(df, "story_id", ["narrator_id", "recording_id"])
    got = splits.assign_splits(df, groups, targets, "id", "story_id", "ok")
    rows_out = got.collect()
    assert len(rows_out) == 3002 and len({r["id"] for r in rows_out}) == 3002
    by_group = {}
    for r in rows_out:
        by_group.setdefault(int(r["id"][1:]) // 15 if r["id"][0] == "u" else r["id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_group.values())
    report = {r["split"]: r for r in splits.split_report(got, df, targets.where("share > 0"), "id", "ok").collect()}
    assert abs(report["train"]["share"] - 0.8) < 0.02 and abs(report["test"]["share"] - 0.1) < 0.02
    assert max(r["label_rate"] for r in report.values()) - min(r["label_rate"] for r in report.values()) < 0.08


def test_placing_equals_one_by_one():
    rng = random.Random(8)
    shares = [0.7, 0.2, 0.1]
    for _ in range(20):
        classes = [(rng.randrange(1, 40), float(n), float(rng.randrange(n + 1))) for n in rng.sample(range(1, 30), 6)]
        n, positive = sum(m * a for m, a, _ in classes), sum(m * b for m, _, b in classes) or 1.0
        have = [[0.0, 0.0] for _ in shares]
        want = {}
        for m, a, b in sorted(classes, key=lambda c: -c[1]):
            for _ in range(m):
                grown = [((have[k][0] + a / n - s) ** 2 - (have[k][0] - s) ** 2 + (have[k][1] + b / positive - s) ** 2 - (have[k][1] - s) ** 2) / s for k, s in enumerate(shares)]
                k = grown.index(min(grown))
                want.setdefault(a, [0, 0, 0])[k] += 1
                have[k][0] += a / n
                have[k][1] += b / positive
        got = splits.placed(classes, shares)
        assert [sum(c) for c in got] == [m for m, _, _ in classes]
        end = [sum(c[k] * a for c, (_, a, _) in zip(got, classes, strict=True)) / n for k in range(3)]
        assert all(abs(e - h[0]) < 0.02 for e, h in zip(end, have, strict=True))
    many = splits.placed([(10**9, 1.0, 0.3), (5, 10.0**8, 3.0 * 10**7)], shares)
    assert sum(many[0]) == 10**9 and abs((many[0][0] + many[1][0] * 10**8) / 1.5e9 - 0.7) < 1e-6


def test_one_heavy_group(spark):
    df = spark.range(30_000).selectExpr("cast(id as string) id", "case when id < 10000 then 'heavy' else concat('s', id % 4000) end story_id", "cast(null as string) narrator_id", "cast(null as string) recording_id", "id % 3 = 0 ok")
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.1), ("validation", 0.1)], "split string, share double")
    got = splits.assign_splits(df, splits.tied_groups(df, "story_id", ["narrator_id"]), targets, "id", "story_id", "ok")
    assert {r["split"] for r in got.where("story_id = 'heavy'").select("split").distinct().collect()} == {"train"}
    report = {r["split"]: r for r in splits.split_report(got, df, targets, "id", "ok").collect()}
    assert all(abs(r["share"] - r["target_share"]) < 0.001 and abs(r["label_rate"] - 1 / 3) < 0.01 for r in report.values())


def test_sizes(spark):
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "record string, label string")
    assert {tuple(r) for r in splits.tied_sizes(groups).collect()} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1)}


def test_empty(spark):
    df = frame(spark, [])
    groups = splits.tied_groups(df, "story_id", ["narrator_id"])
    assert groups.count() == 0 and splits.tied_pairs(groups).count() == 0
    targets = spark.createDataFrame([("train", 1.0)], "split string, share double")
    assert splits.assign_splits(df, groups, targets, "id", "story_id", "ok").count() == 0
    assert splits.assign_splits(frame(spark, [("u", "s", None, None, True)]), groups, targets.limit(0), "id", "story_id", "ok").count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1
