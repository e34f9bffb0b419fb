import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from loomspan.operators import references
from loomspan.operators.skew import hot_hashes, skew_join

T0 = datetime(2024, 1, 1)
REF = "ref_table string, record_id string, pos int, scope string, target string, at timestamp"
KNOWN = "scope string, id string, at timestamp"


def test_reasons_and_their_order(spark):
    day = lambda n: T0 + timedelta(days=n)
    refs = [("m", str(i), 0, "s", t, day(40)) for i, t in enumerate(["none", "late", "gone", "fine", " ", None, "lategone"])]
    refs += [("m", "null scope", 0, None, "fine", day(1)), ("m", "null time", 0, "s", "late", None), ("m", "null time none", 0, "s", "none", None), refs[0]]
    known = [("s", "late", day(41)), ("s", "gone", day(1)), ("s", "fine", None), ("s", "fine", day(90)), ("s", "lategone", day(60)), ("other", "none", day(1)), (None, "none", day(1))]
    gone = [("s", "gone", day(40)), ("s", "lategone", day(1)), ("other", "fine", day(1))]
    assert {r[1]: r[3] for r in found_set(spark, refs, known, gone)} == {"0": "missing", "1": "later", "2": "removed", "6": "later", "null scope": "missing", "null time none": "missing"}


def found_set(spark, refs, known, gone):
    made = references.orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(known, KNOWN), spark.createDataFrame(gone, KNOWN), 64)
    return {tuple(r) for r in made.collect()}


def test_full_filter_changes_nothing(spark):
    rng = random.Random(3)
    known = [("s", f"k{i}", T0) for i in range(300)]
    refs = [("m", str(i), 0, "s", f"k{rng.randrange(600)}", T0) for i in range(500)]
    small, large = found_set(spark, refs, known, []), {tuple(r) for r in references.orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(known, KNOWN), spark.createDataFrame([], KNOWN), 1 << 16).collect()}
    assert small == large == {("m", r[1], 0, "missing", "2024-01") for r in refs if int(r[4][1:]) >= 300}


def test_empty_tables(spark):
    assert found_set(spark, [], [], []) == set()
    assert found_set(spark, [("m", "1", 0, "s", "x", T0)], [], []) == {("m", "1", 0, "missing", "2024-01")}


def test_clashing_columns(spark):
    refs = spark.createDataFrame([("m", "1", 0, "s", "x", T0, "a", 1, True)], REF + ", since string, gone int, always boolean")
    known = spark.createDataFrame([("s", "x", T0 + timedelta(days=1), "a")], KNOWN + ", target string")
    assert [tuple(r) for r in references.orphans(refs, known, spark.createDataFrame([], KNOWN), 64).collect()] == [("m", "1", 0, "later", "2024-01")]


def test_filter_never_loses_a_key(spark):
    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    bloom = references.Bloom.build(keys, "h", 1 << 15)
    there = np.array([r["h"] for r in keys.collect()], np.int64)
    assert bloom.holds(there).all()
    absent = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    assert bloom.holds(absent).mean() < 0.2


def test_skewed_join_is_whole(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)] + [(None, 9)], "k string, w int")
    assert list(hot_hashes(left, ["k"], 100).values()) == [3]
    for how in ("inner", "left", "left_semi", "left_anti"):
        want, got = (sorted(map(str, df.collect())) for df in (left.join(right, ["k"], how), skew_join(left, right, ["k"], how, hot_rows=100)))
        assert got == want


def test_filter_follows_the_keys(spark, monkeypatch):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    absent = np.array([r[0] for r in spark.range(20_000, 60_000).select(F.xxhash64("id").alias("h")).collect()])
    bloom = references.Bloom.build(keys, "h")
    assert bloom.bits == 1 << 18 and bloom.holds(np.array([r[0] for r in keys.collect()])).all() and bloom.holds(absent).mean() < 0.03
    monkeypatch.setattr(references, "BLOOM_MOST_BITS", 1 << 13)
    small = references.Bloom.build(keys, "h")
    assert small.bits == 1 << 13 and small.holds(np.array([r[0] for r in keys.collect()])).all()
    assert not references.Bloom.build(keys.limit(0), "h").holds(absent).any()
