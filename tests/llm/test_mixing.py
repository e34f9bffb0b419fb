import math

import numpy as np

from loomspan.llm import mixing

DOCUMENT = "doc_id long, source string, tokens int"
TARGET = "source string, target_share double, max_repeats int"


def test_inverse_and_fit():
    cdf = mixing.poisson_cdf(1.3, 4)
    assert np.isclose(cdf[0], math.exp(-1.3)) and np.isclose(cdf[1], math.exp(-1.3) * 2.3)
    at = (np.arange(4096) + 0.5) / 4096
    drawn = mixing.copies(at, cdf)
    assert np.isclose(np.mean(drawn), sum(1 - p for p in cdf), atol=0.01) and max(drawn) == 4
    tokens = np.ones(4096)
    for wanted in (100.0, 3000.0, 9000.0):
        cdf = mixing.poisson_cdf(mixing.fitted_rate(at, tokens, wanted, 3), 3)
        assert abs(mixing.copies(at, cdf).sum() - wanted) <= 3
    assert mixing.fitted_rate(at, tokens, 3 * 4096, 3) == math.inf and mixing.poisson_cdf(math.inf, 2).tolist() == [0, 0]


def test_great_rates_and_caps():
    cdf = mixing.poisson_cdf(5000.0, 1_000_000)
    assert np.isclose(np.interp(0.5, cdf, np.arange(len(cdf))), 5000, atol=1) and cdf[-1] == 1 and cdf[0] == 0
    at = (np.arange(1000) + 0.5) / 1000
    rate = mixing.fitted_rate(at, np.ones(1000), 2_000_000, 100_000)
    assert abs(mixing.copies(at, mixing.poisson_cdf(rate, 100_000)).sum() - 2_000_000) < 100


def test_rare_rate(spark):
    docs = spark.range(10_000_000).selectExpr("id doc_id", "case when id < 1000 then 'small' else 'big' end source", "case when id < 1000 then 10 else 1 end tokens")
    targets = spark.createDataFrame([("big", 200.0, 3), ("small", 10_000.0, 1)], TARGET)
    got = {r["source"]: r["tokens"] for r in mixing.share_report(mixing.mixed(docs, targets), targets).collect()}
    assert got["small"] == 10_000 and abs(got["big"] - 200) <= 2


def test_shares_and_caps(spark):
    rows = [(i, ("big", "small", "other", None)[i % 20 if i % 20 < 4 else 0], 10 + i % 7) for i in range(4000)] + [(9_000_000, "big", 0), (9_000_001, "small", None)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("other", 0.2, 3), ("absent", 0.4, 2), ("nulls", None, 2), (None, 0.1, 1)], TARGET)
    docs = spark.createDataFrame(rows, DOCUMENT)
    mix = mixing.mixed(docs, targets)
    got = mix.collect()
    assert {tuple(r) for r in mixing.mixed(docs.repartition(9), targets).collect()} == {tuple(r) for r in got} and len(set(got)) == len(got)
    per = {}
    for r in got:
        per[r["source"]] = per.get(r["source"], 0) + r["tokens"]
    total = sum(per.values())
    assert all(abs(per[s] / total - want) < 0.01 for s, want in (("big", 0.5), ("small", 0.3), ("other", 0.2)))
    assert max(r["copy"] for r in got if r["source"] == "small") <= 4 and max(r["copy"] for r in got if r["source"] == "big") == 1
    places = [r["place"] for r in mixing.shuffled(mix).collect()]
    assert sorted(places) == list(range(len(got)))
    report = {r["source"]: r for r in mixing.share_report(mix, targets).collect()}
    assert report["absent"]["tokens"] == 0 and abs(report["small"]["actual_share"] - 0.3) < 0.01 and report["small"]["most_repeats"] <= 4


def test_total_and_empty(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(1000)], DOCUMENT)
    targets = spark.createDataFrame([("a", 1.0, 5)], TARGET)
    assert abs(sum(r["tokens"] for r in mixing.mixed(docs, targets, total=25_000).collect()) - 25_000) < 300
    assert sum(r["tokens"] for r in mixing.mixed(docs, targets, total=1e9).collect()) == 50_000
    assert mixing.mixed(docs.limit(0), targets).count() == 0 == mixing.mixed(docs, targets.limit(0)).count()
