import difflib
import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from oracle import check
from pyspark.sql import functions as F

from loomspan.operators import annotation, clock, linalg, relate, stats, text
from loomspan.plans import clock as clock_plans
from loomspan.plans import numeric
from loomspan.plans import text as text_plans

RNG = np.random.default_rng(5)


def test_moments_and_components(spark):
    x = RNG.normal(size=(200, 4)) @ RNG.normal(size=(4, 4))
    x[:, 3] = 2.0
    df = spark.createDataFrame([("g", v.tolist()) for v in x] + [("h", [1.0, 2.0, 3.0, 4.0]), ("g", None)], "g string, v array<double>").repartition(7)
    moments = linalg.story_moments(df, "g", "v")
    got = {r["group"]: r for r in moments.collect()}
    assert got["g"]["n"] == 200 and np.allclose(got["g"]["mean"], x.mean(0)) and np.allclose(np.array(got["g"]["scatter"]).reshape(4, 4), (x - x.mean(0)).T @ (x - x.mean(0)))
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    values = np.linalg.eigvalsh(z.T @ z / 200)[::-1]
    parts = {r["k"]: r for r in linalg.principal_components(moments, 3).where("group = 'g'").collect()}
    assert np.allclose([parts[k]["eigenvalue"] for k in range(3)], values) and all(parts[k]["weights"][3] == 0 for k in parts)
    assert all(max(parts[k]["weights"], key=abs) > 0 for k in parts)
    whole = linalg.merge_moments(moments, whole=True).first()
    assert whole["n"] == 201


def test_ridge_selects_and_fits(spark):
    x = RNG.normal(size=(120, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + RNG.normal(size=120) * 0.1
    df = spark.createDataFrame([("p", i % 4, x[i].tolist(), float(y[i])) for i in range(120)], "p string, f int, x array<double>, y double").repartition(5)
    alphas = [0.01, 1.0, 100.0]
    got = linalg.ridge(df, "p", "x", "y", alphas, "f").first()

    def fit(a, b, alpha):
        m, n = a.mean(0), b.mean()
        w = np.linalg.solve((a - m).T @ (a - m) + alpha * np.eye(3), (a - m).T @ (b - n))
        return n - m @ w, w

    losses = []
    for alpha in alphas:
        error = 0
        for f in range(4):
            held = np.arange(120) % 4 == f
            b0, w = fit(x[~held], y[~held], alpha)
            error += ((y[held] - b0 - x[held] @ w) ** 2).sum()
        losses.append(error / 120)
    best = int(np.argmin(losses))
    b0, w = fit(x, y, alphas[best])
    assert got["alpha"] == alphas[best] and np.isclose(got["loss"], losses[best]) and np.isclose(got["intercept"], b0) and np.allclose(got["weights"], w)


def test_permutation_and_interval(spark):
    n = 7
    a, b = (np.abs(RNG.normal(size=(n, n))) for _ in range(2))
    rows = [("k", i, j, float(a[i, j]), float(a[i, j] + 0.1 * b[i, j])) for i in range(n) for j in range(i + 1, n)] + [("few", 0, 1, 1.0, 2.0)]
    got = {r["k"]: r for r in stats.permutation_p(spark.createDataFrame(rows, "k string, item_i int, item_j int, a double, b double"), "k", 199).collect()}
    frame = pd.DataFrame(rows[:-1])
    assert np.isclose(got["k"]["rho"], frame[3].rank().corr(frame[4].rank())) and 0 < got["k"]["p"] <= 0.1 and got["few"]["p"] is None
    cells = [("c", s, t, float(s + t)) for s in range(3) for t in range(4)] + [("c", 0, 0, 0.0), ("gap", 0, 0, 1.0), ("gap", 1, 1, 1.0), ("one", 0, 0, 1.0), ("one", 0, 1, 1.0)]
    got = {r["c"]: r for r in stats.crossed_interval(spark.createDataFrame(cells, "c string, s int, t int, v double"), "c", "s", "t", "v", 300).collect()}
    assert got["c"]["available"] and got["c"]["mean"] == 2.5 and got["c"]["low"] < 2.5 < got["c"]["high"]
    assert not got["gap"]["available"] and not got["one"]["available"] and got["gap"]["mean"] is None


def test_zero_vectors_and_ties(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0]), ("c", [-3.0, 0.0])], "i string, v array<double>")
    assert {(r["item_i"], r["item_j"]): round(r["d"], 9) for r in stats.cosine_rdm(items, "i", "v", 3).collect()} == {("a", "b"): 1.0, ("a", "c"): 2.0, ("b", "c"): 1.0}
    p = spark.createDataFrame([("f", 0.0), ("f", 0.04), ("f", 0.04), ("f", 1.0), ("g", 0.5)], "f string, p double")
    got = sorted((r["f"], round(r["adjusted"], 6)) for r in relate.benjamini_hochberg(p, "f", "p").collect())
    assert got == [("f", 0.0), ("f", 0.053333), ("f", 0.053333), ("f", 1.0), ("g", 0.5)]


def test_clock_edges(spark):
    rows = spark.range(6).select(F.lit("s").alias("k"), F.col("id").cast("int").alias("t"))
    events = spark.createDataFrame([("s", None, None, 1), ("s", None, 4, None), ("s", 2, None, None)], "k string, slot int, l int, r int")
    got = clock.known_rows(events, rows, "k", "slot", "l", "r", 2)
    assert [r["known"] for r in got.orderBy("t").collect()] == [False, False, True, True, False, False]
    made = clock.fir(rows.withColumn("x", F.col("t") + 1.0).withColumn("ok", F.col("t") != 1), "k", "t", ["x"], [1, 2], "ok")
    assert [(r["x_d1"], r["x_d2"], r["valid"]) for r in made.orderBy("t").collect()] == [(0, 0, False), (1, 0, False), (2, 1, False), (3, 2, False), (4, 3, True), (5, 4, True)]
    with pytest.raises(ValueError, match="delays"):
        clock.fir(rows, "k", "t", [], [1, 1])
    assert spark.range(1).select(clock.first_bin(F.lit(2.0), 2.0, 5, 0.5)).first()[0] == 6


def test_units_and_words(spark):
    whole = "Dr. Poe met J. Doe at 3.5 {NS} miles. Really?! don’t “stop” now"
    w = text.words(spark.createDataFrame([(1, whole), (2, None), (3, ""), (4, "...")], "k int, text string"), "k")
    for r in w.collect():
        assert whole[r["char_start"] : r["char_end"]] == r["word"]
    cut = text.units(text.unit_boundaries(w, "k"), "k").orderBy("unit").collect()
    assert [whole[r["char_start"] : r["char_end"]] for r in cut] == ["Dr. Poe met J. Doe at 3.5 {NS} miles", "Really", "don’t “stop” now"]
    pairs = spark.createDataFrame([(1, "I'm gonna go", "i am going to go"), (2, None, "x"), (3, "Straße", "STRASSE")], "k int, a string, b string")
    assert sorted((r["k"], r["word"], r["status"]) for r in text.aligned(pairs, "k", "a", "b").collect()) == [(1, "go", "exact"), (1, "gonna", "normalized"), (1, "i'm", "normalized"), (3, "strasse", "exact")]


def test_alignment_against_blocks(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["gonna", "going", "to", "can't", "can", "not", "a", "b", "cannot"]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 9))), " ".join(rng.choice(vocabulary, rng.integers(0, 9)))) for k in range(60)]
    want = set()
    for k, a, b in rows:
        flat = [[(p, i) for i, w in enumerate(x.split()) for p in text.EXPANSIONS.get(w, w).split()] for x in (a, b)]
        blocks = difflib.SequenceMatcher(None, [p for p, _ in flat[0]], [p for p, _ in flat[1]], autojunk=False).get_matching_blocks()
        pairs = {m.a + d: flat[1][m.b + d][1] for m in blocks for d in range(m.size)}
        for i, w in enumerate(a.split()):
            met = [pairs.get(n) for n, (_, own) in enumerate(flat[0]) if own == i]
            if None in met:
                want.add((k, i, w, "unresolved", None))
            else:
                want.add((k, i, w, "exact" if len(set(met)) == 1 and b.split()[met[0]] == w else "normalized", met[0]))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    assert {tuple(r) for r in text.aligned(df, "k", "a", "b").collect()} == want
    assert text.aligned(df.limit(0), "k", "a", "b").collect() == []


def test_long_phrases(spark):
    long = [f"w{i % 7}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x " + " ".join(long) + " end"), (2, " ".join(long[:39])), (3, "a a a"), (4, None)], "k int, text string")
    phrases = spark.createDataFrame([("long", long), ("twice", ["a", "a"]), ("one", ["end"]), ("none", []), ("null", None), ("odd", ["a", None])], "p string, tokens array<string>")
    got = text.phrase_positions(text.words(docs, "k"), "k", phrases, "p")
    assert {tuple(r) for r in got.collect()} == {("long", 1, 1), ("twice", 3, 0), ("twice", 3, 1), ("one", 1, 41)}


@pytest.mark.parametrize("most_sent", [text.MOST_PHRASES, 2])
def test_phrases_meet_texts_where_they_lie(spark, most_sent):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(rng.choice(["the", "Phone", "rang", "{BR}", "a.", "don’t"], rng.integers(0, 60)))) for k in range(80)] + [(80, None), (81, ""), (None, "the phone rang")]
    docs = spark.createDataFrame(rows, "k int, text string")
    asked = {1: ["the", "phone", "rang"], 2: ["the"], 3: ["a", "a"], 4: ["don’t", "the", "a", "phone", "a"], 5: ["the", "phone"], 6: [], 7: None, 8: ["the", None], 9: ["phone"] * 70}
    want = set()
    for k, value in rows:
        own = [w.lower().rstrip(".") for w in (value or "").split() if w != "{BR}"]
        want |= {(p, k, i) for p, tokens in asked.items() if tokens and None not in tokens for i in range(len(own)) if own[i : i + len(tokens)] == tokens}
    phrases = spark.createDataFrame(list(asked.items()), "p int, tokens array<string>")
    found = text.text_phrases(docs, "k", phrases, "p", most_sent=most_sent)
    places = [tuple(r) for r in found.collect()]
    assert len(places) == len(set(places)) and set(places) == want
    cut = text.words(docs, "k")
    assert sorted(map(str, map(tuple, text.phrase_positions(cut, "k", phrases, "p", most_sent).collect()))) == sorted(map(str, places))
    gaps = {(p, k, i) for p, k, i in want if k is not None and all((i + j) % 3 for j in range(len(asked[p])))}
    assert {tuple(r) for r in text.phrase_positions(cut.where("k IS NOT NULL AND idx % 3 > 0"), "k", phrases, "p", most_sent).collect()} == gaps
    assert text.text_phrases(docs, "k", phrases.limit(0), "p").collect() == []


def test_phrases_shuffle_no_words(spark, data, tmp_path):
    from loomspan.plans.text import QUERIES

    found = QUERIES["phrase_positions"](spark, data)
    found.write.parquet(str(tmp_path / "found"))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_query_language(spark, data):
    for bad in ({"op": "no"}, {"op": "role", "event": "e"}, {"op": "role", "event": "e", "role": "r", "x": 1}, {"op": "compose", "event": "e", "steps": [{"op": "role"}]}):
        with pytest.raises(ValueError):
            annotation.validate_query(bad)
    view = annotation.graph_view(spark, data)
    row = view.arguments.where("support <> 'unresolved' AND target IS NOT NULL").first()
    asked = {"known": {"op": "role", "event": row["event"], "role": row["role"]}, "none": {"op": "role", "event": "no", "role": "x"}, "way": {"op": "compose", "event": row["event"], "steps": [{"op": "role", "role": row["role"]}]}}
    got = {r["query_id"]: r["labels"] for r in annotation.answer(spark, view, asked).collect()}
    assert row["target"] in got["known"] and got["none"] is None and got["way"] == got["known"]


def test_later_rows_change_no_earlier_state(spark, data):
    view = annotation.graph_view(spark, data)
    early = view.at(3).mentions.select("id").distinct().count()
    assert early == view.at(5).mentions.where("unit_index <= 3").select("id").distinct().count()


def test_whole_vectors(spark, data):
    frame = pd.read_parquet(f"{data}/embeddings.parquet")
    x, p = np.stack(frame["embedding"]).astype(float), len(frame["embedding"].iloc[0])
    parts = numeric.QUERIES["local_components"](spark, data).collect()
    for label in frame["label"].unique():
        own = x[frame["label"] == label]
        z = (own - own.mean(0)) / own.std(0)
        got = {r["k"]: r for r in parts if r["group"] == str(label)}
        assert np.allclose([got[k]["eigenvalue"] for k in range(3)], np.linalg.eigvalsh(z.T @ z / len(z))[::-1][:3]) and all(len(got[k]["weights"]) == p for k in got)
    fit, y = numeric.QUERIES["ridge_selected"](spark, data).first(), frame["label"].to_numpy(float)
    centred = x - x.mean(0)
    assert np.allclose(fit["weights"], np.linalg.solve(centred.T @ centred + fit["alpha"] * np.eye(p), centred.T @ (y - y.mean())))
    sums = {(r["label"], r["i"], r["j"]): r["s"] for r in numeric.QUERIES["gram_matrix"](spark, data).collect()}
    own = x[frame["label"] == 0]
    assert len(sums) == frame["label"].nunique() * p * (p + 1) // 2 and np.allclose([sums[0, p - 2, p - 1], sums[0, 0, p - 1]], [own[:, p - 2] @ own[:, p - 1], own[:, 0] @ own[:, p - 1]], atol=1e-5)
    assert numeric.QUERIES["group_zscore"](spark, data).count() == len(x) * p


def test_all_letters_of_all_texts(spark, tmp_path):
    docs = [("a", "Brook İstanbul ÄZ"), ("a", None), (None, "Quiz fox!"), (None, ""), ("b", "\u212a \u0130I")]
    spark.createDataFrame(docs, "source string, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    part = next((tmp_path / "made").glob("*.parquet"))
    (tmp_path / "in").mkdir()
    part.rename(tmp_path / "in" / "documents.parquet")
    query = text_plans.QUERIES["letter_histogram"]
    got = {(r["source"], r["letter"]): r["n"] for r in query(spark, str(tmp_path / "in")).collect()}
    assert len(got) == 3 * 26 and {k for k, n in got.items() if n and k[0] is None} == {(None, c) for c in "quizfox"}
    assert (got["a", "i"], got["a", "o"], got["a", "z"], got["b", "k"], got["b", "i"]) == (1, 2, 1, 1, 2)
    check(spark, str(tmp_path / "in"), query, text_plans.ORACLE["letter_histogram"])


def test_bins_reach_the_last_event(spark, data, tmp_path):
    events = pd.read_parquet(f"{data}/events.parquet")
    late = events.iloc[[0]].assign(ts=events["ts"].min().normalize() + pd.Timedelta(days=60), event_id=500 * 10**6)
    pd.concat([events, late]).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    found = {name: clock_plans.QUERIES[name](spark, str(tmp_path)).toPandas() for name in ("bin_sums", "bin_means", "known_mask", "fir_design", "support_exclusions")}
    last, kinds = found["bin_sums"]["t"].max(), events["event_type"].nunique()
    assert last > 8000 and all(len(found[name]) == (last + 1) * kinds for name in ("bin_sums", "bin_means", "known_mask", "fir_design"))
    assert found["bin_sums"]["n"].sum() == found["bin_means"]["n"].sum() == events["value"].count() + late["value"].count()
    mask = found["known_mask"].set_index(["event_type", "t"])["known"]
    assert not mask[late["event_type"].iloc[0], last] and mask[late["event_type"].iloc[0], last - 3]
    assert (found["support_exclusions"]["rows"] == last + 1).all() and found["support_exclusions"]["excluded_trimmed"].max() <= 20


def test_primal_equals_dual(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(60, 5)), rng.normal(size=(60, 9))
    y = a @ rng.normal(size=5) + b[:, 0] + rng.normal(size=60)
    rows = [("g", i % 4, a[i].tolist(), b[i].tolist(), float(y[i])) for i in range(60)] + [("g", 1, None, b[0].tolist(), 1.0)]
    df = spark.createDataFrame(rows, "by string, fold int, a array<double>, b array<double>, y double").repartition(7)
    mixtures, alphas = [[1.0, 1.0], [0.1, 3.0], [0.0, 1.0]], [0.5, 20.0]
    sums = linalg.fold_sums(df, "by", "fold", ["a", "b"], "y")
    grid = {(r["mixture"], r["alpha"]): r for r in linalg.encoding_grid(sums, mixtures, alphas).collect()}
    fold = np.arange(60) % 4

    def dual(mixture, alpha, train, test):
        x = np.c_[a * mixture[0] ** 0.5, b * mixture[1] ** 0.5]
        centre = x[train].mean(0)
        inner = (x[train] - centre) @ (x[train] - centre).T
        return y[train].mean() + (x[test] - centre) @ (x[train] - centre).T @ np.linalg.solve(inner + alpha * np.eye(train.sum()), y[train] - y[train].mean())

    for k, mixture in enumerate(mixtures):
        for alpha in alphas:
            r = grid[k, alpha]
            whole = np.ones(60, bool)
            assert np.allclose(r["intercept"] + np.c_[a, b] @ r["weights"], dual(mixture, alpha, whole, whole))
            assert np.isclose(r["loss"], np.mean(np.concatenate([(y[fold == f] - dual(mixture, alpha, fold != f, fold == f)) ** 2 for f in range(4)])))
    chosen = linalg.selected_encoding(linalg.encoding_grid(sums, mixtures, alphas))
    best = chosen.first()
    assert best["loss"] == min(r["loss"] for r in grid.values())
    fits = linalg.held_out_fits(sums, chosen, mixtures)
    got = {r["y"]: r["predicted"] for r in linalg.predicted(df.dropna(), fits, {"by": "by", "fold": "fold"}, ["a", "b"]).collect()}
    for f in range(4):
        assert np.allclose([got[v] for v in y[fold == f]], dual(mixtures[best["mixture"]], best["alpha"], fold != f, fold == f))
    assert linalg.encoding_grid(linalg.fold_sums(df.limit(0), "by", "fold", ["a", "b"], "y"), mixtures, alphas).count() == 0


def test_nested_scopes(spark, data):
    from loomspan.plans import questions as plans

    got = {r["context"]: r["digest"] for r in plans.QUERIES["scope_digests"](spark, data).collect()}
    view = annotation.graph_view(spark, data)
    concept, predicate = {}, {}
    for r in view.entities.collect():
        concept[r["id"]] = min(filter(None, (concept.get(r["id"]), r["concept"])), default=None)
    for r in view.events.collect():
        predicate[r["id"]] = min(filter(None, (predicate.get(r["id"]), r["predicate"])), default=None)
    nodes = {r["id"]: r for r in view.contexts.collect()}

    def digest(i, above=()):
        if i in above:
            return None
        r = nodes[i]
        own = {k: v for k, v in (("kind", r["kind"]), ("holder", concept.get(r["holder"])), ("attribution", predicate.get(r["attribution"]))) if v is not None}
        inner = {digest(p, (*above, i)) for p in r["parents"] or [] if p in nodes}
        return None if None in inner else hashlib.sha256(json.dumps([json.dumps(own, separators=(",", ":"), ensure_ascii=False), sorted(inner)], ensure_ascii=False).encode()).hexdigest()

    assert got == {i: digest(i) for i in nodes}


def test_best_matches(spark, data):
    names = pd.read_parquet(f"{data}/known_name.parquet")
    given, family = ({n.lower() for n in names[names.role == role].name.dropna()} for role in ("given", "family"))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    want = {}
    for g in given:
        ranked = sorted((-round(1 - distance(g, f) / max(len(g), len(f), 1), 6), f) for f in family)
        want[g] = (ranked[0][1], -ranked[0][0])
    got = {r["given"]: (r["family"], r["score"]) for r in text_plans.QUERIES["best_match_margin"](spark, data).collect()}
    assert got == want


def test_quantiles_and_multisets(spark):
    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=101), "b": np.array([3.0]), "c": np.repeat(2.0, 10)}
    df = spark.createDataFrame([(k, float(v)) for k, values in x.items() for v in values] + [("a", None), ("a", float("nan")), (None, 1.0)], "k string, v double").repartition(5)
    got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in stats.quantiles(df, "k", "v", {"lo": 0.1, "mid": 0.5, "hi": 1.0}).collect()}
    assert all(np.allclose(got[k], np.quantile(values, [0.1, 0.5, 1.0])) for k, values in x.items()) and len(got) == 3
    rows = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "a string, b int")
    assert tuple(relate.multiset_difference(rows, rows.distinct()).first()) == (1, 0)
    assert tuple(relate.multiset_difference(rows.limit(0), rows).first()) == (0, 3)


def test_chains_comparators_and_names(spark):
    chain = spark.createDataFrame([("u", 1, "a", None), ("u", 2, "b", "a"), ("u", 3, "c", "x"), ("v", 1, "d", "a")], "u string, n int, h string, p string")
    assert {(r["u"], r["n"], r["expected"]) for r in relate.broken_links(chain, "u", ["n"], "h", "p").collect()} == {("u", 3, "b"), ("v", 1, None)}
    left = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    assert {tuple(r) for r in relate.comparator(left, ["k"], left.where("k = 1"), "v").collect()} == {(1, 2.0, 2.0), (2, 3.0, None)}
    with pytest.raises(Exception, match="more than one comparator"):
        relate.comparator(left, ["k"], left.union(left), "v").collect()
    ledger = spark.createDataFrame([(1, [("b", 1), ("a", 2), (None, 3)]), (2, []), (3, None)], "k int, ops array<struct<id:string,n:int>>")
    names = spark.createDataFrame([("a", "A")], "old string, new string")
    got = {r["k"]: r["ops"] for r in relate.renamed(ledger, "k", "ops", "id", names).collect()}
    assert [tuple(x) for x in got[1]] == [("b", 1), ("A", 2), (None, 3)] and got[2] == [] and got[3] is None


def test_arrays_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, [1, 2], [3.0, 4.0]), (2, [], []), (3, None, None)], "k int, a array<int>, b array<double>")
    got = {r["k"]: r["z"] for r in relate.strict_zip(df, "a", "b", "z").collect()}
    assert [tuple(x) for x in got[1]] == [(1, 3.0), (2, 4.0)] and got[2] == [] and got[3] is None
    with pytest.raises(Exception, match="differ in length"):
        relate.strict_zip(df.limit(0).union(spark.createDataFrame([(4, [1], [1.0, 2.0])], df.schema)), "a", "b", "z").collect()


def test_questions_of_empty_and_odd_graphs(spark, data, tmp_path):
    from loomspan.operators import questions

    for name in ("draft", "mention", "relation", "identity_link", "context"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    asked, left_out = questions.generate(annotation.graph_view(spark, str(tmp_path)))
    assert asked.collect() == [] == left_out.collect()
    view = annotation.graph_view(spark, data)
    asked, _ = questions.generate(view)
    rows = asked.collect()
    assert {r["family"] for r in rows} == set(questions.FAMILIES) and len({r["query_id"] for r in rows}) == len(rows)
    assert all(len(set(r["acceptable"])) == len(r["acceptable"]) < r["n_candidates"] and all(0 <= k < r["n_candidates"] for k in r["acceptable"]) for r in rows)
    assert all((r["label_state"] == "needs_adjudication") == (not r["acceptable"]) for r in rows)
    again = {(r["query_id"], tuple(r["acceptable"])) for r in questions.generate(view, seed=0)[0].collect()}
    other = {(r["query_id"], tuple(r["acceptable"])) for r in questions.generate(view, seed=1)[0].collect()}
    assert again == {(r["query_id"], tuple(r["acceptable"])) for r in rows} and other != again and {q for q, _ in other} == {q for q, _ in again}
    spans = annotation.answer(spark, view, {"a": {"op": "compose", "event": rows[0]["query_id"], "steps": [{"op": "scope_parent"}, {"op": "role", "role": "theme"}]}})
    assert [tuple(r) for r in spans.collect()] == [("a", None)]
