"""Statistics: correlations, permutation, bootstrap, signatures and dissimilarities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.aggregates import numbered
from loomspan.operators.relate import average_rank


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(df: DataFrame, vector: str, name: str = "unit") -> DataFrame:
    """Add the vector at length 1, null where its length is at most 1e-12."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return df.withColumn("_norm", norm).withColumn(name, F.when(F.col("_norm") > 1e-12, F.transform(vector, lambda x: x / F.col("_norm")))).drop("_norm")


def cosine_rdm(items: DataFrame, item: str, vector: str, blocks: int | None = None) -> DataFrame:
    """Cosine dissimilarities of all pairs of items: ``item_i < item_j, d`` between 0 and 2; items without direction are left out.

    A dissimilarity matrix is all pairs by definition. Items fall into blocks by their hash, of some 512 items where ``blocks`` is not given, and each pair of blocks
    meets once, as a task of its own.
    """
    unit = unit_vectors(items, vector).where("unit IS NOT NULL")
    if blocks is None:
        blocks = max(1, unit.count() // 512)
    unit = unit.select(F.col(item).alias("i"), F.col("unit").alias("u"), F.pmod(F.xxhash64(item), F.lit(blocks)).cast("int").alias("b"))
    left = unit.select(F.col("i").alias("x"), F.col("u").alias("ux"), F.col("b").alias("bx"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("by"))
    right = unit.select(F.col("i").alias("y"), F.col("u").alias("uy"), F.explode(F.sequence(F.lit(0), F.col("b"))).alias("bx"), F.col("b").alias("by"))
    met = left.join(right, ["bx", "by"]).where("bx < by AND x <> y OR x < y")
    d = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(F.col("ux"), F.col("uy"))))
    return met.select(F.least("x", "y").alias("item_i"), F.greatest("x", "y").alias("item_j"), d.alias("d"))


def quantiles(df: DataFrame, by: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation: ``by`` and one column for each name of ``at``. Null and NaN values do not count.

    Values are numbered in a global order of group and value, so no group is held or sorted in one task; a quantile lies between two numbers.
    """
    known = df.where(F.col(by).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(by, F.col(value).cast("double").alias("_x"))
    ranked = numbered(known, [by, "_x"], "_k")
    first = ranked.groupBy(by).agg(F.min("_k").alias("_first"), F.count("*").alias("_n"))
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    k = F.col("_k") - F.col("_first")
    made = []
    for name, q in at.items():
        low, part = F.floor(place(q)), place(q) - F.floor(place(q))
        below, above = F.max(F.when(k == low, F.col("_x"))), F.max(F.when(k == F.least(low + 1, F.col("_n") - 1), F.col("_x")))
        made.append((below + F.max(part) * (above - below)).alias(name))
    return ranked.join(F.broadcast(first), by).groupBy(by).agg(*made)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties: ``by..., n, rho``; null where a side is constant."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col("_x"), F.col("_y")).alias("rho"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two columns, null where the deviations' product is at most 1e-12."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / spread)


def permutation_p(rdms: DataFrame, by: str, permutations: int = 1000, seed: int = 11) -> DataFrame:
    """Label-permutation test of the rank correlation of two dissimilarity matrices: ``by, items, rho, p``.

    ``rdms``: ``by, item_i, item_j, a, b``, all pairs of the items, upper triangle. Ranks are taken once; a permutation of the labels
    only reorders them. p is (1 + hits) / (1 + permutations), two-sided. Fewer than three items or constant sides give nulls.
    One group's matrix must fit a task.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame["item_i"]) | set(frame["item_j"]))
        place = {n: k for k, n in enumerate(names)}
        i, j = frame["item_i"].map(place).to_numpy(), frame["item_j"].map(place).to_numpy()
        key, n = frame[by].iloc[0], len(names)
        if n < 3 or len(frame) != n * (n - 1) // 2 or frame[["a", "b"]].isna().to_numpy().any():
            return pd.DataFrame([(key, n, None, None)], columns=[by, "items", "rho", "p"]).astype({"rho": "float64", "p": "float64"})
        ra, rb = frame["a"].rank().to_numpy(), frame["b"].rank().to_numpy()
        ra, rb = ra - ra.mean(), rb - rb.mean()
        norm = np.linalg.norm(ra) * np.linalg.norm(rb)
        if norm <= 1e-12:
            return pd.DataFrame([(key, n, None, None)], columns=[by, "items", "rho", "p"]).astype({"rho": "float64", "p": "float64"})
        ranked = np.zeros((n, n))
        ranked[i, j] = ranked[j, i] = rb
        rho = float(ra @ rb / norm)
        draw = np.random.default_rng(seed)
        hits = 0
        for _ in range(permutations):
            order = draw.permutation(n)
            hits += abs(float(ra @ ranked[order[i], order[j]] / norm)) >= abs(rho) - 1e-12
        return pd.DataFrame([(key, n, rho, (1 + hits) / (1 + permutations))], columns=[by, "items", "rho", "p"])

    kind = rdms.schema[by].dataType.simpleString()
    return rdms.select(by, "item_i", "item_j", "a", "b").groupBy(by).applyInPandas(run, f"{by} {kind}, items int, rho double, p double")


def crossed_interval(cells: DataFrame, by: str, subject: str, story: str, value: str, samples: int = 1000, seed: int = 11) -> DataFrame:
    """Mean difference and percentile interval over resampled subjects and stories: ``by, mean, low, high, subjects, stories, available``.

    Several values of a cell are averaged first, in Spark. An incomplete panel, one subject or one story is unavailable, never filled.
    """
    mean = cells.groupBy(by, subject, story).agg(F.avg(value).alias("v"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        panel = frame.pivot(index=subject, columns=story, values="v").sort_index().sort_index(axis=1)
        m, key = panel.to_numpy(float), frame[by].iloc[0]
        fine = min(m.shape) > 1 and np.isfinite(m).all()
        low = high = None
        if fine:
            draw = np.random.default_rng(seed)
            draws = [m[np.ix_(draw.integers(len(m), size=len(m)), draw.integers(m.shape[1], size=m.shape[1]))].mean() for _ in range(samples)]
            low, high = np.quantile(draws, [0.025, 0.975])
        return pd.DataFrame([(key, m.mean() if fine else None, low, high, m.shape[0], m.shape[1], fine)], columns=[by, "mean", "low", "high", "subjects", "stories", "available"]).astype({"mean": "float64", "low": "float64", "high": "float64"})

    kind = cells.schema[by].dataType.simpleString()
    return mean.groupBy(by).applyInPandas(run, f"{by} {kind}, mean double, low double, high double, subjects int, stories int, available boolean")


def evaluate_predictions(predictions: DataFrame) -> DataFrame:
    """Add ``chance, correct, nll`` to rows with ``logits`` and ``acceptable`` (indices from 0).

    Correct if the first greatest logit is acceptable; nll is the negative log of the probability of all acceptable ones.
    """
    top = F.array_max("logits")
    whole = lambda a: F.log(F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))
    chosen = F.transform("acceptable", lambda i: F.element_at("logits", i.cast("int") + 1))
    best = F.array_position("logits", top) - 1
    return predictions.select("*", (F.size("acceptable") / F.size("logits")).alias("chance"), F.array_contains("acceptable", best.cast("int")).cast("double").alias("correct"), (whole("logits") - whole(chosen)).alias("nll"))


def softmax(df: DataFrame, by: list[str], logit: str) -> DataFrame:
    """Add ``p``, the probabilities of the logits of a group."""
    w = Window.partitionBy(*by)
    shifted = df.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(w)))
    return shifted.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def paired(first: DataFrame, second: DataFrame, keys: list[str], identity: str, value: str) -> DataFrame:
    """Differences of means of two conditions by cell: ``keys..., difference, matched``; ``matched`` if both rest on the same rows.

    Rows are compared by their number and the sum of digests of their ``identity``, so no list of them is made. Cells that only one side has are left out.
    """
    part = F.conv(F.substring(F.md5(F.col(identity).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    cells = lambda df, name: df.groupBy(*keys).agg(F.avg(value).alias(f"_{name}"), F.struct(F.count("*").alias("n"), F.sum(part).alias("h")).alias(f"_{name}_rows"))
    both = cells(first, "a").join(cells(second, "b"), keys)
    return both.select(*keys, (F.col("_a") - F.col("_b")).alias("difference"), (F.col("_a_rows") == F.col("_b_rows")).alias("matched"))


def query_prior(train: DataFrame, test: DataFrame, family: str, candidate: str, smoothing: float = 1.0) -> DataFrame:
    """Baseline answer per family: the training candidate with the greatest smoothed count, with its probability.

    ``train``: rows of chosen candidates. Result for each test family: ``family, best, p``; unseen families give nulls.
    """
    counts = train.groupBy(family, candidate).agg((F.count("*") + F.lit(smoothing)).alias("c"))
    total = counts.groupBy(family).agg(F.sum("c").alias("t"), F.max_by(candidate, F.struct("c", candidate)).alias("best"), F.max("c").alias("m"))
    return test.select(family).distinct().join(total.select(family, "best", (F.col("m") / F.col("t")).alias("p")), family, "left")


def site_replacement(scores: DataFrame, item: str, site: str, value: str, least: int = 1, order: list[Column] | None = None) -> DataFrame:
    """Drop of each item's summed score when its strongest sites are replaced by the mean of the others: ``item, full, replaced, drop``.

    ``order`` takes others first, such as by a hash, for the control with as many random sites.
    """
    w = Window.partitionBy(item).orderBy(*(order or [F.desc(value), F.col(site)]))
    ranked = scores.withColumn("_k", F.row_number().over(w))
    return ranked.groupBy(item).agg(F.sum(value).alias("full"), F.sum(F.when(F.col("_k") > least, F.col(value))).alias("_rest"), F.avg(F.when(F.col("_k") > least, F.col(value))).alias("_mean")).select(
        item, "full", (F.coalesce("_rest", F.lit(0.0)) + least * F.coalesce("_mean", F.lit(0.0))).alias("replaced")
    ).withColumn("drop", F.col("full") - F.col("replaced"))


