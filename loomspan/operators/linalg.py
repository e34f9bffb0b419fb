"""Moments, principal components, scaling and ridge regression as distributed sums and small solves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.skew import skew_join
from loomspan.sources import sinks


#: Rows into which the partial sums of one group are merged before the last merge, so no task sees one for each Arrow batch.
MERGES = 64


def _merged(parts: DataFrame, keys: list[str], merge) -> DataFrame:
    """Merge partial rows of equal keys by ``merge``, a function of a frame, first side by side and then once more."""
    schema = parts.schema
    first = parts.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(MERGES))).groupBy(*keys, "_part").applyInPandas(lambda frame: merge(frame.drop(columns="_part")), schema)
    return first.groupBy(*keys).applyInPandas(merge, schema)


def gram(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Sums of products of all coordinates of the vectors of each group: ``by, i <= j, s, n``; rows with a null vector are left out.

    Every Arrow batch is one matrix product a group. Its rows are then summed by coordinate, with partial sums before the shuffle.
    """

    def partial(frames):
        for frame in frames:
            for key, part in frame.groupby(by, sort=False):
                x = np.stack(part[vector].to_numpy()).astype(float)
                product = x.T @ x
                size = len(product)
                yield pd.DataFrame({by: [key] * size, "i": np.arange(size, dtype=np.int32), "row": [product[i, i:] for i in range(size)], "n": [len(x)] * size})

    kind = df.schema[by].dataType.simpleString()
    rows = df.where(F.col(vector).isNotNull() & F.col(by).isNotNull()).select(by, vector).mapInPandas(partial, f"{by} {kind}, i int, row array<double>, n bigint")
    each = rows.select(by, "i", F.posexplode("row").alias("d", "s"), "n")
    return each.groupBy(by, "i", (F.col("i") + F.col("d")).alias("j")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


_MOMENTS = "group string, n bigint, mean array<double>, scatter array<double>"


def story_moments(df: DataFrame, by: str, vector: str) -> DataFrame:
    """Count, mean and scatter matrix (row by row) of the vectors of every group, mergeable: one partial row per Arrow batch and group, merged pairwise."""

    def partial(frames):
        for frame in frames:
            for key, part in frame.groupby(by, sort=False, dropna=False):
                x = np.stack(part[vector].to_numpy()).astype(float)
                mean = x.mean(0)
                yield pd.DataFrame([(str(key), len(x), mean, ((x - mean).T @ (x - mean)).ravel())], columns=["group", "n", "mean", "scatter"])

    return merge_moments(df.where(F.col(vector).isNotNull()).select(by, vector).mapInPandas(partial, _MOMENTS))


def merge_moments(parts: DataFrame, whole: bool = False) -> DataFrame:
    """Merge moments of equal groups (or all) by the parallel formula; the order of merging does not change the result beyond rounding."""
    parts = parts.withColumn("group", F.lit("all")) if whole else parts

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = 0, None, None
        for m, mu, s in zip(frame["n"], frame["mean"], frame["scatter"], strict=True):
            mu, s = np.asarray(mu), np.asarray(s).reshape(len(mu), -1)
            if n == 0:
                n, mean, scatter = m, mu, s.copy()
                continue
            delta = mu - mean
            scatter = scatter + s + np.outer(delta, delta) * n * m / (n + m)
            mean, n = mean + delta * m / (n + m), n + m
        return pd.DataFrame([(frame["group"].iloc[0], n, mean, scatter.ravel())], columns=["group", "n", "mean", "scatter"])

    return _merged(parts, ["group"], run)


def principal_components(moments: DataFrame, components: int) -> DataFrame:
    """Components of standardised coordinates from moments: ``group, k, eigenvalue, weights``.

    Coordinates with a deviation of at most 1e-8 are left out (weight 0), as are eigenvalues of at most 1e-8; the weight of greatest
    size is positive.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for group, n, scatter in zip(frame["group"], frame["n"], frame["scatter"], strict=True):
            p = int(len(scatter) ** 0.5)
            cov = np.asarray(scatter).reshape(p, p) / n
            sd = np.sqrt(np.diag(cov))
            active = np.flatnonzero(sd > 1e-8)
            if not len(active):
                continue
            values, vectors = np.linalg.eigh(cov[np.ix_(active, active)] / np.outer(sd[active], sd[active]))
            for k, at in enumerate(np.argsort(values)[::-1][:components]):
                if values[at] > 1e-8:
                    w = np.zeros(p)
                    w[active] = vectors[:, at] * (1 if vectors[np.abs(vectors[:, at]).argmax(), at] > 0 else -1)
                    out.append((group, k, float(values[at]), w))
        return pd.DataFrame(out, columns=["group", "k", "eigenvalue", "weights"])

    return moments.mapInPandas(lambda frames: map(run, frames), "group string, k int, eigenvalue double, weights array<double>")


def group_scaled(df: DataFrame, train: str, group: str, coordinate: str, value: str) -> DataFrame:
    """Add ``z``: standardised by training rows and divided by the root of the group's active coordinates, so groups have equal variance.

    Long table; ``train`` is a boolean column. Coordinates that do not vary in training are left out.
    """
    fit = df.where(F.col(train)).groupBy(group, coordinate).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s")).where("_s > 1e-8")
    active = fit.groupBy(group).agg(F.count("*").alias("_k"))
    return df.join(fit, [group, coordinate]).join(active, group).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s") / F.sqrt("_k")).drop("_m", "_s", "_k")


def ridge(df: DataFrame, by: str, features: str, target: str, alphas: list[float], fold: str) -> DataFrame:
    """Ridge regression with the penalty chosen over folds: ``by, alpha, loss, intercept, weights``.

    Spark sums the Gram matrix, cross products and totals of every fold and group as blocks, merged in two steps; a group's
    solves see those sums only, never rows. Training sums of a fold are all minus its own. Loss is the mean squared error of held-out
    rows by the closed form; of equal losses the first penalty counts.
    """

    def partial(frames):
        for frame in frames:
            for (key, f), part in frame.groupby([by, fold], sort=False):
                x = np.stack(part[features].to_numpy()).astype(float)
                z = np.c_[np.ones(len(x)), x, part[target].to_numpy(float)]
                yield pd.DataFrame([(key, f, (z.T @ z).ravel())], columns=["by", "fold", "g"])

    kinds = (df.schema[by].dataType.simpleString(), df.schema[fold].dataType.simpleString())
    sums = df.select(by, fold, features, target).mapInPandas(partial, f"by {kinds[0]}, fold {kinds[1]}, g array<double>")

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(frame["by"].iloc[0], frame["fold"].iloc[0], np.sum(np.stack(frame["g"].to_numpy()), axis=0))], columns=["by", "fold", "g"])

    whole = _merged(sums, ["by", "fold"], added)

    def solve(g: np.ndarray, alpha: float) -> np.ndarray:
        n, p = g[0, 0], len(g) - 2
        mean = g[0, 1:] / n
        centred = g[1:, 1:] - n * np.outer(mean, mean)
        w = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p])
        return np.r_[mean[p] - mean[:p] @ w, w]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        size = int(len(frame["g"].iloc[0]) ** 0.5)
        folds = [np.asarray(g).reshape(size, size) for g in frame.sort_values("fold")["g"]]
        total = sum(folds)
        losses = []
        for alpha in alphas:
            error = 0.0
            for held in folds:
                if len(folds) == 1 or total[0, 0] - held[0, 0] < 2:
                    continue
                b = np.r_[-solve(total - held, alpha), 1.0]
                error += b @ held @ b
            losses.append(error / total[0, 0])
        best = int(np.argmin(losses))
        w = solve(total, alphas[best])
        return pd.DataFrame([(frame["by"].iloc[0], alphas[best], losses[best], w[0], w[1:])], columns=[by, "alpha", "loss", "intercept", "weights"])

    return whole.groupBy("by").applyInPandas(run, f"{by} {kinds[0]}, alpha double, loss double, intercept double, weights array<double>")


# --- encoding with groups of features ----------------------------------------------------------------------------------


def fold_sums(df: DataFrame, by: str, fold: str, blocks: list[str], target: str) -> DataFrame:
    """Products of (1, features, target) summed by group and fold: ``by, fold, sizes, g``; all that fits, losses and mixtures below need.

    ``blocks`` name array columns, one for each group of features; ``sizes`` are their lengths. Sums are merged in two steps, so a task holds no more than MERGES of
    them; rows with nulls are left out.
    """

    def partial(frames):
        for frame in frames:
            for (key, f), part in frame.groupby([by, fold], sort=False):
                held = [np.stack(part[b].to_numpy()).astype(float) for b in blocks]
                z = np.c_[np.ones(len(part)), np.hstack(held), part[target].to_numpy(float)]
                yield pd.DataFrame([(key, f, [h.shape[1] for h in held], (z.T @ z).ravel())], columns=["by", "fold", "sizes", "g"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        return pd.DataFrame([(first["by"], first["fold"], first["sizes"], np.sum(np.stack(frame["g"].to_numpy()), axis=0))], columns=["by", "fold", "sizes", "g"])

    kinds = (df.schema[by].dataType.simpleString(), df.schema[fold].dataType.simpleString())
    whole = df.select(by, fold, *blocks, target).dropna()
    return _merged(whole.mapInPandas(partial, f"by {kinds[0]}, fold {kinds[1]}, sizes array<int>, g array<double>"), ["by", "fold"], added)


class _Spectrum:
    """Ridge solutions for all penalties from one decomposition of centred products, with each block of features scaled by the root of its weight."""

    def __init__(self, g: np.ndarray, scale: np.ndarray) -> None:
        p = len(scale)
        self.mean, self.scale = g[0, 1:] / g[0, 0], scale
        centred = g[1:, 1:] - g[0, 0] * np.outer(self.mean, self.mean)
        self.values, self.vectors = np.linalg.eigh(centred[:p, :p] * np.outer(scale, scale))
        self.rotated = self.vectors.T @ (scale * centred[:p, p])

    def fit(self, alpha: float) -> np.ndarray:
        """Intercept and weights in the features' own scale."""
        w = self.scale * (self.vectors @ (self.rotated / (np.maximum(self.values, 0) + alpha)))
        return np.r_[self.mean[-1] - self.mean[:-1] @ w, w]


def _scales(sizes: list[int], mixture: list[float]) -> np.ndarray:
    return np.repeat(np.sqrt(np.asarray(mixture, float)), sizes)


def _folds(frame: pd.DataFrame) -> dict[object, np.ndarray]:
    size = int(round(len(frame["g"].iloc[0]) ** 0.5))
    return {f: np.asarray(g).reshape(size, size) for f, g in sorted(zip(frame["fold"], frame["g"], strict=True), key=lambda x: x[0])}


def encoding_grid(sums: DataFrame, mixtures: list[list[float]], alphas: list[float]) -> DataFrame:
    """Every mixture of feature groups with every penalty: ``by, mixture (its place), alpha, loss, intercept, weights``.

    The kernel of a mixture is the sum of the groups' kernels times their weights, here in its primal form. Loss is the mean squared error of held-out rows in closed form from the sums; for each fold
    and mixture one spectrum serves all penalties. With one fold the loss is null. ``sums`` as ``fold_sums`` gives them.
    """
    kind = sums.schema["by"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        folds, sizes = _folds(frame), list(frame["sizes"].iloc[0])
        total = sum(folds.values())
        out = []
        for k, mixture in enumerate(mixtures):
            scale = _scales(sizes, mixture)
            left = [(_Spectrum(total - held, scale), held) for held in folds.values() if total[0, 0] - held[0, 0] >= 2]
            whole = _Spectrum(total, scale)
            for alpha in alphas:
                errors = [b @ held @ b for b, held in ((np.r_[-s.fit(alpha), 1.0], held) for s, held in left)]
                w = whole.fit(alpha)
                out.append((frame["by"].iloc[0], k, float(alpha), sum(errors) / total[0, 0] if left else None, w[0], w[1:]))
        return pd.DataFrame(out, columns=["by", "mixture", "alpha", "loss", "intercept", "weights"]).astype({"loss": "float64"})

    return sums.groupBy("by").applyInPandas(run, f"by {kind}, mixture int, alpha double, loss double, intercept double, weights array<double>")


def selected_encoding(grid: DataFrame) -> DataFrame:
    """The entry of least loss for each group; of equal losses the first mixture, then the least penalty."""
    best = F.min_by(F.struct("mixture", "alpha", "loss", "intercept", "weights"), F.struct(F.coalesce("loss", F.lit(0.0)), "mixture", "alpha"))
    return grid.groupBy("by").agg(best.alias("b")).select("by", "b.*")


def held_out_fits(sums: DataFrame, selected: DataFrame, mixtures: list[list[float]]) -> DataFrame:
    """Fits of the selected mixture and penalty without each fold: ``by, fold, intercept, weights``."""
    kinds = (sums.schema["by"].dataType.simpleString(), sums.schema["fold"].dataType.simpleString())

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        folds, scale = _folds(frame), _scales(list(frame["sizes"].iloc[0]), mixtures[int(frame["mixture"].iloc[0])])
        total, alpha = sum(folds.values()), float(frame["alpha"].iloc[0])
        fits = [(f, _Spectrum(total - held, scale).fit(alpha)) for f, held in folds.items() if total[0, 0] - held[0, 0] >= 2]
        return pd.DataFrame([(frame["by"].iloc[0], f, w[0], w[1:]) for f, w in fits], columns=["by", "fold", "intercept", "weights"])

    chosen = sums.join(selected.select("by", "mixture", "alpha"), "by")
    return chosen.groupBy("by").applyInPandas(run, f"by {kinds[0]}, fold {kinds[1]}, intercept double, weights array<double>")


def predicted(df: DataFrame, fits: DataFrame, keys: dict[str, str], blocks: list[str], name: str = "predicted") -> DataFrame:
    """Add ``name``: intercept plus features times weights, of the fit with the row's ``keys`` (column of the frame: column of the fits); rows without a fit are left out.

    A group may hold any part of the rows; they are split in the join.
    """
    named = fits.select(*[F.col(b).alias(a) for a, b in keys.items()], F.col("intercept").alias("_c"), F.col("weights").alias("_w"))
    joined = skew_join(df, named, list(keys))
    product = F.aggregate(F.zip_with(F.concat(*[F.col(b).cast("array<double>") for b in blocks]), "_w", lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn(name, F.col("_c") + product).drop("_c", "_w")


def save_fit(root: str, fits: dict[str, DataFrame], identity: dict) -> str:
    """Publish fitted tables (weights, vocabularies, scalers) as one build under the digest of what they are; returns the digest."""
    return sinks.publish(next(iter(fits.values())).sparkSession, root, fits, identity)


def load_fit(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A fitted table of the newest build; one whose content is not that of the receipt raises."""
    newest = sinks.latest(spark, root)
    if name in sinks.verify(spark, newest):
        raise ValueError(f"{name} is not what was saved")
    return spark.read.parquet(f"{newest}/{name}")
