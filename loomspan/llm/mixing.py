"""Mix sources to target shares of the tokens by Poisson replication."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.aggregates import numbered
from loomspan.operators.skew import MOST_HOT, skew_join
from loomspan.session import checkpointed, kept

#: Cells into which the hashed numbers are cut in the search for a rate, and each cell in which a count changes once more.
CELLS = 4096
#: Cuts, one within the other: a cell of the last holds one in CELLS ** LEVELS of a source's documents, about 7e10.
LEVELS = 3
#: Least rows of a source that is split in the join with the rates.
HOT_ROWS = 200_000


def uniform(seed: int, *columns: str) -> Column:
    """A number of 53 bits between 0 and 1 from the hash of the columns, never 0 or 1."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def poisson_cdf(rate: float, most: int) -> np.ndarray:
    """P(N <= k) for k from 0 to most - 1, without the end that is 1 to the last bit; for an infinite rate all 0."""
    if math.isinf(rate):
        return np.zeros(most)
    if rate <= 0:
        return np.ones(min(most, 1))
    k = np.arange(min(most, int(rate + 40 * math.sqrt(rate) + 60)))
    log_factorial = np.r_[0.0, np.cumsum(np.log(np.maximum(k[1:], 1)))]
    with np.errstate(under="ignore"):
        cdf = np.cumsum(np.exp(k * math.log(rate) - rate - log_factorial))
    return np.minimum(cdf / cdf[-1] if len(k) < most else cdf, 1.0)


def copies(u: np.ndarray, cdf: np.ndarray) -> np.ndarray:
    """Capped inverse of the distribution."""
    return np.searchsorted(cdf, u, "left")


def fitted_rate(at: np.ndarray, tokens: np.ndarray, wanted: float, most: int) -> float:
    """Rate at which the capped counts bring the wanted number of tokens, by bisection; ``at`` are hashed numbers with their tokens.

    Counts grow with the rate, so the sum does; the rate is that from which on it is at least as near to the wanted number as any smaller one.
    """

    def reached(rate: float) -> float:
        return float(tokens @ copies(at, poisson_cdf(rate, most)))

    if wanted >= tokens.sum() * most:
        return math.inf
    low, high = 0.0, 1.0
    while reached(high) < wanted:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if reached(middle) < wanted else (low, middle)
    return low if wanted - reached(low) < reached(high) - wanted else high


_FITTED = "source string, rate double, cells array<struct<level:int,cell:long>>"


def _fits(sums: DataFrame, level: int) -> DataFrame:
    """Rate of each source by the cells so far, and the cells of this level in which a count changes, with their neighbours.

    ``sums``: ``source, wanted, most, level, cell, w``. A source has at most CELLS cells and as many for each count that changes in one; nothing reaches the driver.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        cut = {}
        for n in range(1, level):
            finer = frame.loc[frame["level"] == n + 1, "cell"].to_numpy()
            cut[n] = set((finer // CELLS).tolist())
        left = frame[[n >= level or c not in cut[n] for n, c in zip(frame["level"], frame["cell"], strict=True)]]
        width = float(CELLS) ** -left["level"].to_numpy(float)
        at, tokens = (left["cell"].to_numpy(float) + 0.5) * width, left["w"].to_numpy(float)
        wanted, most = float(frame["wanted"].iloc[0]), int(frame["most"].iloc[0])
        rate = fitted_rate(at, tokens, wanted, most)
        steps = np.floor(poisson_cdf(rate, most) * float(CELLS) ** level).astype(np.int64)
        near = np.unique(np.concatenate([steps - 1, steps, steps + 1]))
        here = frame.loc[frame["level"] == level, "cell"].to_numpy()
        cells = [{"level": level, "cell": int(c)} for c in np.intersect1d(near, here)]
        return pd.DataFrame({"source": [frame["source"].iloc[0]], "rate": [rate], "cells": [cells]})

    return sums.groupBy("source").applyInPandas(fit, _FITTED)


def mixed(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """Documents of the sources with a target, each as often as drawn: ``doc_id, source, tokens, copy``.

    ``documents``: ``doc_id, source, tokens``; ``targets``: ``source, target_share, max_repeats``. Each document gets the number
    that the inverse of a Poisson distribution gives at its own hashed number, at most ``max_repeats``. The rate of a source
    is fitted to the tokens it needs, so caps and uneven lengths are accounted for: over the tokens by cells of the hashed number, then once more over finer cells where
    a count changes, LEVELS times, so a rate may be as small as one document in billions. ``total`` is the number of tokens wanted; without it as many as the targeted sources hold, or fewer where a source cannot
    reach its share otherwise. Sources are fitted side by side; only two sums over all of them and the hashes of at most MOST_HOT hot ones reach the driver.

    Defined cases: documents without tokens or without a targeted source are left out; a target source without documents
    counts for nothing, the other shares are relative to their sum; null shares or caps count as 0; repeated targets: the largest;
    no targets or no documents: no rows. The same seed gives the same draw at any partitioning.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("most")).where("share > 0 AND most > 0")
    u = uniform(seed, "doc_id")
    drawn = documents.where("tokens > 0 AND source IS NOT NULL").select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"), u.alias("_u"))
    cell = lambda level: F.floor(F.col("_u") * F.lit(float(CELLS) ** level)).cast("long").alias("cell")
    weighed = lambda df, level: df.groupBy("source", cell(level)).agg(F.sum("tokens").alias("w"), F.count("*").alias("rows"))
    first = checkpointed(weighed(drawn, 1).join(wanted, "source"))
    held = first.groupBy("source", "share", "most").agg(F.sum("w").alias("held"), F.sum("rows").alias("rows"))
    reach = F.min(F.col("held") * F.col("most") / F.col("share"))
    whole = held.agg(F.sum("held").alias("held"), F.sum("share").alias("share"), reach.alias("reach")).first()
    goal = min(float(total) if total is not None else float(whole["held"] or 0), (whole["reach"] or 0.0) * (whole["share"] or 0.0))
    hot = {r["h"]: -(-r["rows"] // HOT_ROWS) for r in held.where(F.col("rows") >= 2 * HOT_ROWS).orderBy(F.desc("rows")).limit(MOST_HOT).select(F.xxhash64("source").alias("h"), "rows").collect()}
    asked = F.lit(goal) * F.col("share") / F.lit(whole["share"] or 1.0)
    sums = first.select("source", asked.alias("wanted"), "most", F.lit(1).alias("level"), "cell", "w")
    for level in range(1, LEVELS):
        cells = checkpointed(_fits(sums, level).select("source", F.explode("cells").alias("c")).select("source", F.col("c.cell").alias("cell")))
        inside = drawn.withColumn("cell", cell(level)).join(cells, ["source", "cell"], "left_semi").drop("cell")
        goals = held.select("source", asked.alias("wanted"), "most")
        sums = checkpointed(sums.unionByName(weighed(inside, level + 1).join(goals, "source").select("source", "wanted", "most", F.lit(level + 1).alias("level"), "cell", "w")))
    rates = _fits(sums, LEVELS).join(held.select("source", "most"), "source").select("source", "rate", "most")
    cdf = F.pandas_udf(lambda rate, most: pd.Series([poisson_cdf(r, m).tolist() for r, m in zip(rate, most, strict=True)]), "array<double>")
    rates = checkpointed(rates.select("source", cdf("rate", "most").alias("_cdf")))
    n = F.size(F.filter("_cdf", lambda p: p < F.col("_u")))
    repeated = skew_join(drawn, rates, ["source"], hot=hot).withColumn("_n", n).where("_n > 0")
    return repeated.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))


def shuffled(mix: DataFrame, seed: int = 0) -> DataFrame:
    """The mix in a global random order: a sort by hash over range partitions, with the rank of each row from 0 as ``place``."""
    drawn = mix.withColumn("_h", F.xxhash64(F.lit(seed + 1), "doc_id", "copy"))
    return numbered(drawn, ["_h", "doc_id", "copy"], "place").drop("_h")


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents, copies, most repeats, tokens and actual share of each target source."""
    got = mix.groupBy("source").agg(F.count_if(F.col("copy") == 1).alias("documents"), F.count("*").alias("copies"), F.max("copy").alias("most_repeats"), F.sum("tokens").alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("_all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        .join(got, "source", "left").crossJoin(whole)
        .select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("most_repeats"), zero("tokens"), F.try_divide(F.coalesce("tokens", F.lit(0)), F.col("_all")).alias("actual_share"))
    )
