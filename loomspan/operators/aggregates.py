"""Aggregations: catalogs, vocabularies, hierarchical means, weights, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.session import kept


def count_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Counts by value as one map per key, in the order of the values."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def vocabulary(df: DataFrame, feature: str, unit: str, least: int) -> DataFrame:
    """Features in at least so many units, numbered by name: ``feature, df, column``.

    The number comes from counts per range of the sorted features, so no task sees all of them.
    """
    frequent = df.groupBy(feature).agg(F.countDistinct(unit).alias("df")).where(F.col("df") >= least)
    return numbered(frequent, [feature], "column")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order without a single-task window.

    A range sort gives partitions in order; the number is the place in the partition plus the rows of those before. The
    partitions' sizes, one row each, are all that is broadcast.
    """
    ordered = df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ordered = kept(ordered)
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = sizes.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") - F.col("_first") + F.col("_before") + F.lit(start)).drop("_p", "_i", "_first", "_before")


def out_of_vocabulary(tokens: DataFrame, vocab: DataFrame, feature: str, by: str) -> DataFrame:
    """Observed and unseen tokens and distinct unseen features: ``by, observed, unseen, unseen_features``."""
    known = vocab.select(feature, F.lit(True).alias("_known"))
    counted = tokens.groupBy(by, feature).agg(F.count("*").alias("_n")).join(known, feature, "left")
    miss = F.col("_known").isNull()
    return counted.groupBy(by).agg(F.sum("_n").alias("observed"), F.coalesce(F.sum(F.when(miss, F.col("_n"))), F.lit(0)).alias("unseen"), F.count_if(miss).alias("unseen_features"))


def family_weights(df: DataFrame, source: str, family: str) -> DataFrame:
    """Add ``weight``: every source counts 1, shared evenly by its families and within each by its rows."""
    per = df.groupBy(source, family).agg(F.count("*").alias("_in"))
    families = per.groupBy(source).agg(F.count("*").alias("_families"))
    return df.join(per, [source, family]).join(families, source).withColumn("weight", 1 / (F.col("_families") * F.col("_in"))).drop("_in", "_families")


def macro_mean(df: DataFrame, value: str, item: str, source: str, story: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """Mean over stories of the mean over sources of the weighted mean over items of the mean over repeats.

    Result: ``by..., stories, sources, value``. Rows with a null value take no part; a source of total weight 0 gives null and is left out.
    """
    by = by or []
    items = df.where(F.col(value).isNotNull()).groupBy(*by, story, source, item).agg(F.avg(value).alias("_v"), F.first(weight).alias("_w"))
    sources = items.groupBy(*by, story, source).agg(F.try_divide(F.sum(F.col("_v") * F.col("_w")), F.sum("_w")).alias("_v")).where("_v IS NOT NULL")
    stories = sources.groupBy(*by, story).agg(F.avg("_v").alias("_v"), F.count("*").alias("_n"))
    return stories.groupBy(*by).agg(F.count("*").alias("stories"), F.sum("_n").alias("sources"), F.avg("_v").alias("value"))


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column | str], collect: str) -> DataFrame:
    """First row per key in an order, with ``<collect>_all``: the sorted distinct values that the key has."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    one = df.withColumn("_k", first).where("_k = 1").drop("_k")
    seen = df.groupBy(*keys).agg(F.array_sort(F.collect_set(collect)).alias(f"{collect}_all"))
    return one.join(seen, keys)


def story_means(df: DataFrame, item: str, story: str, vector: str, least: int) -> DataFrame:
    """Mean vector of each item over its stories, every story counting once: ``item, stories, signature``; items with few stories are left out.

    Vectors are averaged by coordinate, so partial sums leave the map side, never the vectors.
    """
    cells = df.select(item, story, F.posexplode(vector).alias("_i", "_x")).groupBy(item, story, "_i").agg(F.avg("_x").alias("_x"))
    means = cells.groupBy(item, "_i").agg(F.avg("_x").alias("_x"), F.count("*").alias("stories")).where(F.col("stories") >= least)
    return means.groupBy(item).agg(F.first("stories").alias("stories"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("signature"))


def profile(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, population deviation, extremes and the number of NaN, infinite and zero values; the moments over finite ones."""
    x = F.col(value)
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.when(~odd, x)
    return df.groupBy(by).agg(
        F.count(x).alias("n"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("sd"), F.min(fine).alias("least"), F.max(fine).alias("most"),
        F.count_if(F.isnan(x)).alias("nan"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), F.count_if(x == 0).alias("zero"),
    )


def overlap_scores(a: DataFrame, b: DataFrame, by: str, atom: str) -> DataFrame:
    """Sizes of two sets per group, of what they share, and F1; null where both are empty."""
    both = a.select(by, atom).distinct().withColumn("_a", F.lit(1)).join(b.select(by, atom).distinct().withColumn("_b", F.lit(1)), [by, atom], "full")
    n = both.groupBy(by).agg(F.count("_a").alias("n_first"), F.count("_b").alias("n_second"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("shared"))
    return n.withColumn("f1", F.try_divide(2 * F.col("shared"), F.col("n_first") + F.col("n_second")))
