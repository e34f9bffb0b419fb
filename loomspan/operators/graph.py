"""Closures, paths, cycles and traversals over edges of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import hierarchy
from loomspan.operators.skew import hot_hashes, skew_join
from loomspan.session import checkpointed, kept

#: Least rows of a key that is split in joins.
HOT_ROWS = 200_000


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All pairs of a node and one that it reaches by at least one edge: ``src, dst, steps`` (the fewest).

    Each round joins only the pairs that the last one found with all pairs known, so after k rounds all pairs up to 2^k steps apart are known and none is
    derived again from old ones alone. A pair that is found again by fewer steps counts as found. Loops end by themselves. Null ends are no edges.
    """
    fresh = checkpointed(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(1).alias("steps")).distinct())
    known = fresh
    while True:
        size = known.count()
        few = {} if size < HOT_ROWS else None
        first = fresh.select("src", F.col("dst").alias("via"), "steps")
        after = known.select(F.col("src").alias("via"), "dst", F.col("steps").alias("more"))
        last = fresh.select(F.col("src").alias("via"), "dst", F.col("steps").alias("more"))
        before = known.select("src", F.col("dst").alias("via"), "steps")
        joined = skew_join(first, after, ["via"], hot=few).unionByName(skew_join(before, last, ["via"], hot=few))
        shortest = joined.groupBy("src", "dst").agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
        old = known.withColumnRenamed("steps", "_old")
        found = checkpointed(shortest.join(old, ["src", "dst"], "left").where("_old IS NULL OR steps < _old").select("src", "dst", "steps"))
        if found.isEmpty():
            return known
        known = checkpointed(known.join(found.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(found))
        fresh = found


def on_cycles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes that reach themselves: ``id``.

    Nodes without a way in or without a way out are peeled off, round by round, until none is left; all loops lie in the rest, and only of this the closure is made.
    """
    rest = checkpointed(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct())
    left = rest.count()
    while left:
        has_in, has_out = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
        rest = checkpointed(rest.join(has_in, "src", "left_semi").join(has_out, "dst", "left_semi"))
        before, left = left, rest.count()
        if left == before:
            break
    return closure(rest, "src", "dst").where("src = dst").select(F.col("src").alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """Connected groups of the left side of a bipartite graph: ``record, label``, the label being the least record.

    ``edges``: ``record, entity``, distinct, none null. Labels go from records to entities and back as minima, aggregated
    before the shuffle, and every round also jumps to the label's label, so rounds follow the logarithm of the longest chain. Only labels that
    moved on themselves are looked up for the jump. Entities, records and labels with very many rows are split in the joins; a graph without so many rows
    has none. Each round ends in a checkpoint.
    """
    edges = kept(edges)
    large = edges.count() >= HOT_ROWS
    hot = lambda df, key: hot_hashes(df, [key], HOT_ROWS) if large else {}
    hot_entities, hot_records = hot(edges, "entity"), hot(edges, "record")
    labels = edges.select("record", F.col("record").alias("label")).distinct()
    while True:
        told = skew_join(edges, labels, ["record"], hot=hot_records).groupBy("entity").agg(F.min("label").alias("told"))
        heard = skew_join(edges, told, ["entity"], hot=hot_entities).groupBy("record").agg(F.min("told").alias("heard"))
        step = checkpointed(labels.join(heard, "record").select("record", F.col("label").alias("before"), F.least("label", "heard").alias("label")))
        if step.where("label <> before").isEmpty():
            return step.select("record", "label")
        moved = step.where("label <> record").select(F.col("record").alias("label"), F.col("label").alias("further"))
        asked = step.select("label").distinct().join(moved, "label")
        labels = checkpointed(skew_join(step, asked, ["label"], "left", hot=hot(step, "label")).select("record", F.coalesce("further", "label").alias("label")))


def equivalence_classes(same: DataFrame, different: DataFrame, a: str, b: str) -> DataFrame:
    """Classes under ``same`` links; a class that holds two nodes linked as ``different`` falls apart: ``id, root``.

    Links are the entities of the bipartite graph whose groups ``components`` gives.
    """
    links = same.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    ends = links.select(F.explode(F.array("x", "y")).alias("record"), F.concat_ws("\u0000", "x", "y").alias("entity"))
    labels = components(ends).select(F.col("record").alias("id"), F.col("label").alias("root"))
    d = different.select(F.col(a).alias("x"), F.col(b).alias("y"))
    x, y = labels.select(F.col("id").alias("x"), F.col("root").alias("rx")), labels.select(F.col("id").alias("y"), F.col("root").alias("ry"))
    broken = d.join(x, "x").join(y, "y").where("rx = ry").select(F.col("rx").alias("root")).distinct().withColumn("_broken", F.lit(True))
    return labels.join(broken, "root", "left").select("id", F.when(F.col("_broken"), F.col("id")).otherwise(F.col("root")).alias("root"))


def traverse(start: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Nodes reached from ``start`` (``query, node``) by edges of each step in turn (``src, dst``): distinct ``query, node``."""
    current = start.select("query", "node").distinct()
    for edges in steps:
        current = current.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("query", F.col("dst").alias("node")).distinct()
    return current


def waves(jobs: DataFrame, dependencies: DataFrame, job: str, needs: str) -> DataFrame:
    """Wave in which each job can run, the first after all that it needs: ``job, wave``; null for jobs in or behind a cycle.

    A wave is the longest chain of needs, so it is the depth of a hierarchy, whose groups are worked through whole; rounds follow the borders between groups, not the waves. Needs that are no jobs
    are ignored.
    """
    kind = jobs.schema[job].dataType
    known = jobs.where(F.col(job).isNotNull()).select(F.col(job).cast("string").alias("job")).distinct()
    needed = dependencies.where(F.col(job).isNotNull() & F.col(needs).isNotNull()).select(F.col(job).cast("string").alias("job"), F.col(needs).cast("string").alias("need")).distinct()
    held = needed.groupBy("job").agg(F.collect_list("need").alias("parents"))
    rows = known.join(held, "job", "left").withColumn("scope", F.lit(""))
    depth = hierarchy.longest_depths(hierarchy.links(rows, "job", "parents", "scope"))
    return depth.select(F.col("id").cast(kind).alias("job"), F.col("depth").alias("wave"))
