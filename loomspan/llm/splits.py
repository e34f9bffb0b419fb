"""Assign records to splits so that all that belong together stay together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.aggregates import numbered
from loomspan.operators.graph import components
from loomspan.operators.skew import skew_join
from loomspan.session import kept

# Spellings of an identifier that identify nothing, after trimming and lower-casing.
NO_IDENTITY = ["", "unknown", "n/a", "none", "-"]

#: Sizes up to this are classes of their own; larger ones are told apart to one part in so many.
FINE = 128
#: Classes by the share of positive labels.
RATES = 32
#: Turns in which the groups of a class are placed.
TURNS = 32


def identifier(column: str) -> Column:
    """The identifier as it is compared: white space trimmed, case folded; null where it identifies nothing."""
    trimmed = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(~trimmed.isin(NO_IDENTITY), trimmed)


def tied_groups(records: DataFrame, group: str, entities: list[str]) -> DataFrame:
    """Groups (such as stories) with the label of all that are tied to them: ``record, label``; a group tied to none is its own.

    Two groups are tied if any of their records share an identifier of the same column, directly or through others.
    Records without a group are not here.
    """
    named = records.where(F.col(group).isNotNull())
    each = [named.select(F.col(group).alias("record"), F.concat(F.lit(f"{c}:"), identifier(c)).alias("entity")) for c in entities]
    edges = each[0]
    for more in each[1:]:
        edges = edges.unionByName(more)
    edges = edges.where(F.col("entity").isNotNull()).distinct()
    linked = components(edges)
    alone = named.select(F.col(group).alias("record")).distinct().join(linked, "record", "left_anti")
    return linked.unionByName(alone.select("record", F.col("record").alias("label")))


def tied_sizes(groups: DataFrame) -> DataFrame:
    """Every record with its label and the number of records that share it, itself included: ``record, label, n``. One row a record, however large a group is."""
    return skew_join(groups, groups.groupBy("label").agg(F.count("*").alias("n")), ["label"]).select("record", "label", "n")


def tied_pairs(groups: DataFrame, block: int = 1024) -> DataFrame:
    """Pairs ``story_a < story_b`` with the same label.

    The right side of a group is cut into hash blocks of about ``block`` members and the left side repeated for each, so a large group is spread over
    as many tasks as it has blocks. ``tied_sizes`` tells the same groups without pairs.
    """
    sizes = groups.groupBy("label").count().where("count > 1").select("label", F.ceil(F.col("count") / block).cast("int").alias("n"))
    members = groups.join(sizes, "label")
    left = members.select("label", F.col("record").alias("story_a"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    right = members.select("label", F.col("record").alias("story_b"), F.pmod(F.xxhash64("record"), F.col("n")).cast("int").alias("block"))
    return left.join(right, ["label", "block"]).where(F.col("story_a") < F.col("story_b")).select("story_a", "story_b")


def _placed_equal(m: int, a: float, b: float, have: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How many of ``m`` equal groups go to each split if each goes where the squared deviation grows least.

    The growth of each split rises by equal steps with every group, so all that are taken lie below one limit, which follows from their number.
    """
    base = 2 * a * (have[0] - share) + 2 * b * (have[1] - share)
    rise = a * a + b * b
    count, used = np.zeros(len(share)), np.ones(len(share), bool)
    while m > 1:
        limit = (base[used].sum() + rise * (2 * m - used.sum())) / share[used].sum()
        exact = ((limit * share - base) / rise + 1) / 2
        if (exact[used] >= 0).all():
            count[used] = np.floor(exact[used])
            break
        used &= exact >= 0
    for _ in range(int(m - count.sum())):
        count[np.argmin((base + rise * (2 * count + 1)) / share)] += 1
    return count


def placed(classes: list[tuple[int, float, float]], shares: list[float]) -> list[list[int]]:
    """Greedy placing of groups into splits, the largest first, each where the squared deviation grows least: how many of each class go to each split.

    A class is (groups, records of one, positive labels of one). The deviation is that of the records and of the positive labels of each split from
    its share of all, relative to the share. Classes of one size take turns, a part of each at a time, as they would in a random order, so that the labels of one make up for those of another.
    """
    whole = sum(m * a for m, a, _ in classes) or 1.0
    positive = sum(m * b for m, _, b in classes) or 1.0
    share = np.array(shares, float)
    have = np.zeros((2, len(shares)))
    out = np.zeros((len(classes), len(shares)))
    order = sorted(range(len(classes)), key=lambda i: (-classes[i][1], i))
    while order:
        equal = [i for i in order if classes[i][1] >= 0.99 * classes[order[0]][1]]
        order = order[len(equal) :]
        for turn in range(TURNS):
            for i in equal:
                m, a, b = classes[i][0], classes[i][1] / whole, classes[i][2] / positive
                if part := m * (turn + 1) // TURNS - m * turn // TURNS:
                    count = _placed_equal(part, a, b, have, share)
                    out[i] += count
                    have += np.array([[a], [b]]) * count
    return out.astype(int).tolist()


def assign_splits(records: DataFrame, groups: DataFrame, targets: DataFrame, key: str, group: str, label: str, seed: int = 0) -> DataFrame:
    """The split of every record: ``<key>, <group>, split``.

    ``groups`` as ``tied_groups`` gives them; ``targets``: ``split, share``. Whole groups go to one split. ``label`` is a boolean whose distribution
    each split should have. Groups of equal size (to one part in FINE) and equal share of positive labels (to one part in RATES) are a class, and only the
    classes' sums reach the driver, at most some FINE * RATES for each doubling of the size. There the greedy placing of ``placed`` tells how many groups of each class go to each split;
    which ones follows from their place in a global order by class and hash. So all groups, large and small, are placed alike.

    Defined cases: a record without a group is a group of its own; null labels count as false; repeated rows are one record; shares are taken relative
    to their sum; no targets or no records give no rows.
    """
    shares = [(r["split"], float(r["share"])) for r in targets.groupBy("split").agg(F.max("share").alias("share")).where("share > 0").orderBy(F.col("share").desc(), "split").collect()]
    total_share = sum(s for _, s in shares)
    ties = groups.select(F.col("record").alias(group), F.col("label").alias("_tied"))
    rows = records.groupBy(key).agg(F.min(group).alias(group), F.max(F.coalesce(F.col(label), F.lit(False)).cast("int")).alias("_positive"))
    rows = kept(skew_join(rows, ties, [group], "left").withColumn("_unit", F.coalesce(F.concat(F.lit("g"), "_tied"), F.concat(F.lit("r"), F.col(key).cast("string")))))
    size = F.when(F.col("n") <= FINE, F.col("n")).otherwise(FINE + F.floor(F.log2(F.col("n") / FINE) * FINE))
    rate = F.least(F.floor(F.col("p") / F.col("n") * RATES), F.lit(RATES - 1))
    units = rows.groupBy("_unit").agg(F.count("*").alias("n"), F.sum("_positive").alias("p")).withColumn("_class", (size * RATES + rate).cast("long"))
    units = kept(units.withColumn("_draw", F.xxhash64(F.lit(seed), "_unit")))
    classes = units.groupBy("_class").agg(F.count("*").alias("m"), F.sum("n").alias("n"), F.sum("p").alias("p")).orderBy("_class").collect()
    if not shares or not classes:
        return rows.select(key, group, F.lit(None).cast("string").alias("split")).limit(0)
    counts = placed([(r["m"], r["n"] / r["m"], r["p"] / r["m"]) for r in classes], [s / total_share for _, s in shares])
    starts = np.r_[0, np.cumsum([r["m"] for r in classes])]
    bounds = [(r["_class"], (start + np.cumsum(c)).tolist()) for r, start, c in zip(classes, starts[:-1].tolist(), counts, strict=True)]
    where = records.sparkSession.createDataFrame(bounds, "_class long, _ends array<long>")
    names = F.array(*[F.lit(name) for name, _ in shares])
    ranked = numbered(units.select("_unit", "_class", "_draw"), ["_class", "_draw", "_unit"], "_place")
    split = F.element_at(names, F.size(F.filter("_ends", lambda e: e <= F.col("_place"))) + 1)
    split_of = ranked.join(F.broadcast(where), "_class").select("_unit", split.alias("split"))
    return skew_join(rows, split_of, ["_unit"]).select(key, group, "split")


def split_report(assigned: DataFrame, records: DataFrame, targets: DataFrame, key: str, label: str) -> DataFrame:
    """Records, share, target share and share of positive labels of each split."""
    labels = records.groupBy(key).agg(F.max(F.coalesce(F.col(label), F.lit(False)).cast("int")).alias("_positive"))
    counted = assigned.join(labels, key).groupBy("split").agg(F.count("*").alias("n_records"), F.avg("_positive").alias("label_rate"))
    whole = counted.agg(F.sum("n_records").alias("_all"))
    return (
        targets.select("split", F.col("share").alias("target_share")).join(counted, "split", "left").crossJoin(whole)
        .select("split", "target_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), (F.coalesce("n_records", F.lit(0)) / F.col("_all")).alias("share"), "label_rate")
    )
