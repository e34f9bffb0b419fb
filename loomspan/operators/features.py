"""Sparse features of annotation units: emit rules, keys, marginals, designs and holdouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.aggregates import numbered
from loomspan.operators.annotation import GraphView, resolved
from loomspan.operators.skew import skew_join
from loomspan.session import kept

# Feature groups by what they hold.
GROUPS = {
    "C": "concept of a mentioned entity", "R": "relation type", "B": "role and filler's concept", "PB": "predicate, role and filler's concept", "BC": "constituents of PB", "D": "polarity and tense", "S": "context kind", "U": "uncertain reference",
    "L": "surface and form of a mention", "BR": "role, concept and form of a filler that a mention names", "PBR": "the same with the predicate", "GB": "all roles and concepts of an event", "GBR": "all roles, concepts and forms of an event's named fillers"}


def feature_key(group: Column, parts: Column) -> Column:
    """Key of a feature: digest of its group and parts as compact JSON."""
    return F.sha2(F.to_json(F.struct(group.alias("group"), parts.alias("parts"))), 256)


def emit(view: GraphView) -> DataFrame:
    """One row per incidence: ``unit_id, story_id, unit_index, group, parts, included``.

    Uncertain incidences are there with ``included`` false: they are withheld from counts and mask their group only.
    """
    place = ["unit_id", "story_id", "unit_index"]
    concept = view.entities.where("concept IS NOT NULL").select(F.col("id").alias("target"), "concept").distinct()
    row = lambda df, group, parts, ok=F.lit(True): df.select(*place, F.lit(group).alias("group"), F.array(*[F.coalesce(F.col(p), F.lit("")) for p in parts]).alias("parts"), ok.alias("included"))
    mention = view.mentions.join(concept, "target")
    bound = kept(view.arguments.join(concept, "target").join(view.events.select(F.col("id").alias("event"), "predicate").distinct(), "event"))
    ok = resolved()
    named = bound.withColumnRenamed("support", "_bound").join(view.mentions.select(F.col("id").alias("mention"), "form", F.col("support").alias("_named")).distinct(), "mention")
    sure = resolved("_bound") & resolved("_named")
    whole = lambda df, text: df.groupBy(*place, "event").agg(F.array_join(F.array_sort(F.collect_set(text)), ";").alias("all"))
    part = lambda *columns: F.concat_ws("/", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    surface = view.mentions.withColumn("surface", F.md5(F.coalesce("quote", F.lit(""))))
    triple = row(bound, "PB", ["predicate", "role", "concept"], ok)
    return reduce(
        DataFrame.unionByName,
        [
            row(mention, "C", ["concept"], ok),
            row(view.relations, "R", ["type"], ok),
            row(bound, "B", ["role", "concept"], ok),
            triple,
            marginals(triple),
            row(view.events, "D", ["polarity", "tense"]),
            row(view.contexts, "S", ["kind"], ok),
            row(view.mentions.where("target IS NULL"), "U", ["form"]),
            row(surface, "L", ["surface", "form"]),
            row(named, "BR", ["role", "concept", "form"], sure),
            row(named, "PBR", ["predicate", "role", "concept", "form"], sure),
            row(whole(bound.where(ok), part("role", "concept")), "GB", ["all"]),
            row(whole(named.where(sure), part("role", "concept", "form")), "GBR", ["all"]),
        ],
    )


def marginals(triples: DataFrame) -> DataFrame:
    """The three constituents of every bound triple, with exactly its incidences: group ``BC``."""
    names = ["predicate", "role", "filler"]
    each = F.explode(F.array(*[F.array(F.lit(n), F.col("parts")[i]) for i, n in enumerate(names)])).alias("parts")
    return triples.select("unit_id", "story_id", "unit_index", F.lit("BC").alias("group"), each, "included")


def feature_counts(emitted: DataFrame) -> DataFrame:
    """Counts of the included incidences: ``unit_id, story_id, group, feature, n``."""
    keyed = emitted.where("included").withColumn("feature", feature_key(F.col("group"), F.col("parts")))
    return keyed.groupBy("unit_id", "story_id", "group", "feature").agg(F.count("*").alias("n"))


def uncertain_groups(emitted: DataFrame) -> DataFrame:
    """Groups of a unit that hold a withheld incidence: ``unit_id, group``."""
    return emitted.where("NOT included").select("unit_id", "group").distinct()


def group_masks(units: DataFrame, uncertain: DataFrame, groups: list[str]) -> DataFrame:
    """Whether each unit is usable for each declared group, and for all: ``unit_id, <group>..., usable``."""
    bad = uncertain.where(F.col("group").isin(groups)).groupBy("unit_id").agg(F.collect_set("group").alias("_bad"))
    joined = units.select("unit_id").distinct().join(bad, "unit_id", "left")
    held = F.coalesce("_bad", F.array().cast("array<string>"))
    return joined.select("unit_id", *[(~F.array_contains(held, g)).alias(g) for g in groups], (F.size(held) == 0).alias("usable"))


def fit_vocabulary(counts: DataFrame, train: DataFrame, least: int) -> DataFrame:
    """Columns for features in at least so many training units: ``feature, df, column``; held-out units never add one."""
    seen = counts.join(train.select("story_id").distinct(), "story_id", "left_semi")
    return numbered(seen.groupBy("feature").agg(F.countDistinct("unit_id").alias("df")).where(F.col("df") >= least), ["feature"], "column")


def transform(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse rows of the known columns: ``unit_id, terms`` (map of column to count), empty for units with unknown features only."""
    met = counts.join(vocab.select("feature", "column"), "feature", "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("column", "n"))))
    return met.groupBy("unit_id").agg(F.map_from_entries(pairs).alias("terms"))


def reference_index(view: GraphView) -> DataFrame:
    """Mentions of every entity in order: ``target, place, unit_index, start, id, form``, one row a mention, ``place`` from 0.

    The place comes from a global order by target and position, less the target's first, so a target that holds a third of all mentions is no group of one task.
    """
    m = view.mentions.where("target IS NOT NULL").select("target", "unit_index", F.coalesce("start_token", F.lit(-1)).alias("start"), "id", "form").distinct()
    ranked = kept(numbered(m, ["target", "unit_index", "start", "id", "form"], "_k"))
    first = ranked.groupBy("target").agg(F.min("_k").alias("_first"))
    return skew_join(ranked, first, ["target"]).select("target", (F.col("_k") - F.col("_first")).alias("place"), "unit_index", "start", "id", "form")


def design(counts: DataFrame, vocab: DataFrame, slots: DataFrame, key: str, delays: list[int], measured: DataFrame) -> DataFrame:
    """Sparse design rows: ``key, row, delay, column, value``, from counts of units to delayed measured rows in one path.

    ``slots``: ``unit_id, key, slot``, the row from which a unit is known; units without one take no part. ``measured``: ``key, row``, distinct. Counts of units in the same slot add up, and
    only what a column of the vocabulary holds is carried on, so nothing is ever dense.
    """
    if not delays or len(set(delays)) != len(delays) or min(delays) < 0:
        raise ValueError("delays must be different and not negative")
    known = counts.join(vocab.select("feature", "column"), "feature").join(slots.where("slot >= 0").select("unit_id", key, "slot").distinct(), "unit_id")
    binned = known.groupBy(key, "slot", "column").agg(F.sum("n").alias("value"))
    moved = binned.select(key, "slot", "column", "value", F.explode(F.array(*map(F.lit, delays))).alias("delay")).withColumn("row", F.col("slot") + F.col("delay"))
    return moved.join(measured, [key, "row"], "left_semi").select(key, "row", "delay", "column", "value")


def selected_for_review(reasons: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows that several selections name, each once with its sorted reasons."""
    tagged = [df.select(key, F.lit(name).alias("reason")) for name, df in reasons.items()]
    return reduce(DataFrame.unionAll, tagged).groupBy(key).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def attach_queries(occurrences: DataFrame, queries: DataFrame, parts: list[str]) -> DataFrame:
    """Occurrences with the sorted ids of the queries of the same digest over ``parts``: adds ``query_ids``, empty without any."""
    digest = F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
    asked = queries.groupBy(digest.alias("_h")).agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"))
    return occurrences.withColumn("_h", digest).join(asked, "_h", "left").withColumn("query_ids", F.coalesce("query_ids", F.array().cast("array<string>"))).drop("_h")
