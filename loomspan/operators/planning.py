"""Driver-side planning over small lists: job waves under limits, covers, readouts; and pointer chains as frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import checkpointed


@dataclass(frozen=True)
class Worker:
    """A unit of work to place: its lane, size and what it needs."""

    id: str
    lane: str
    resource: str
    size: int = 1
    needs: tuple[str, ...] = ()


def choose_wave(workers: list[Worker], done: set[str], caps: dict[str, int], weights: dict[str, float], used: dict[str, float] | None = None) -> list[str]:
    """Workers that can start now: lanes in the order of least use per weight, within the caps of each resource; ids break ties."""
    left, served, chosen = dict(caps), dict(used or {}), []
    ready = sorted((w for w in workers if w.id not in done and set(w.needs) <= done), key=lambda w: w.id)
    while ready:
        fits = [w for w in ready if w.size <= left.get(w.resource, 0)]
        if not fits:
            break
        best = min(fits, key=lambda w: (served.get(w.lane, 0.0) / weights.get(w.lane, 1.0), w.id))
        chosen.append(best.id)
        left[best.resource] -= best.size
        served[best.lane] = served.get(best.lane, 0.0) + best.size
        ready.remove(best)
    return chosen


def greedy_cover(sets: dict[str, set[str]]) -> list[str]:
    """Sets that together hold everything, each time the one with most that is still open; names break ties."""
    open_, chosen = set().union(*sets.values()) if sets else set(), []
    while open_:
        best = max(sorted(sets), key=lambda k: len(sets[k] & open_))
        chosen.append(best)
        open_ -= sets[best]
    return chosen


def follow(pointers: DataFrame, src: str, dst: str) -> DataFrame:
    """Last node of every chain of pointers: ``id, end``; nodes whose chain runs in a circle have a null end.

    Each node has at most one pointer (the least counts). Jumps double, so rounds follow the logarithm of the longest chain.
    """
    known = pointers.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("id")).agg(F.min(dst).alias("end"))
    current, before = checkpointed(known), -1
    while True:
        further = current.select(F.col("id").alias("end"), F.col("end").alias("_next"))
        moved = checkpointed(current.join(further, "end", "left").select("id", F.coalesce("_next", "end").alias("end"), F.col("_next").isNotNull().alias("_moved")))
        moving = moved.where("_moved").count()
        current = moved.select("id", "end")
        if moving in (0, before):
            return moved.select("id", F.when(~F.col("_moved"), F.col("end")).alias("end"))
        before = moving


def linear_readout(train: DataFrame, test: DataFrame, vector: str, label: str, regularisation: float = 0.1) -> DataFrame:
    """Multinomial logistic readout of a label: test rows with ``logits`` by label index, ``label_index`` and ``predicted``; labels unseen in training have a null index."""
    index = StringIndexer(inputCol="_label", outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc").fit(train.select(F.col(label).cast("string").alias("_label")))
    prepare = lambda df: index.transform(df.withColumn("_label", F.col(label).cast("string"))).withColumn("_x", array_to_vector(F.col(vector)))
    model = LogisticRegression(featuresCol="_x", labelCol="label_index", rawPredictionCol="_raw", predictionCol="predicted", probabilityCol="_p", regParam=regularisation).fit(prepare(train))
    known = len(index.labels)
    out = model.transform(prepare(test)).withColumn("logits", vector_to_array("_raw")).withColumn("label_index", F.when(F.col("label_index") < known, F.col("label_index")))
    return out.drop("_label", "_x", "_raw", "_p")


def stable_prefix(shorter: str, longer: str):
    """Whether the ids of a longer text begin with those of its prefix."""
    return F.slice(longer, F.lit(1), F.size(shorter)) == F.col(shorter)


def reused(wanted: DataFrame, existing: DataFrame, inputs: list[str]) -> DataFrame:
    """Wanted fits with the existing one of equal inputs, by digest: adds ``reused``, null where there is none; of several the least id."""
    digest = F.sha2(F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"}), 256)
    have = existing.groupBy(digest.alias("_h")).agg(F.min("id").alias("reused"))
    return wanted.withColumn("_h", digest).join(have, "_h", "left").drop("_h")
