"""Rebuild the present state of keyed records from a feed of inserts, updates and deletes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspan.functions.jsons import parsed, written

_LEAF = T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])


def json_leaves(text: str | None, drop: str = "id") -> list[tuple[str, str | None]]:
    """Leaf fields of a JSON object as (dotted path, text) pairs, without the top-level field ``drop``.

    Strings stand for themselves, other leaves as compact JSON and null as None. Arrays are leaves; an empty
    object has no leaf. A text that is not one complete JSON object has no leaves. Reads and walks with a stack, so
    depth is not bounded by the interpreter.
    """
    if not text:
        return []
    try:
        root = parsed(text)
    except ValueError:
        return []
    if not isinstance(root, dict):
        return []
    found: list[tuple[str, str | None]] = []
    stack = [("", {k: v for k, v in root.items() if k != drop})]
    while stack:
        prefix, node = stack.pop()
        for key, value in node.items():
            path = f"{prefix}{key}"
            if isinstance(value, dict):
                stack.append((path + ".", value))
            elif value is None or isinstance(value, str):
                found.append((path, value))
            else:
                found.append((path, written(value)))
    return found


def explode_leaves(df: DataFrame, column: str, drop: str = "id") -> DataFrame:
    """Replace the JSON text ``column`` by one row per leaf, with columns ``field`` and ``value``.

    Arrow in, Arrow out: the other columns are gathered by index once a batch.
    """
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType(kept + _LEAF.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, field, value = [], [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index(column)).to_pylist()):
                for name, leaf in json_leaves(text, drop):
                    index.append(i)
                    field.append(name)
                    value.append(leaf)
            taken = batch.select([f.name for f in kept]).take(pa.array(index, pa.int64()))
            columns = [*taken.columns, pa.array(field, pa.string()), pa.array(value, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*taken.schema.names, "field", "value"])

    return df.mapInArrow(run, schema)


def _steps(decisions: DataFrame) -> DataFrame:
    """Operations of all decisions one by one, with ``at``, their place in the log: revision, decision, place in its array."""
    steps = (
        decisions.select(
            "unit_id",
            F.col("revision").cast("int").alias("revision"),
            F.col("decision_id").cast("long").alias("decision_id"),
            F.posexplode("operations").alias("pos", "change"),
        )
        .select(
            "unit_id", "revision", "decision_id", "pos",
            F.col("change.id").alias("record_id"),
            F.col("change.op").alias("op"),
            F.col("change.field").alias("field"),
            F.col("change.value").alias("value"),
            F.col("change.before").alias("before"),
        )
        .where(F.col("record_id").isNotNull() & F.col("op").isin("add", "set", "remove"))
    )
    order = F.struct(F.coalesce("revision", F.lit(-(2**31))).alias("r"), F.coalesce("decision_id", F.lit(-(2**63))).alias("d"), "pos")
    return steps.withColumn("at", order)


def apply_changes(decisions: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """State after the last change, one row per field of each record that is left.

    ``decisions`` has ``decision_id, unit_id, revision, operations``; other columns are ignored, whatever their
    names. ``base``, an earlier result, is what the feed is merged into: its records are there before the first change; without it the state starts empty.
    Result: ``unit_id, record_id, field, value, revision`` with the revision that gave the present value.

    Only the last ``add`` or ``remove`` of a record decides whether it is there and from where its fields
    count, so no replay is needed: the newest life-cycle operation per record is found by a window rank, then the
    newest value per field among the operations from there on. Both ranks keep one row per key, which Spark
    cuts down before the shuffle (WindowGroupLimit), so a hot unit or record sends one row per input partition.

    Defined cases: repeated deliveries of a decision (same ``decision_id``) count once; null ``operations``, null
    elements and null or unknown ``op`` or ``id`` do nothing; ``set`` with a null field does nothing; ``add`` whose value is not
    a JSON object begins a record without fields, which gives no row; a null revision sorts before all others;
    equal revisions of one unit go by ``decision_id``. An empty feed gives the base, without one an empty state; base rows with a null record or field are ignored,
    repeated ones count once; a record without any field leaves no row, so a base does not hold it.
    """
    steps = _steps(decisions)
    record = ["unit_id", "record_id"]

    # A repeated decision gives equal places in the log, of which the rank keeps one: dedupe and latest-per-key in one pass.
    changes = steps.where(F.col("op") != "set").select(*record, "op", "at", "revision", "value")
    columns = [*record, "field", "value", "at", "revision"]
    if base is not None:
        before = F.struct(F.lit(-(2**31)).alias("r"), F.lit(-(2**63)).alias("d"), F.lit(-1).alias("pos"))
        held = base.where(F.col("record_id").isNotNull() & F.col("field").isNotNull()).select(*record, "field", "value", before.alias("at"), F.col("revision").cast("int").alias("revision"))
        changes = changes.unionByName(held.select(*record, F.lit("add").alias("op"), "at", F.lit(None).cast("int").alias("revision"), F.lit(None).cast("string").alias("value")))
    lives = _latest(changes, record)
    born = lives.where(F.col("op") == "add")
    first = explode_leaves(born.select(*record, "at", "revision", "value"), "value")
    born_at = born.select(F.col("unit_id").alias("u"), F.col("record_id").alias("k"), F.col("at").alias("born"))
    sets = _latest(steps.where((F.col("op") == "set") & F.col("field").isNotNull()).select(*record, "field", "value", "at", "revision"), [*record, "field"])
    later = (
        sets.join(born_at, F.col("unit_id").eqNullSafe(F.col("u")) & (F.col("record_id") == F.col("k")))
        .where(F.col("at") > F.col("born"))
        .drop("u", "k", "born")
    )
    parts = first.select(columns).unionByName(later.select(columns))
    if base is not None:
        still = born_at.where(F.col("born.pos") < 0).select("u", "k")
        parts = parts.unionByName(held.join(still, F.col("unit_id").eqNullSafe(F.col("u")) & (F.col("record_id") == F.col("k")), "left_semi").select(columns))
    state = _latest(parts, [*record, "field"])
    return state.select(*record, "field", "value", "revision")


def _latest(df: DataFrame, keys: list[str], at: str | Column = "at") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def checked_changes(decisions: DataFrame) -> DataFrame:
    """Whether what a ``set`` states to have been there before was there: ``unit_id, record_id, field, revision, decision_id, pos, verdict``.

    ``no_record`` if the record was not there, ``unstated`` without a ``before``, else ``holds`` or ``differs``. Values come from the fields of every ``add`` and
    from earlier ``set`` that took effect; a record that begins anew has none of before. Each operation meets only those of its record and field, in one sorted pass each. Repeated
    deliveries count once; ``decisions`` as ``apply_changes`` takes them.
    """
    record = ["unit_id", "record_id"]
    steps = _steps(decisions).dropDuplicates([*record, "at"])
    earlier = Window.partitionBy(*record).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    life = F.last(F.when(F.col("op") != "set", F.struct("op", "at")), ignorenulls=True).over(earlier)
    lived = steps.withColumn("_life", life)
    sets = lived.where((F.col("op") == "set") & F.col("field").isNotNull())
    there = F.coalesce(F.col("_life.op") == "add", F.lit(False))
    leaves = explode_leaves(steps.where(F.col("op") == "add").select(*record, "at", "value"), "value")
    columns = [*record, "field", "at", "value", "before", "born", "revision", "decision_id", "pos"]
    took = sets.where(there).withColumn("born", F.col("_life.at")).select(columns)
    for name in ("before", "born", "revision", "decision_id", "pos"):
        leaves = leaves.withColumn(name, F.lit(None).cast(took.schema[name].dataType))
    order = Window.partitionBy(*record, "field").orderBy("at")
    placed = leaves.select(columns).unionByName(took).withColumn("_last", F.lag(F.struct("at", "value")).over(order)).where(F.col("born").isNotNull())
    prior = F.when(F.col("_last.at") >= F.col("born"), F.col("_last.value"))
    verdict = F.when(F.col("before").isNull(), "unstated").when(F.col("before").eqNullSafe(prior), "holds").otherwise("differs")
    out = [*record, "field", "revision", "decision_id", "pos"]
    return placed.select(*out, verdict.alias("verdict")).unionByName(sets.where(~there).select(*out, F.lit("no_record").alias("verdict")))
