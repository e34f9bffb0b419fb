"""The scan clock: event bins, known rows, delayed designs and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_bin(seconds: Column, tr: float, leading: int, position: float) -> Column:
    """First scan row at or after a time: ceil(seconds / tr + leading - position); null for null."""
    return F.ceil(seconds / F.lit(tr) + F.lit(leading) - F.lit(position)).cast("int")


def bin_centre(row: Column, tr: float, leading: int) -> Column:
    """Time in the story at the middle of a scan row."""
    return ((row + F.lit(0.5)) - F.lit(leading)) * F.lit(tr)


def fill_anchors(df: DataFrame, key: str, order: str, onset: str, offset: str) -> DataFrame:
    """Add ``previous_anchor``, the last known offset before a row, and ``following_anchor``, the first known onset after it."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("previous_anchor", F.last(offset, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("following_anchor", F.first(onset, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def causal_bins(df: DataFrame, keys: list[str], slot: str, value: str, rows: DataFrame, reduction: str = "mean") -> DataFrame:
    """Sum or mean of the events of every scan row: ``keys, t, x, n``; rows without events have 0 and 0.

    ``rows``: ``keys, t``, all scan rows. Events without a slot (null or negative) are absent, not zero.
    """
    total = df.where(F.col(slot) >= 0).groupBy(*keys, F.col(slot).alias("t")).agg(F.sum(value).alias("_s"), F.count(value).alias("n"))
    x = F.coalesce(F.col("_s"), F.lit(0.0)) if reduction == "sum" else F.coalesce(F.try_divide(F.col("_s"), F.col("n")), F.lit(0.0))
    return rows.join(total, [*keys, "t"], "left").select(*keys, "t", x.alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def known_rows(events: DataFrame, rows: DataFrame, key: str, slot: str, left: str, right: str, width: int = 64) -> DataFrame:
    """Which scan rows have no event whose time is unknown: ``key, t, known``.

    An event without a slot may fall on any row from its ``left`` to its ``right`` bound (null: the whole side), and masks
    them. Masks are spread over blocks of ``width`` rows, so one join on the block finds them.
    """
    span = rows.groupBy(key).agg(F.max("t").alias("_last"))
    open_ = events.where(F.col(slot).isNull()).join(span, key).select(key, F.greatest(F.lit(0), F.coalesce(left, F.lit(0))).alias("_a"), F.least(F.col("_last"), F.coalesce(F.col(right), F.col("_last"))).alias("_b")).where("_a <= _b").distinct()
    blocks = open_.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_b") / width))))
    hit = rows.withColumn("_block", F.floor(F.col("t") / width)).join(blocks, [key, "_block"]).where("t BETWEEN _a AND _b").select(key, "t").distinct()
    return rows.join(hit.withColumn("_hit", F.lit(True)), [key, "t"], "left").select(*rows.columns, F.col("_hit").isNull().alias("known"))


def fir(df: DataFrame, key: str, t: str, values: list[str], delays: list[int], known: str | None = None) -> DataFrame:
    """Delayed copies of columns within a key: ``<value>_d<delay>``, 0 before the start, and ``valid``.

    A row is valid if every delayed row is there and known. Needs one row per ``t`` without gaps.
    """
    if not delays or len(set(delays)) != len(delays) or min(delays) < 0:
        raise ValueError("delays must be different and not negative")
    w = Window.partitionBy(key).orderBy(t)
    made = [F.coalesce(F.lag(v, d).over(w) if d else F.col(v), F.lit(0.0)).alias(f"{v}_d{d}") for d in delays for v in values]
    ok = F.lit(True)
    for d in delays:
        mask = F.col(known) if known else F.lit(True)
        ok = ok & F.coalesce(F.lag(mask, d).over(w) if d else mask, F.lit(False))
    return df.select(key, t, *made, ok.alias("valid"))


def measured_rows(events: DataFrame, identity: str, key: str, slot: str, delays: list[int], measured: DataFrame, row: str) -> DataFrame:
    """Delayed rows of every event that were measured: ``identity, slot, rows``, in the order of the delays; none for an unknown (negative) slot.

    ``measured``: ``key, row``, distinct. Every delayed row meets the measured ones by key and row, so no key's rows are held together. Keys without any measured row are left out.
    """
    known = events.join(measured.select(key).distinct(), key, "left_semi")
    each = known.select(identity, key, slot, F.posexplode(F.array(*map(F.lit, delays))).alias("_k", "_d")).withColumn("_r", F.when(F.col(slot) >= 0, F.col(slot) + F.col("_d")))
    met = each.join(measured.select(key, F.col(row).alias("_r"), F.lit(True).alias("_there")), [key, "_r"], "left")
    found = F.array_sort(F.collect_list(F.when(F.col("_there"), F.struct("_k", "_r"))))
    return met.groupBy(identity, key, slot).agg(F.transform(found, lambda s: s["_r"]).alias("rows"))


def delayed_means(events: DataFrame, identity: str, key: str, slot: str, delays: list[int], values: DataFrame, value: str) -> DataFrame:
    """Mean of the values at all delayed rows of every event: ``identity, value``; events of an unknown slot or with a row that is not there are left out.

    ``values``: ``key, row, value``, one row each.
    """
    each = events.where(F.col(slot) >= 0).select(identity, key, F.explode(F.array(*map(F.lit, delays))).alias("_d"), slot).withColumn("row", F.col(slot) + F.col("_d"))
    met = each.join(values.select(key, "row", value), [key, "row"])
    return met.groupBy(identity, slot).agg(F.avg(value).alias(value), F.count("*").alias("_n")).where(F.col("_n") == len(delays)).select(identity, value)


def coverage(windows: DataFrame, key: str, category: str, rows: str, retained: DataFrame, row: str) -> DataFrame:
    """Per category the windows that a mask keeps whole, in part or not: ``category, n, whole, part, gone``.

    ``rows`` is an array of different row numbers; ``retained`` (``key, row``, distinct) what the mask keeps. Rows meet by key and number. An empty window is kept whole.
    """
    each = windows.withColumn("_w", F.monotonically_increasing_id()).select("_w", key, category, F.explode_outer(rows).alias("_r"))
    met = each.join(retained.select(key, F.col(row).alias("_r"), F.lit(1).alias("_there")), [key, "_r"], "left")
    per = met.groupBy("_w", category).agg(F.count("_r").alias("_n"), F.count("_there").alias("_h"))
    whole, part = F.col("_n") == F.col("_h"), F.col("_h") > 0
    return per.groupBy(category).agg(F.count("*").alias("n"), F.count_if(whole).alias("whole"), F.count_if(part & ~whole).alias("part"), F.count_if(~part & ~whole).alias("gone"))


def exclusions(df: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """Rows that each check in turn excludes beyond those before, and what is retained: ``key, rows, excluded_<check>..., retained``."""
    made, ok = [F.count("*").alias("rows")], F.lit(True)
    for check in checks:
        made.append(F.count_if(ok & ~F.col(check)).alias(f"excluded_{check}"))
        ok = ok & F.col(check)
    return df.groupBy(key).agg(*made, F.count_if(ok).alias("retained"))
