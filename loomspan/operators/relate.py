"""Joins and window operations beyond one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.skew import skew_join


def unique_matches(queries: DataFrame, rows: DataFrame, selector: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queries whose selector fits exactly one row, joined to it; and the number of skipped ones by reason.

    Rows are counted per selector before the join, so an ambiguous selector never multiplies.
    """
    sized = rows.groupBy(*selector).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in rows.columns if c not in selector])
    met = queries.join(sized, selector, "left")
    reason = F.when(F.col("_n").isNull(), "no_match").when(F.col("_n") > 1, "ambiguous")
    skipped = met.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return met.where("_n = 1").drop("_n"), skipped


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int, contained: bool = False) -> DataFrame:
    """Pairs of half-open intervals of the same key that overlap, or of which the right one holds the left.

    Both sides are spread over the blocks of ``width`` that they touch; a pair is taken in the block where its later begin
    lies, so none comes twice. Equi-join on key and block instead of a product.
    """
    blocks = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    x = left.where(F.col(a[0]) < F.col(a[1])).withColumn("_block", blocks(*a))
    y = right.where(F.col(b[0]) < F.col(b[1])).withColumn("_block", blocks(*b))
    met = x.join(y, [*keys, "_block"]).where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("_block") == F.floor(F.greatest(a[0], b[0]) / width)))
    if contained:
        met = met.where((F.col(b[0]) <= F.col(a[0])) & (F.col(a[1]) <= F.col(b[1])))
    return met.drop("_block")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row per key in an order; Spark keeps one row a key before the shuffle."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """For each left row the last right row of its keys strictly before it: adds ``values``, null where there is none.

    Both sides go through one sort per key, in which the right rows' values are filled forward; no row meets another. Right rows
    at the same time: the greatest values count.
    """
    names = [c for c in left.columns if c not in (*keys, at)]
    l = left.select(*keys, at, F.lit(0).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))  # noqa: E741
    r = right.select(*keys, at, F.lit(1).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = l.unionByName(r).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 0")
    return filled.select(*keys, at, "_row.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def circular_shift(df: DataFrame, key: str, order: str, item: str, row: str, apart: int = 4) -> DataFrame:
    """Pair every item with the one at one offset further round its key: ``key, item, partner, offset``.

    The offset is the one nearest to half the length at which all pairs' rows differ by more than ``apart`` (the lesser of two as near). Keys with
    no such offset give nothing. Items whose rows are too near meet by blocks of rows and forbid the offset between them; no key's items are held
    together, and no offset is tried on items that it does not bring near. An item with a null row is near to none.
    """
    place = Window.partitionBy(key).orderBy(order, row, item)
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    at = df.select(key, item, row, (F.row_number().over(place) - 1).cast("int").alias("_i")).join(sizes, key)
    block = F.floor(F.col(row) / (apart + 1))
    mine = at.select(key, "_n", "_i", F.col(row).alias("_r"), F.explode(F.array(block - 1, block, block + 1)).alias("_b"))
    other = at.select(key, F.col("_i").alias("_j"), F.col(row).alias("_s"), block.alias("_b"))
    near = mine.join(other, [key, "_b"]).where((F.col("_i") != F.col("_j")) & (F.abs(F.col("_r") - F.col("_s")) <= apart))
    forbidden = near.select(key, F.pmod(F.col("_j") - F.col("_i"), F.col("_n").cast("int")).alias("offset")).distinct()
    offsets = sizes.where("_n > 1").select(key, "_n", F.explode(F.sequence(F.lit(1), (F.col("_n") - 1).cast("int"))).alias("offset"))
    chosen = offsets.join(forbidden, [key, "offset"], "left_anti").groupBy(key).agg(F.min_by("offset", F.struct(F.abs(F.col("offset") - F.col("_n") / 2), "offset")).alias("offset"))
    shifted = at.join(chosen, key).select(key, item, "offset", F.pmod(F.col("_i") + F.col("offset"), F.col("_n").cast("int")).alias("_i"))
    return shifted.join(at.select(key, "_i", F.col(item).alias("partner")), [key, "_i"]).select(key, item, "partner", "offset")


def proportional(left: DataFrame, right: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """Join of two ordered lists of different length by proportional rank: rank r of n1 meets rank floor((r + .5) n2 / n1)."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    rank = (F.row_number().over(w) - 1).alias("_r")
    a = left.select(key, item, rank, F.count("*").over(whole).alias("_n"))
    b = right.select(key, F.col(item).alias("partner"), rank.alias("_r2"), F.count("*").over(whole).alias("_m"))
    sizes = b.select(key, "_m").distinct()
    target = F.floor((F.col("_r") + 0.5) * F.col("_m") / F.col("_n")).cast("int")
    return a.join(sizes, key).withColumn("_r2", target).join(b.drop("_m"), [key, "_r2"]).select(key, item, "partner")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank within ``by`` where equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def benjamini_hochberg(df: DataFrame, family: str, p: str) -> DataFrame:
    """Add ``adjusted``: the step-up adjusted p values within each family, at most 1."""
    whole = Window.partitionBy(family)
    ranked = df.withColumn("_r", F.row_number().over(whole.orderBy(p))).withColumn("_m", F.count("*").over(whole))
    upper = whole.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(upper))).drop("_r", "_m")


def contiguous_prefix(df: DataFrame, key: str, index: str, present: str) -> DataFrame:
    """Add ``state``: ``taken`` until the first missing row of a key, then ``missing`` or ``blocked``."""
    w = Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.max((~F.col(present)).cast("int")).over(w) == 1
    return df.withColumn("state", F.when(~gap, "taken").when(~F.col(present), "missing").otherwise("blocked"))


def hash_order(seed: int, *columns: str) -> Column:
    """A reproducible pseudo-random order: the digest of the seed and the columns as compact JSON."""
    return F.sha2(F.to_json(F.array(F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])), 256)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``only_first, only_second``: how many rows either of two frames of the same columns holds beyond the other; nulls are equal to each other.

    Rows are counted on both sides at once, with partial sums before the one shuffle.
    """
    counted = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1))).groupBy(*a.columns).agg(F.sum("_d").alias("_d"))
    part = lambda x: F.coalesce(F.sum(F.greatest(x, F.lit(0))), F.lit(0))
    return counted.agg(part(F.col("_d")).alias("only_first"), part(-F.col("_d")).alias("only_second"))


def broken_links(df: DataFrame, key: str, order: list[str], digest: str, parent: str) -> DataFrame:
    """Rows of a hash chain whose stored ``parent`` is not the ``digest`` of the row before (null for the first): the rows with ``expected``."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("expected", before).where(~F.col(parent).eqNullSafe(F.col("expected")))


def comparator(df: DataFrame, same: list[str], other: DataFrame, value: str) -> DataFrame:
    """Add ``comparator``, the value of the one row of ``other`` with the same keys, null without any; more than one raises."""
    counted = other.groupBy(*same).agg(F.count("*").alias("_n"), F.min(value).alias("comparator"))
    one = counted.withColumn("comparator", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("more than one comparator for "), F.to_json(F.struct(*same)))).cast(other.schema[value].dataType)).otherwise(F.col("comparator")))
    return df.join(one.drop("_n"), same, "left")


def renamed(df: DataFrame, key: str, column: str, field: str, names: DataFrame) -> DataFrame:
    """The array of structs ``column`` with its ``field`` renamed by ``names`` (``old, new``), order kept; names that are not there stay: ``key, column``.

    ``key`` must be unique. Elements meet the names by a join and come back by key, so a list of names may be of any size; null and empty arrays stay as they are.
    """
    each = df.where(F.size(column) > 0).select(key, F.posexplode(column).alias("_i", "_x"))
    met = skew_join(each.withColumn("_old", F.col("_x")[field]), names.select(F.col("old").alias("_old"), F.col("new").alias("_new")), ["_old"], "left")
    changed = met.withColumn("_x", F.col("_x").withField(field, F.coalesce("_new", "_old")))
    back = changed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_made"))
    return df.select(key, column).join(back, key, "left").select(key, F.coalesce("_made", column).alias(column))


def strict_zip(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add ``name``: two arrays place by place as structs of ``a`` and ``b``; arrays of different length raise, two nulls give null."""
    same = F.size(a).eqNullSafe(F.size(b)) & (F.col(a).isNull() == F.col(b).isNull())
    zipped = F.zip_with(F.col(a), F.col(b), lambda x, y: F.struct(x.alias(a), y.alias(b)))
    return df.withColumn(name, F.when(same, zipped).otherwise(F.raise_error(F.lit(f"{a} and {b} differ in length")).cast(df.select(zipped.alias("z")).schema["z"].dataType)))
