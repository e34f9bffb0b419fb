"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are treated as hot; the list of them is the only thing that reaches the driver. A key beyond it has
#: less than this part of all rows, which no task minds.
MOST_HOT = 256


def hot_hashes(df: DataFrame, keys: list[str], hot_rows: int) -> dict[int, int]:
    """Hashes of the keys with at least ``hot_rows`` rows, at most MOST_HOT of them, the largest, each with the parts into which it is to be split.

    Counted exactly, with partial aggregation before the shuffle, over 8-byte hashes. Parts grow with the rows, so none has more than ``hot_rows``.
    """
    counted = df.groupBy(F.xxhash64(*keys).alias("h")).count().where(F.col("count") >= hot_rows)
    return {r["h"]: max(2, -(-r["count"] // hot_rows)) for r in counted.orderBy(F.col("count").desc(), "h").limit(MOST_HOT).collect()}


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = 200_000, hot: dict[int, int] | None = None) -> DataFrame:
    """Equi-join whose ``left`` side may be skewed on ``keys`` and whose ``right`` side has few rows a key.

    Rows of hot keys on the left are spread over the key's parts, and only the right rows of those keys are
    repeated that often; all others join as they are. ``how``: inner, left, left_semi or left_anti. Null keys match nothing.
    ``hot`` gives the hot hashes and their parts where they are known from before.
    """
    if hot is None:
        hot = hot_hashes(left, keys, hot_rows)
    if not hot:
        return left.join(right, keys, how)
    named, hashed = [*keys, "_salt"], F.xxhash64(*keys)
    table = F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair])
    parts = F.coalesce(F.try_element_at(table, hashed), F.lit(1)).cast("int")
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(copies, named, how).drop("_salt")
