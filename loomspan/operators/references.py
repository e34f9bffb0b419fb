"""Find references to records that do not exist, are not there yet or were taken back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.nested import node_table
from loomspan.operators.skew import skew_join
from loomspan.session import kept

#: Bits of the Bloom filter per parent key, by an approximate count of the keys; with four hash functions about one absent key in eighty passes.
BLOOM_BITS_PER_KEY = 10
#: Most bits, the bound of what is broadcast (2**29 are 64 MiB, for 53 million keys at that rate). More keys raise the share of absent keys that pass, which the
#: exact join then sorts out; results never depend on it.
BLOOM_MOST_BITS = 1 << 29
BLOOM_HASHES = 4


def _position(key: Column, i: int, bits: int) -> Column:
    """Bit of the i-th hash function, by double hashing of one 64-bit hash."""
    low, high = key.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(key, 32).bitwiseOR(F.lit(1))
    return (low + high * F.lit(i)).bitwiseAND(F.lit(bits - 1))


class Bloom:
    """A Bloom filter over 64-bit key hashes, built with partial aggregation and kept as 64-bit words."""

    def __init__(self, words: np.ndarray, bits: int, hashes: int) -> None:
        self.words, self.bits, self.hashes = words, bits, hashes

    @classmethod
    def build(cls, keys: DataFrame, hashed: str, bits: int | None = None, hashes: int = BLOOM_HASHES) -> Bloom:
        """``bits`` must be a power of two; without them the filter is sized by the keys, up to BLOOM_MOST_BITS. At most ``bits / 64`` words reach the driver."""
        if bits is None:
            count = keys.agg(F.approx_count_distinct(hashed, 0.05)).first()[0]
            bits = min(max(1 << (BLOOM_BITS_PER_KEY * count - 1).bit_length(), 1 << 12), BLOOM_MOST_BITS) if count else 1 << 12
        at = F.explode(F.array(*[_position(F.col(hashed), i, bits) for i in range(hashes)]))
        words = (
            keys.select(at.alias("at"))
            .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
            .toArrow()
        )
        out = np.zeros(bits // 64, np.int64)
        out[words["word"].to_numpy()] = words["set"].to_numpy()
        return cls(out, bits, hashes)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that were certainly never added."""
        keys = keys.view(np.uint64)
        low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
        words, out = self.words.view(np.uint64), np.ones(len(keys), bool)
        for i in range(self.hashes):
            at = (low + high * np.uint64(i)) & np.uint64(self.bits - 1)
            out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out

    def column(self, hashed: Column) -> Column:
        """The test as a column over a hash column; the words go to each executor once, as a broadcast variable."""
        from pyspark.sql import SparkSession

        sent = SparkSession.getActiveSession().sparkContext.broadcast((self.words, self.bits, self.hashes))

        @F.pandas_udf("boolean")
        def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bloom = Bloom(*sent.value)
            for keys in batches:
                yield pd.Series(bloom.holds(keys.to_numpy(np.int64)))

        return maybe(hashed)


def orphans(references: DataFrame, parents: DataFrame, withdrawn: DataFrame, bits: int | None = None) -> DataFrame:
    """References whose target is not there when the referring row is recorded.

    ``references``: ``ref_table, record_id, pos, scope, target, at``; null and blank targets are no references.
    ``parents``: ``scope, id, at``, a record with the time from which it is there; ``withdrawn``: ``scope, id, at``.
    Result, distinct: ``ref_table, record_id, pos, reason, period``; reason ``missing``, ``later`` or ``removed``, the first
    that fits in this order; period the month of ``at`` (null if that is).

    A Bloom filter of the parents proves most ``missing`` ones without a shuffle; only what it lets through takes part in the
    exact join, in which hot targets are split. It is sized by the number of keys, up to a bound; beyond, false positives grow, not memory.

    Defined cases: a null scope holds no records, so its references are missing; a parent without time is there always; a
    reference without time can only be missing; repeated rows count once; other columns are ignored, whatever their names; empty inputs give what follows from that.
    """
    references = references.select("ref_table", "record_id", "pos", "scope", "target", "at").where(F.coalesce(F.regexp_like("target", F.lit(r"\S")), F.lit(False)))
    references = references.withColumn("period", F.date_format("at", "yyyy-MM")).withColumn("_h", F.xxhash64("scope", "target"))
    parents = parents.select("scope", "id", "at").where(F.col("scope").isNotNull() & F.col("id").isNotNull())
    bloom = Bloom.build(parents.select(F.xxhash64("scope", F.col("id")).alias("h")), "h", bits)
    tested = kept(references.withColumn("_maybe", bloom.column(F.col("_h")) & F.col("scope").isNotNull()).drop("_h"))
    columns = ["ref_table", "record_id", "pos", "reason", "period"]
    definite = tested.where(~F.col("_maybe")).withColumn("reason", F.lit("missing")).select(columns)

    known = parents.groupBy("scope", F.col("id").alias("target")).agg(F.min("at").alias("since"), F.max(F.col("at").isNull()).alias("always"))
    gone = withdrawn.groupBy("scope", F.col("id").alias("target")).agg(F.min("at").alias("gone"))
    exact = skew_join(tested.where("_maybe").drop("_maybe"), known.join(gone, ["scope", "target"], "left"), ["scope", "target"], "left")
    reason = (
        F.when(F.col("always").isNull(), "missing")
        .when(~F.col("always") & (F.col("since") > F.col("at")), "later")
        .when(F.col("gone") <= F.col("at"), "removed")
    )
    verified = exact.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(columns)
    return definite.unionByName(verified).distinct()


def story_references(draft: DataFrame, mention: DataFrame, relation: DataFrame, identity_link: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and parents of the annotation tables, in the form that ``orphans`` takes; drafts are parsed once."""
    nodes = kept(
        node_table(draft, "graph", ["story_id", "recorded_utc"], kinds=["entity", "event", "literal", "argument"]).select(
            "story_id", "recorded_utc", "kind", "id", "target", "owner_id", "place"
        )
    )

    def plain(df: DataFrame, name: str, target: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.col("id").alias("record_id"), F.lit(0).alias("pos"), F.col("story_id").alias("scope"), F.col(target).alias("target"), F.col("recorded_utc").alias("at"))

    arguments = nodes.where("kind = 'argument'").select(
        F.lit("argument").alias("ref_table"), F.col("owner_id").alias("record_id"), F.col("place").alias("pos"), F.col("story_id").alias("scope"), "target", F.col("recorded_utc").alias("at")
    )
    references = plain(mention, "mention", "target").unionByName(plain(relation, "relation", "source")).unionByName(plain(identity_link, "identity_link", "right")).unionByName(arguments)
    parents = nodes.where("kind <> 'argument'").select(F.col("story_id").alias("scope"), "id", F.col("recorded_utc").alias("at"))
    return references, parents


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per referring table, month and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_references"), F.countDistinct("record_id").alias("n_records"))
