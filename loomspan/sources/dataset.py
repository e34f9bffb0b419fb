"""A data directory opened once: tables by kind, per story, with checks that they belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import table
from loomspan.sources import sinks

#: Tables of annotation records by kind.
KINDS = ("draft", "mention", "relation", "identity_link", "context", "decision", "source_record", "alignment", "withdrawn_record")


class Dataset:
    """Tables of one directory. Frames are immutable and lazy, so nothing is copied and a story's records prune the scan."""

    def __init__(self, spark: SparkSession, path: str, identity: dict[str, str] | None = None) -> None:
        """``identity`` names tables with the digest that their content must have; another content raises."""
        self.spark, self.path = spark, path
        for name, digest in (identity or {}).items():
            sinks.checked(self.table(name), digest)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def records(self, kind: str, story: str | None = None) -> DataFrame:
        """Distinct records of a kind, of all stories or of one; unknown kinds raise."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        rows = self.table(kind)
        rows = rows if story is None else rows.where(F.col("story_id") == story)
        first = "ingested_utc"
        keys = [c for c in rows.columns if c != first]
        return rows.groupBy(*keys).agg(F.min(first).alias(first)).select(*rows.columns)

    def stories(self) -> DataFrame:
        return self.table("source_record").select("story_id").where("story_id IS NOT NULL").distinct()
