"""Structured streams of annotation units and events."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.session import shared_root


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.parquet(path)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors see, below the session's checkpoint directory."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def gap_blocked(units: DataFrame, key: str, index: str) -> DataFrame:
    """Pass on the units of a key in order of their index from 0; those behind a gap wait until it is filled.

    A stateful operator: the state of a key is the next index and the sorted indices that wait, which is bounded by the key's gaps. Repeated
    units are passed on once. Result: ``key, index``.
    """

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting = state.get if state.exists else (0, [])
        held = set(waiting)
        for frame in frames:
            held.update(int(i) for i in frame[index].dropna() if i >= following)
        ready = []
        while following in held:
            held.remove(following)
            ready.append(following)
            following += 1
        state.update((following, sorted(held)))
        yield pd.DataFrame({key: [keys[0]] * len(ready), index: pd.array(ready, "int32")})

    return units.select(key, index).groupBy(key).applyInPandasWithState(run, f"{key} string, {index} int", "following int, waiting array<int>", "append", GroupStateTimeout.NoTimeout)


def delayed(rows: DataFrame, key: str, index: str, value: str, delays: list[int]) -> DataFrame:
    """Delayed copies of a value as a stream: ``key, index, delay, x``, for every index of a key in order from 0 on; 0 before the first.

    A stateful operator: the state of a key is its next index, the values that the greatest delay still needs, and those that wait behind a gap. Repeated indices count once, the first that comes.
    """
    if not delays or len(set(delays)) != len(delays) or min(delays) < 0:
        raise ValueError("delays must be different and not negative")
    reach = max(delays)

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, recent, places, held = state.get if state.exists else (0, [], [], [])
        waiting, recent = dict(zip(places, held, strict=True)), list(recent)
        for frame in frames:
            for i, x in zip(frame[index], frame[value], strict=True):
                if pd.notna(i) and i >= following:
                    waiting.setdefault(int(i), float(x))
        out = []
        while following in waiting:
            recent.append(waiting.pop(following))
            out += [(keys[0], following, d, recent[-1 - d] if d < len(recent) else 0.0) for d in delays]
            recent = recent[-reach - 1 :]
            following += 1
        state.update((following, recent, list(waiting.keys()), list(waiting.values())))
        yield pd.DataFrame(out, columns=[key, index, "delay", "x"]).astype({index: "int32", "delay": "int32", "x": "float64"})

    schema = f"{key} string, {index} int, delay int, x double"
    kept = rows.select(key, index, F.col(value).cast("double").alias(value))
    return kept.groupBy(key).applyInPandasWithState(run, schema, "following int, recent array<double>, places array<int>, held array<double>", "append", GroupStateTimeout.NoTimeout)


def append_validated(records: DataFrame, key: str, index: str, identity: str) -> DataFrame:
    """Append records to each key's history and tell of every one whether it is new: ``key, index, id, verdict``.

    ``appended`` the first time, ``repeated`` if the same id came in the same unit before, ``conflict`` if it came in another unit. The
    state is one unit for each id of a key, so a batch touches only the ids that it brings, however long a history is.
    """

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = state.get[0] if state.exists else None
        units: list[int] = []
        verdicts: list[str] = []
        for frame in frames:
            for unit in frame[index]:
                verdicts.append("appended" if first is None else "repeated" if first == unit else "conflict")
                first = unit if first is None else first
                units.append(unit)
        state.update((int(first),))
        yield pd.DataFrame({key: [keys[0]] * len(units), index: pd.array(units, "int32"), "id": [keys[1]] * len(units), "verdict": verdicts})

    known = records.select(key, index, identity).where(F.col(index).isNotNull())
    return known.groupBy(key, identity).applyInPandasWithState(run, f"{key} string, {index} int, id string, verdict string", "unit int", "append", GroupStateTimeout.NoTimeout)


def binned(events: DataFrame, time: str, width: str, by: str, value: str, late: str) -> DataFrame:
    """Sums and counts per tumbling window and value of ``by``; events later than ``late`` behind the newest are dropped, so state is bounded."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.sum(value).alias("x"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "x", "n")


def run_to_table(streamed: DataFrame, mode: str, purpose: str) -> DataFrame:
    """Run a stream over all that is there now, to a table in the shared folder, and read it.

    Each batch has a folder of its own number, which a batch that is tried again overwrites; in complete mode there is one for all.
    """
    spark = streamed.sparkSession
    target = shared_folder(spark, purpose)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/rows/batch={0 if mode == 'complete' else number}")

    query = streamed.writeStream.outputMode(mode).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    whole = T.StructType([*streamed.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(f"{target}/rows").select(*streamed.columns)
