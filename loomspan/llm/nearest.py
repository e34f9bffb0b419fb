"""Pair records of two tables that are nearest in time, by a learned index per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds that one shard of an entity spans; what is held in memory at once are the targets of one shard.
SHARD_SECONDS = 512.0
#: Rows of a shard from which it is cut into finer ones, down to FINEST tolerances, below which shards would be little but overlap.
DENSE_ROWS = 200_000
FINEST = 8
#: Most shards that are cut, the densest ones; a shard beyond has less than one row in so many.
MOST_DENSE = 4096
#: Positions between two knots of the piecewise-linear index.
SEGMENT = 32

_OUT = T.StructType([T.StructField("source_id", T.StringType()), T.StructField("target", T.LongType()), T.StructField("gap", T.DoubleType())])


class PiecewiseIndex:
    """Learned positions in many sorted arrays that lie one after another in ``values``, each from ``lo`` to ``hi``.

    Between knots ``SEGMENT`` places apart the position is interpolated; the greatest error of each piece is kept, so
    the exact place lies within it of the prediction and a short local search finds it.
    """

    def __init__(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.values, self.lo, self.hi = values, lo, hi
        pieces = np.maximum(1, -(-(hi - lo) // SEGMENT))
        self.first = np.r_[0, np.cumsum(pieces)]
        owner = np.repeat(np.arange(len(lo)), pieces)
        self.begin = lo[owner] + (np.arange(len(owner)) - self.first[owner]) * SEGMENT
        self.end = np.minimum(self.begin + SEGMENT, hi[owner])
        last = np.maximum(np.minimum(self.end, hi[owner] - 1), self.begin)
        if len(values):
            here = np.minimum(self.begin, len(values) - 1)
            self.knot = values[here]
            rise = values[np.minimum(last, len(values) - 1)] - self.knot
            self.slope = np.where(rise > 0, (last - self.begin) / np.where(rise > 0, rise, 1), 0.0)
            self.error = np.zeros(len(owner), np.int64)
            piece = np.repeat(np.arange(len(owner)), self.end - self.begin)
            at = np.repeat(self.begin, self.end - self.begin) + np.arange(len(piece)) - np.repeat(np.cumsum(self.end - self.begin) - (self.end - self.begin), self.end - self.begin)
            off = np.abs(self._line(piece, values[at]) - at)
            np.maximum.at(self.error, piece, off)

    def _line(self, piece: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.begin[piece] + np.floor((query - self.knot[piece]) * self.slope[piece]).astype(np.int64)

    def left(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        """First position of array ``which`` whose value is not below the query."""
        empty = self.hi[which] <= self.lo[which]
        piece = np.maximum(_bisect(self.knot, query, self.first[which], self.first[which + 1]) - 1, self.first[which])
        guess = np.clip(self._line(piece, query), self.begin[piece], self.end[piece])
        low = np.maximum(guess - self.error[piece] - 1, self.begin[piece])
        high = np.minimum(guess + self.error[piece] + 2, self.end[piece])
        found = _bisect(self.values, query, low, high)
        return np.where(empty, self.lo[which], found)


def _bisect(values: np.ndarray, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First place in [low, high) with a value not below the query, for all queries at once."""
    low, high = low.copy(), np.maximum(low, high)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        below = open_ & (values[np.minimum(middle, len(values) - 1)] < query)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    return low


def _pieces(rows: DataFrame, tolerance: float) -> DataFrame | None:
    """Parts into which dense shards are cut: ``entity, shard, pieces``; None without any. Counted with partial sums; at most MOST_DENSE rows reach the driver."""
    counted = rows.groupBy("entity", F.floor(F.col("at") / SHARD_SECONDS).cast("long").alias("shard")).count().where(F.col("count") >= DENSE_ROWS)
    dense = counted.orderBy(F.desc("count"), "entity", "shard").limit(MOST_DENSE).collect()
    most = max(1, int(SHARD_SECONDS / (FINEST * tolerance))) if tolerance > 0 else 1 << 20
    cut = [(r["entity"], r["shard"], min(most, -(-r["count"] // (DENSE_ROWS // 2)))) for r in dense]
    return rows.sparkSession.createDataFrame(cut, "entity string, shard long, pieces int") if cut else None


def _sharded(rows: DataFrame, dense: DataFrame | None, reach: float) -> DataFrame:
    """Add ``shard`` and ``piece``, the stretch of time that a row lies in; with ``reach``, one row for each stretch that it lies near."""
    shard = lambda x: F.floor(x / SHARD_SECONDS).cast("long")
    low, high = F.col("at") - reach, F.col("at") + reach
    rows = rows.withColumn("shard", F.explode(F.sequence(shard(low), shard(high))) if reach else shard(low))
    if dense is None:
        return rows.withColumn("piece", F.lit(0))
    rows = rows.join(F.broadcast(dense), ["entity", "shard"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    within = lambda x: F.least(F.greatest(F.floor((x - F.col("shard") * SHARD_SECONDS) / SHARD_SECONDS * F.col("pieces")), F.lit(0)), F.col("pieces") - 1).cast("int")
    return rows.withColumn("piece", F.explode(F.sequence(within(low), within(high))) if reach else within(low)).drop("pieces")


def nearest_in_time(records: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """For each record the nearest target of its entity, at most ``tolerance`` away: ``source_id, target, gap``, distinct.

    ``records``: ``source_id, entity, at``; ``targets``: ``entity, at, target``, times in seconds. Both are cut into
    shards of SHARD_SECONDS, dense ones into pieces of these, so a hot entity is spread over its time; targets near an edge lie on both sides of it. Each partition
    is sorted by piece, targets before records, and read as a stream; a piece's targets are indexed once, however many batches its records fill.

    Defined cases: null entities, null, NaN and infinite times and null targets take no part; of equally near targets the
    earlier counts, of targets at the same time the least; a record without target in reach gives no row.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    asked = records.where(F.col("entity").isNotNull() & fine("at")).select("entity", F.lit(1).alias("kind"), F.col("at").cast("double"), F.lit(None).cast("long").alias("target"), "source_id")
    held = targets.where(F.col("entity").isNotNull() & fine("at") & F.col("target").isNotNull()).select("entity", F.lit(0).alias("kind"), F.col("at").cast("double"), F.col("target").cast("long"), F.lit(None).cast("string").alias("source_id"))
    dense = _pieces(held.select("entity", "at").unionByName(asked.select("entity", "at")), tolerance)
    rows = _sharded(held, dense, tolerance).unionByName(_sharded(asked, dense, 0.0))
    rows = rows.select("entity", "shard", "piece", "kind", "at", "target", "source_id").repartition("entity", "shard", "piece").sortWithinPartitions("entity", "shard", "piece", "kind", "at", "target")

    def answered(index: PiecewiseIndex, names: np.ndarray, which: np.ndarray, query: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
        values, lo, hi = index.values, index.lo, index.hi
        right = index.left(which, query)
        has_right, has_left = right < hi[which], right > lo[which]
        before = values[np.maximum(right - 1, 0)]
        left = index.left(which, np.where(has_left, before, query))
        gap_right = np.where(has_right, np.abs(values[np.minimum(right, len(values) - 1)] - query), np.inf)
        gap_left = np.where(has_left, np.abs(query - before), np.inf)
        best = np.where(gap_left <= gap_right, left, right)
        gap = np.minimum(gap_left, gap_right)
        near = gap <= tolerance
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(near)), pa.array(names[best[near]]), pa.array(gap[near])], names=_OUT.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        open_at: list[np.ndarray] = []
        open_names: list[np.ndarray] = []
        open_index: PiecewiseIndex | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            entity = np.asarray(batch.column(0).dictionary_encode().indices)
            shard, piece = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            is_target, at = np.asarray(batch.column(3)) == 0, np.asarray(batch.column(4))
            names, ids = np.asarray(batch.column(5).fill_null(0)), batch.column(6)
            edge = np.flatnonzero(np.r_[True, (entity[1:] != entity[:-1]) | (shard[1:] != shard[:-1]) | (piece[1:] != piece[:-1])])
            key = lambda row, batch=batch, shard=shard, piece=piece: (batch.column(0)[row].as_py(), shard[row], piece[row])
            start = 0
            if key(0) == open_key:
                start = int(edge[1]) if len(edge) > 1 else n
                held_here = is_target[:start]
                open_at.append(at[:start][held_here])
                open_names.append(names[:start][held_here])
                asked_here = np.flatnonzero(~held_here)
                if len(asked_here):
                    if open_index is None:
                        open_at, open_names = [np.concatenate(open_at)], [np.concatenate(open_names)]
                        open_index = PiecewiseIndex(open_at[0], np.array([0]), np.array([len(open_at[0])]))
                    if len(open_at[0]):
                        yield answered(open_index, open_names[0], np.zeros(len(asked_here), np.int64), at[asked_here], ids.take(pa.array(asked_here)))
                edge = edge[1:]
            if start == n:
                continue
            group = np.repeat(np.arange(len(edge)), np.diff(np.r_[edge, n]))
            held_here = is_target[start:]
            values, named = at[start:][held_here], names[start:][held_here]
            hi = np.cumsum(np.bincount(group[held_here], minlength=len(edge)))
            lo = np.r_[0, hi[:-1]]
            asked_here = np.flatnonzero(~held_here)
            if len(asked_here) and len(values):
                yield answered(PiecewiseIndex(values, lo, hi), named, group[asked_here], at[start:][asked_here], ids.take(pa.array(asked_here + start)))
            open_key, open_index = key(n - 1), None
            open_at, open_names = [values[lo[-1] :]], [named[lo[-1] :]]

    return rows.mapInArrow(run, _OUT).distinct()
