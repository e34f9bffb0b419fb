"""Queries on the scan clock: bins, anchors, masks, delays and support."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import clock
from loomspan.plans.registry import Catalog
from loomspan.session import table

catalog = Catalog()
query = catalog.query
#: Seconds of one bin of the event series, which stands for a scan row, and rows before its begin.
TR, LEADING, POSITION = 600.0, 5, 0.5
#: Least number of bins of a series; a stream with later events has a longer one.
BINS = 4400
DELAYS = [1, 2, 3, 4]

_SECONDS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0"
#: DuckDB: events with their bin, and all bins of the event types.
_EV = f"WITH e AS (SELECT event_id, event_type, value, {_SECONDS} AS s, CAST(ceil({_SECONDS} / {TR} + {LEADING} - {POSITION}) AS INTEGER) AS slot FROM events), rows AS (SELECT event_type, CAST(t AS INTEGER) AS t FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(range({BINS})) AS t)) "
_BINNED = _EV + ", x AS (SELECT r.event_type, r.t, coalesce(sum(value), 0.0) AS total, coalesce(avg(value), 0.0) AS mean, count(value) AS n FROM rows r LEFT JOIN e ON e.event_type = r.event_type AND e.slot = r.t GROUP BY ALL) "


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", seconds.alias("s"))
    return events.withColumn("slot", clock.first_bin(F.col("s"), TR, LEADING, POSITION))


def _last_bin(events: DataFrame) -> DataFrame:
    """One row: the last bin of every series, which no event lies behind."""
    return events.agg(F.greatest(F.lit(BINS - 1), F.max("slot").cast("int")).alias("last"))


def _rows(events: DataFrame) -> DataFrame:
    return events.select("event_type").distinct().crossJoin(_last_bin(events)).select("event_type", F.explode(F.sequence(F.lit(0), "last")).alias("t"))


@query(_EV + "SELECT event_id, slot, round(((slot + 0.5) - 5) * 600.0 - s, 4) AS lag FROM e")
def event_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bin at or after each event, and how long after it the bin is centred."""
    events = _events(spark, sf_dir)
    return events.select("event_id", "slot", F.round(clock.bin_centre(F.col("slot"), TR, LEADING) - F.col("s"), 4).alias("lag"))


@query(_BINNED + "SELECT event_type, t, round(total, 4) AS x, n FROM x")
def bin_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events summed into bins, empty bins 0."""
    events = _events(spark, sf_dir)
    return clock.causal_bins(events, ["event_type"], "slot", "value", _rows(events), "sum").withColumn("x", F.round("x", 4))


@query(_BINNED + "SELECT event_type, t, round(mean, 4) AS x, n FROM x")
def bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the events of each bin."""
    events = _events(spark, sf_dir)
    return clock.causal_bins(events, ["event_type"], "slot", "value", _rows(events)).withColumn("x", F.round("x", 4))


_MASK = _BINNED + f", m AS (SELECT event_type, t, mean, NOT EXISTS (SELECT 1 FROM e WHERE e.event_type = x.event_type AND e.event_id % 500 = 0 AND x.t BETWEEN e.slot - 2 AND e.slot + 2) AS known FROM x) "


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned means, where every event whose id divides by 500 counts as of unknown time."""
    events = _events(spark, sf_dir)
    rows = _rows(events)
    binned = clock.causal_bins(events, ["event_type"], "slot", "value", rows)
    unknown = events.where("event_id % 500 = 0").select("event_type", F.lit(None).cast("int").alias("at"), (F.col("slot") - 2).alias("left"), (F.col("slot") + 2).alias("right"))
    return binned.join(clock.known_rows(unknown, rows, "event_type", "at", "left", "right"), ["event_type", "t"])


@query(_MASK + "SELECT event_type, t, known FROM m")
def known_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that no event of unknown time may fall into."""
    return _masked(spark, sf_dir).select("event_type", "t", "known")


@query(
    _MASK
    + "SELECT event_type, t, "
    + ", ".join(f"round(coalesce(lag(mean, {d}) OVER w, 0), 4) AS x_d{d}" for d in DELAYS)
    + ", "
    + " AND ".join(f"coalesce(lag(known, {d}) OVER w, false)" for d in DELAYS)
    + " AS valid FROM m WINDOW w AS (PARTITION BY event_type ORDER BY t)"
)
def fir_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delayed copies of the binned series and their validity."""
    made = clock.fir(_masked(spark, sf_dir), "event_type", "t", ["x"], DELAYS, "known")
    return made.select("event_type", "t", *[F.round(f"x_d{d}", 4).alias(f"x_d{d}") for d in DELAYS], "valid")


@query(
    _MASK
    + ", v AS (SELECT event_type, t, "
    + " AND ".join(f"coalesce(lag(known, {d}) OVER w, false)" for d in DELAYS)
    + """ AS timing, t >= 10 AND t < 4390 AS trimmed, n > 0 AS present FROM (SELECT m.*, x.n FROM m JOIN x USING (event_type, t)) WINDOW w AS (PARTITION BY event_type ORDER BY t))
SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE NOT timing) AS excluded_timing, count(*) FILTER (WHERE timing AND NOT trimmed) AS excluded_trimmed, count(*) FILTER (WHERE timing AND trimmed AND NOT present) AS excluded_present, count(*) FILTER (WHERE timing AND trimmed AND present) AS retained FROM v GROUP BY event_type"""
)
def support_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each reason excludes in turn, and what is retained."""
    m = _masked(spark, sf_dir)
    valid = clock.fir(m, "event_type", "t", ["x"], DELAYS, "known").select("event_type", "t", F.col("valid").alias("timing"))
    checked = valid.join(m.select("event_type", "t", (F.col("n") > 0).alias("present")), ["event_type", "t"]).crossJoin(_last_bin(_events(spark, sf_dir))).withColumn("trimmed", F.col("t").between(10, F.col("last") - 10))
    return clock.exclusions(checked, "event_type", ["timing", "trimmed", "present"])


@query(
    """WITH d AS (SELECT DISTINCT ON (story_id, unit_index) * FROM source_record ORDER BY story_id, unit_index, ingested_utc)
SELECT story_id, unit_index, available_at_seconds, last_value(available_at_seconds IGNORE NULLS) OVER (PARTITION BY story_id ORDER BY unit_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_anchor,
first_value(available_at_seconds IGNORE NULLS) OVER (PARTITION BY story_id ORDER BY unit_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following_anchor FROM d"""
)
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last known time before and first known after each unit."""
    first = table(spark, sf_dir, "source_record").groupBy("story_id", "unit_index").agg(F.min_by("available_at_seconds", "ingested_utc").alias("available_at_seconds"))
    filled = clock.fill_anchors(first, "story_id", "unit_index", "available_at_seconds", "available_at_seconds")
    return filled.select("story_id", "unit_index", "available_at_seconds", "previous_anchor", "following_anchor")


@query(
    """WITH s AS (SELECT DISTINCT story_id, segment, response_raw_indices FROM alignment), v AS (SELECT story_id, list(DISTINCT r) AS valid FROM (SELECT story_id, unnest(response_raw_indices) AS r FROM s) GROUP BY story_id),
u AS (SELECT DISTINCT id, story_id, raw_feature_bin AS slot FROM source_record)
SELECT id, CASE WHEN slot < 0 THEN [] ELSE list_filter([slot + 1, slot + 2, slot + 3, slot + 4], lambda r: list_contains(valid, r)) END AS rows, slot >= 0 AND len(list_filter([slot + 1, slot + 2, slot + 3, slot + 4], lambda r: list_contains(valid, r))) = 4 AS complete FROM u JOIN v USING (story_id) WHERE slot IS NOT NULL"""
)
def delayed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan rows at which each unit is measured, by its delays."""
    valid = table(spark, sf_dir, "alignment").select("story_id", F.explode("response_raw_indices").alias("r")).distinct()
    unit = table(spark, sf_dir, "source_record").where("raw_feature_bin IS NOT NULL").select("id", "story_id", F.col("raw_feature_bin").alias("slot")).distinct()
    return clock.measured_rows(unit, "id", "story_id", "slot", DELAYS, valid, "r").select("id", "rows", ((F.col("slot") >= 0) & (F.size("rows") == len(DELAYS))).alias("complete"))


@query(
    """WITH s AS (SELECT DISTINCT story_id, segment, response_raw_indices FROM alignment), v AS (SELECT story_id, list(DISTINCT r) AS valid FROM (SELECT story_id, unnest(response_raw_indices) AS r FROM s) GROUP BY story_id),
u AS (SELECT DISTINCT id, story_id, decoder_timing_eligible AS eligible, list_distinct(decoder_raw_response_rows) AS rows FROM source_record), k AS (SELECT eligible, len(rows) AS n, len(list_intersect(rows, valid)) AS h FROM u JOIN v USING (story_id) WHERE rows IS NOT NULL)
SELECT eligible, count(*) AS n, count(*) FILTER (WHERE h = k.n) AS whole, count(*) FILTER (WHERE h > 0 AND h < k.n) AS part, count(*) FILTER (WHERE h = 0 AND k.n > 0) AS gone FROM k GROUP BY eligible"""
)
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the units that the measured rows keep whole, in part or not."""
    kept_rows = table(spark, sf_dir, "alignment").select("story_id", F.explode("response_raw_indices").alias("r")).distinct()
    unit = table(spark, sf_dir, "source_record").where("decoder_raw_response_rows IS NOT NULL").select("id", "story_id", F.col("decoder_timing_eligible").alias("eligible"), F.array_distinct("decoder_raw_response_rows").alias("rows")).distinct()
    return clock.coverage(unit.join(kept_rows.select("story_id").distinct(), "story_id", "left_semi"), "story_id", "eligible", "rows", kept_rows, "r")


QUERIES, ORACLE = catalog.queries, catalog.oracle
