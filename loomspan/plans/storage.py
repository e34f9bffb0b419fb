"""Queries of scans, JSON values and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import jsons
from loomspan.operators import relate
from loomspan.plans.registry import Catalog
from loomspan.session import table
from loomspan.sources import files
from loomspan.streaming import history

catalog = Catalog()
query = catalog.query


@query("WITH d AS (SELECT DISTINCT draft_id, graph FROM draft WHERE json_valid(graph) AND json_type(graph) = 'OBJECT') SELECT draft_id, graph->>'$.protocol' AS protocol, graph->>'$.coverage' AS coverage, length(graph->>'$.summary') AS summary_length FROM d")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: JSON objects by a stated schema, of which only what is asked for is parsed."""
    d = table(spark, sf_dir, "draft").select("draft_id", "graph").distinct()
    parsed = d.withColumn("g", F.try_parse_json("graph")).where(F.startswith(F.schema_of_variant("g"), F.lit("OBJECT")))
    get = lambda name: F.try_variant_get("g", f"$.{name}", "string")
    return parsed.select("draft_id", get("protocol").alias("protocol"), get("coverage").alias("coverage"), F.length(get("summary")).cast("long").alias("summary_length"))


@query("SELECT story_id, segment, CAST(i AS INTEGER) AS block, list_aggregate(response_raw_indices[i * 16 + 1 : i * 16 + 16], 'string_agg', ',') AS v FROM (SELECT DISTINCT story_id, segment, response_raw_indices, unnest(range((len(response_raw_indices) + 15) // 16)) AS i FROM alignment WHERE len(response_raw_indices) > 0) WHERE i IN (0, 2)")
def tensor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: arrays in blocks, of which some are read."""
    a = table(spark, sf_dir, "alignment").where(F.size("response_raw_indices") > 0).select("story_id", "segment", "response_raw_indices").distinct()
    cut = a.select("story_id", "segment", F.explode(files.blocked(F.col("response_raw_indices"), 16)).alias("b")).where(F.col("b.block").isin(0, 2))
    return cut.select("story_id", "segment", "b.block", F.array_join(F.col("b.values").cast("array<string>"), ",").alias("v"))


@query("SELECT n_regionkey AS k, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS i, n_nationkey AS j, CAST(n_nationkey * 1.5 AS DOUBLE) AS v FROM nation")
def csr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed rows as coordinates."""
    n = table(spark, sf_dir, "nation")
    packed = n.groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("indices"))
    packed = packed.select("k", "indices", F.transform("indices", lambda x: x * F.lit(1.5).cast("double")).alias("data"), F.sequence(F.lit(0), F.size("indices")).alias("indptr"))
    return files.csr_to_coo(packed, "k", "data", "indices", "indptr").select("k", "i", "j", F.col("v").cast("double").alias("v"))


@query("SELECT DISTINCT p_name AS name, substr(p_name, 7) AS name_rest FROM part WHERE starts_with(p_name, 'small ')")
def named_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a prefix and what follows it."""
    return files.named_like(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), "name", "small ")


@query(
    """WITH d AS (SELECT DISTINCT draft_id, graph FROM draft WHERE graph IS NOT NULL) SELECT draft_id, CASE WHEN ltrim(graph) LIKE '{%' OR ltrim(graph) LIKE '[%' THEN 'json' WHEN ltrim(graph) LIKE '<%' THEN 'xml' ELSE 'other' END AS kind FROM d"""
)
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format of each content by its first bytes."""
    d = table(spark, sf_dir, "draft").where("graph IS NOT NULL").select("draft_id", "graph").distinct()
    return d.select("draft_id", files.content_kind(F.encode("graph", "UTF-8")).alias("kind"))


@query("""SELECT event_id, sha256('{"k":' || (props->>'$.k') || ',"type":"' || event_type || '"}') AS h FROM events""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: digest of JSON with sorted keys, whatever order it comes in."""
    text = F.concat(F.lit('{ "type" : "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("j")).select("event_id", jsons.canonical_hash("j").alias("h"))


@query("WITH c AS (SELECT DISTINCT story_id, segment, CAST(i AS INTEGER) AS i, tr_centers_story_seconds[i + 1] AS x FROM (SELECT *, unnest(range(len(tr_centers_story_seconds))) AS i FROM alignment)) SELECT story_id, segment, i, CASE WHEN isfinite(x) THEN x END AS x FROM c")
def nan_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN as null for reports."""
    c = table(spark, sf_dir, "alignment").select("story_id", "segment", F.posexplode("tr_centers_story_seconds").alias("i", "x")).withColumn("x", jsons.nan_to_null(F.col("x")))
    return c.distinct()


@query("WITH d AS (SELECT DISTINCT story_id, unit_index FROM draft WHERE status = 'accepted'), r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY unit_index) - 1 AS r FROM d) SELECT story_id, unit_index FROM r WHERE r = unit_index")
def stream_gap_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted units as a stream, passed on up to the first gap."""
    accepted = history.stream(spark, sf_dir, "draft").where("status = 'accepted'")
    return history.run_to_table(history.gap_blocked(accepted, "story_id", "unit_index"), "append", "gap")


@query("SELECT story_id, CASE WHEN k = 1 THEN 'appended' ELSE 'repeated' END AS verdict, count(*) AS n FROM (SELECT story_id, id, row_number() OVER (PARTITION BY story_id, id) AS k FROM relation) GROUP BY ALL")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended to each story's history as a stream, with a verdict on each."""
    records = history.stream(spark, sf_dir, "relation").select("story_id", F.expr(r"try_cast(regexp_extract(unit_id, '_u([0-9]+)$', 1) as int)").alias("unit_index"), "id")
    told = history.run_to_table(history.append_validated(records, "story_id", "unit_index", "id"), "append", "history")
    return told.groupBy("story_id", "verdict").agg(F.count("*").alias("n"))


@query(
    """WITH u AS (SELECT DISTINCT story_id, unit_index, CAST(available_at_token AS DOUBLE) AS x FROM source_record WHERE available_at_token IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY unit_index) - 1 AS r FROM u)
SELECT a.story_id, a.unit_index, CAST(d AS INTEGER) AS delay, coalesce(b.x, 0.0) AS x FROM p a, (SELECT unnest([0, 1, 3]) AS d) LEFT JOIN p b ON b.story_id = a.story_id AND b.unit_index = a.unit_index - d WHERE a.r = a.unit_index"""
)
def stream_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delayed values of every story's units as a stream, up to the first gap."""
    units = history.stream(spark, sf_dir, "source_record").where("available_at_token IS NOT NULL")
    return history.run_to_table(history.delayed(units, "story_id", "unit_index", "available_at_token", [0, 1, 3]), "append", "delays")


@query("SELECT strftime(to_timestamp(floor(epoch(ts) / 3600) * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, event_type, round(sum(value), 4) AS x, count(*) AS n FROM events GROUP BY ALL")
def stream_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: events in tumbling windows, as a stream with a watermark."""
    events = history.stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    made = history.run_to_table(history.binned(events, "ts", "1 hour", "event_type", "value", "40 days"), "complete", "bins")
    return made.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", F.round("x", 4).alias("x"), "n")


@query(
    """WITH u AS (SELECT DISTINCT story_id, unit_index, id FROM source_record), k AS (SELECT u.*, EXISTS (SELECT 1 FROM relation r WHERE r.unit_id = u.id) AS ok FROM u), g AS (SELECT story_id, unit_index, ok, row_number() OVER (PARTITION BY story_id ORDER BY unit_index) - 1 AS r FROM k)
SELECT story_id, min(unit_index) AS unit_index FROM g WHERE NOT ok GROUP BY story_id"""
)
def next_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next unit of each story after those that have relations without gap."""
    done = table(spark, sf_dir, "relation").select(F.col("unit_id").alias("id"), F.lit(True).alias("ok")).distinct()
    u = table(spark, sf_dir, "source_record").select("story_id", "unit_index", "id").distinct().join(done, "id", "left").select("story_id", "unit_index", F.coalesce("ok", F.lit(False)).alias("ok"))
    state = relate.contiguous_prefix(u, "story_id", "unit_index", "ok")
    return state.where("state <> 'taken'").groupBy("story_id").agg(F.min("unit_index").alias("unit_index"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
