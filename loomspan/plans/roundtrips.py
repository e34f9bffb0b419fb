"""Queries through files: what is written by a sink and read again by a source must be the rows that went in."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.functions import guards
from loomspan.plans.registry import Catalog
from loomspan.session import table
from loomspan.sources import files, sinks
from loomspan.streaming.history import shared_folder

catalog = Catalog()
query = catalog.query


@query("SELECT DISTINCT id, type, source, target FROM relation")
def jsonl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations as compressed lines of JSON, nulls kept."""
    path = shared_folder(spark, "lines")
    sinks.write_jsonl(table(spark, sf_dir, "relation").select("id", "type", "source", "target").distinct(), path, "gzip")
    return files.read_jsonl(spark, path, "id string, type string, source string, target string")


@query(
    """WITH a AS (SELECT DISTINCT story_id, segment, tr_centers_story_seconds AS c FROM alignment), s AS (SELECT story_id, segment, CAST(unnest(range(len(c))) AS INTEGER) AS i, c FROM a), n AS (SELECT story_id, segment, i, i // 16 AS block, c[i + 1] AS x FROM s)
SELECT story_id AS story, CAST(block AS INTEGER) AS block, count(*) AS rows, round(sum(CASE WHEN isfinite(x) THEN CASE WHEN block = 1 THEN -x ELSE x END END), 4) AS total FROM n GROUP BY ALL"""
)
def tensor_blocks_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor table by subject, story and block, of which one block of every story is written anew, with the sign turned."""
    path = shared_folder(spark, "tensor")
    a = table(spark, sf_dir, "alignment").select("story_id", "segment", F.col("tr_centers_story_seconds").alias("c")).distinct()
    each = a.select(F.lit("p").alias("subject"), F.col("story_id").alias("story"), F.col("segment").alias("repeat"), F.posexplode("c").alias("t", "x"))
    rows = each.withColumn("block", F.floor(F.col("t") / 16).cast("int"))
    shaped = lambda df, x: df.select("subject", "story", "repeat", "t", "block", F.array(x).alias("values"))
    files.write_tensor(shaped(rows, F.col("x")), path)
    files.write_tensor(shaped(rows.where("block = 1"), -F.col("x")), path)
    x = F.col("values")[0]
    return spark.read.parquet(path).groupBy("story", "block").agg(F.count("*").alias("rows"), F.round(F.sum(F.when(~F.isnan(x), x)), 4).alias("total"))


@query("SELECT 'context' AS artifact, (SELECT count(*) FROM context) AS n, true AS verified UNION ALL SELECT 'relation', (SELECT count(*) FROM relation), true")
def published_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables published under the digest of their contents, found by the pointer to the newest build and held against the receipt."""
    root = shared_folder(spark, "builds")
    names = ("context", "relation")
    sinks.publish(spark, root, {name: table(spark, sf_dir, name).limit(0) for name in names}, {"build": 1})
    sinks.publish(spark, root, {name: table(spark, sf_dir, name) for name in names}, {"build": 2})
    newest = sinks.latest(spark, root)
    wrong = sinks.verify(spark, newest)
    each = [spark.read.parquet(f"{newest}/{name}").agg(F.lit(name).alias("artifact"), F.count("*").alias("n"), F.lit(name not in wrong).alias("verified")) for name in names]
    return each[0].unionAll(each[1])


@query("SELECT status, count(*) AS n FROM decision GROUP BY status")
def appended_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log to which decisions are appended in three parts."""
    path = shared_folder(spark, "log")
    d = table(spark, sf_dir, "decision").select("decision_id", "status")
    for part in range(3):
        sinks.append_log(d.where(F.pmod("decision_id", F.lit(3)) == part), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT '{"mentions":' || (SELECT count(*) FROM mention) || ',"odd":null,"relations":' || (SELECT count(*) FROM relation) || '}' AS content, false AS second, true AS refused""")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that is published whole, not written again if it is the same, and never replaced by another."""
    path = f"{shared_folder(spark, 'report')}/counts.json"
    report = {"relations": table(spark, sf_dir, "relation").count(), "mentions": table(spark, sf_dir, "mention").count(), "odd": float("nan")}
    sinks.write_once(spark, path, sinks.canonical(report))
    second = sinks.write_once(spark, path, sinks.canonical(report))
    try:
        sinks.write_once(spark, path, sinks.canonical({**report, "relations": -1}))
        refused = False
    except FileExistsError:
        refused = True
    return spark.createDataFrame([(sinks.read_bytes(spark, path).decode(), second, refused)], "content string, second boolean, refused boolean")


@query("SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS \"row\", round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One NPY file a label (the table does not grow), read row by row."""
    path = shared_folder(spark, "arrays")
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v")).orderBy("label", "vec_id").toPandas()
    for label, part in e.groupby("label"):
        buffer = io.BytesIO()
        np.save(buffer, np.stack(part["v"].to_numpy()))
        sinks.write_bytes(spark, f"{path}/{label}.npy", buffer.getvalue())
    rows = files.read_arrays(spark, path)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return rows.select(F.regexp_extract("path", r"/([0-9]+)\.npy$", 1).cast("long").alias("label"), "row", F.round(total, 5).alias("total"))


@query("SELECT r_name || '.txt' AS member, CAST(sum(length(n_name)) + count(*) - 1 AS BIGINT) AS size, string_agg(n_name, chr(10) ORDER BY n_name) AS content FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an archive with the nations of each region, held against the exact inventory."""
    path = f"{shared_folder(spark, 'archive')}/a.zip"
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    lists = table(spark, sf_dir, "nation").join(regions, "n_regionkey").groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names")).collect()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for r in lists:
            archive.writestr(f"{r['r_name']}.txt", "\n".join(r["names"]))
    sinks.write_bytes(spark, path, buffer.getvalue())
    members = files.read_zip_members(spark, path)
    if files.missing_members(members, regions.select(F.concat("r_name", F.lit(".txt")).alias("member"))).count():
        raise ValueError("members do not fit the inventory")
    return members.select("member", "size", F.decode("content", "UTF-8").alias("content"))


@query(
    "SELECT r_name AS tier, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS idx, CAST(n_nationkey AS DOUBLE) AS start, n_nationkey + 1.5 AS \"end\", n_name AS label, greatest(0.0, coalesce(lag(n_nationkey + 1.5) OVER (PARTITION BY r_name ORDER BY n_nationkey) - n_nationkey, 0.0)) AS overlap FROM nation JOIN region ON r_regionkey = n_regionkey"
)
def timing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of timed labels, one for each region, with how far each label begins before the last one ends."""
    path = f"{shared_folder(spark, 'tiers')}/a.TextGrid"
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_name", "n_nationkey").collect()
    tiers = {name: [r for r in rows if r["r_name"] == name] for name in dict.fromkeys(r["r_name"] for r in rows)}
    lines = ['"ooTextFile"', '"TextGrid"', "0", "30", "<exists>", str(len(tiers))]
    for name, held in tiers.items():
        lines += ['"IntervalTier"', f'"{name}"', "0", "30", str(len(held))]
        for r in held:
            lines += [str(r["n_nationkey"]), str(r["n_nationkey"] + 1.5), f'"{r["n_name"]}"']
    sinks.write_bytes(spark, path, "\n".join(lines).encode())
    return files.read_textgrids(spark, path).select("tier", "idx", "start", "end", "label", "overlap")


@query("SELECT CAST(n_nationkey AS INTEGER) AS vertex, r_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey")
def surface_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices with the name of their colour, as a surface annotation file."""
    path = f"{shared_folder(spark, 'surface')}/a.annot"
    vertices = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    colours = table(spark, sf_dir, "region").orderBy("r_regionkey").collect()
    raw = struct.pack(">i", len(vertices)) + b"".join(struct.pack(">ii", r["n_nationkey"], r["n_regionkey"] + 1) for r in vertices)
    raw += struct.pack(">i", 1) + struct.pack(">i", len(colours)) + struct.pack(">i", 2) + b"t\0"
    for r in colours:
        name = r["r_name"].encode() + b"\0"
        raw += struct.pack(">i", len(name)) + name + struct.pack(">iiii", r["r_regionkey"] + 1, 0, 0, 0)
    sinks.write_bytes(spark, path, raw)
    return files.read_annot(spark, path).select("vertex", "name")


@query(
    "WITH e AS (SELECT user_id % 50 AS source, CAST(event_id % 3 AS INTEGER) AS repeat, event_type AS kind, value FROM events) SELECT source, repeat, kind, count(*) AS n, round(sum(CASE WHEN source = 7 THEN -value ELSE value END), 4) AS total FROM e GROUP BY ALL"
)
def trace_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces by source, of which one source is exported anew, read by source and kind."""
    path = shared_folder(spark, "traces")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("source"), (F.col("event_id") % 3).cast("int").alias("repeat"), F.col("event_type").alias("kind"), F.col("event_id").alias("idx"), F.array("value").alias("values"))
    files.write_traces(e, path)
    files.write_traces(e.where("source = 7").withColumn("values", F.transform("values", lambda x: -x)), path)
    return files.read_traces(spark, path).groupBy("source", "repeat", "kind").agg(F.count("*").alias("n"), F.round(F.sum(F.col("values")[0]), 4).alias("total"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def archive_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of records and one of sidecars, which must belong together one to one, both with the digest that is pinned."""
    root = shared_folder(spark, "pinned")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    side = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    pins = {name: (sinks.frame_hash(df), df) for name, df in {"records": n, "sidecars": side}.items()}
    read = {}
    for name, (digest, df) in pins.items():
        sinks.write_jsonl(df, f"{root}/{name}")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        read[name] = sinks.checked(files.read_jsonl(spark, f"{root}/{name}", schema), digest)
    return guards.one_to_one(read["records"], read["sidecars"], ["n_nationkey"])


@query("SELECT 'story=' || (user_id % 5) || '/kind=' || event_type AS folder, 1 AS files FROM events GROUP BY 1")
def file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a directory with their folders, found by a walk that reads no content."""
    path = shared_folder(spark, "walk")
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("story"), F.col("event_type").alias("kind"), "value")
    e.repartition("story", "kind").write.partitionBy("story", "kind").parquet(path)
    found = files.catalogue(spark, path).where(F.endswith("name", F.lit(".parquet")) & (F.col("size") > 0))
    return found.groupBy("folder").agg(F.count("*").cast("int").alias("files"))


@query(
    """WITH e AS (SELECT label % 4 AS layer, vec_id % 7 AS story, row_number() OVER (PARTITION BY label % 4, vec_id % 7 ORDER BY vec_id) - 1 AS t, list_sum(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), w AS (SELECT * FROM e WHERE layer = 1 AND story = 3)
SELECT CAST(a.t AS INTEGER) AS t, d AS delay, round(b.x, 5) AS total FROM w a, (SELECT unnest([1, 2]) AS d) JOIN w b ON b.t = a.t - d"""
)
def frozen_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one layer and story, each with those that lie so many rows before it."""
    path = shared_folder(spark, "states")
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 4).alias("layer"), (F.col("vec_id") % 7).alias("story"), "vec_id", F.col("embedding").cast("array<double>").alias("values"))
    rows = e.withColumn("t", (F.row_number().over(Window.partitionBy("layer", "story").orderBy("vec_id")) - 1).cast("int"))
    rows.drop("vec_id").repartition("layer", "story").write.partitionBy("layer", "story").parquet(path)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return files.states(spark, path, 1, 3, [1, 2]).select("t", "delay", F.round(total, 5).alias("total"))


@query("SELECT count(*) + 1 AS lines, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS names FROM region")
def report_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with the rows of a small report."""
    page = sinks.html_report("regions", table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    text = spark.createDataFrame([(page,)], "page string")
    cells = F.regexp_extract_all("page", F.lit("<td>([^<]*)</td>"), F.lit(1))
    return text.select(F.size(F.regexp_extract_all("page", F.lit("<tr>"), F.lit(0))).cast("long").alias("lines"), F.array_join(F.filter(cells, lambda c, i: i % 2 == 1), ",").alias("names"))


@query("SELECT DISTINCT id, story_id, form FROM mention")
def public_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that may be seen; a frame with any other is refused."""
    m = table(spark, sf_dir, "mention")
    try:
        guards.public_projection(m, ["id", "story_id", "form"])
    except ValueError:
        return guards.public_projection(m.select("story_id", "form", "id").distinct(), ["id", "story_id", "form"])
    raise AssertionError("a column that is not public was let through")


QUERIES, ORACLE = catalog.queries, catalog.oracle
