"""Queries that aggregate: counts, catalogs, vocabularies, macro means, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import aggregates as agg
from loomspan.plans.registry import Catalog
from loomspan.plans.text import document_words
from loomspan.session import table

catalog = Catalog()
query = catalog.query
#: DuckDB: words of the documents.
_WORDS = r"w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\{[^{}]*\}', ' ', 'g'), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')) AS word FROM documents)"


@query("SELECT support, count(*) AS n FROM mention GROUP BY support")
def count_by_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: rows per value."""
    return table(spark, sf_dir, "mention").groupBy("support").agg(F.count("*").alias("n"))


@query("SELECT story_id, string_agg(support || '=' || n, ',' ORDER BY support) AS counts FROM (SELECT story_id, support, count(*) AS n FROM mention WHERE support IS NOT NULL GROUP BY ALL) GROUP BY story_id")
def count_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: counts by value as a map, here rendered."""
    made = agg.count_map(table(spark, sf_dir, "mention").where("support IS NOT NULL"), "story_id", "support")
    return made.select("story_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("counts"))


@query(
    "SELECT story_id, count(*) AS total, count(*) FILTER (WHERE target IS NULL) AS unresolved, count(*) FILTER (WHERE support = 'explicit' AND target IS NOT NULL) AS eligible, count(*) FILTER (WHERE evidence.verbatim IS NULL) AS unanchored FROM mention GROUP BY story_id"
)
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several conditional counts in one pass."""
    target = F.col("target")
    return table(spark, sf_dir, "mention").groupBy("story_id").agg(
        F.count("*").alias("total"), F.count_if(target.isNull()).alias("unresolved"), F.count_if((F.col("support") == "explicit") & target.isNotNull()).alias("eligible"), F.count_if(F.col("evidence.verbatim").isNull()).alias("unanchored")
    )


@query(
    "SELECT form, support, count(*) AS occurrences, count(DISTINCT unit_id) AS sources, count(DISTINCT story_id) AS stories FROM mention WHERE form IS NOT NULL AND support IS NOT NULL GROUP BY ALL"
)
def occurrence_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and label the occurrences, distinct sources and stories."""
    m = table(spark, sf_dir, "mention").where("form IS NOT NULL AND support IS NOT NULL")
    return m.groupBy("form", "support").agg(F.count("*").alias("occurrences"), F.countDistinct("unit_id").alias("sources"), F.countDistinct("story_id").alias("stories"))


@query(f"WITH {_WORDS}, v AS (SELECT lower(word) AS word, count(DISTINCT doc_id) AS df FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5) SELECT word, df, row_number() OVER (ORDER BY encode(word)) - 1 AS \"column\" FROM v")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in at least five documents, numbered by name."""
    return agg.vocabulary(document_words(spark, sf_dir).select("doc_id", F.lower("word").alias("word")), "word", "doc_id", 5)


@query(
    f"""WITH {_WORDS}, x AS (SELECT source, lower(word) AS word FROM w JOIN documents USING (doc_id) WHERE source IS NOT NULL), v AS (SELECT DISTINCT word FROM x WHERE source = 'transcript'),
c AS (SELECT source, x.word, count(*) AS n, max(CASE WHEN v.word IS NULL THEN 1 ELSE 0 END) AS miss FROM x LEFT JOIN v USING (word) GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS observed, CAST(coalesce(sum(n) FILTER (WHERE miss = 1), 0) AS BIGINT) AS unseen, count(*) FILTER (WHERE miss = 1) AS unseen_features FROM c GROUP BY source"""
)
def out_of_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source that the transcripts do not hold."""
    sources = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source")
    tokens = document_words(spark, sf_dir).join(sources, "doc_id").select("source", F.lower("word").alias("word"))
    return agg.out_of_vocabulary(tokens, tokens.where("source = 'transcript'").select("word").distinct(), "word", "source")


#: DuckDB: line items as repeated predictions; the order is the source, its customer the story, the flag the family.
_PRED = "p AS (SELECT o_custkey AS story, l_orderkey AS source, l_linenumber AS item, l_returnflag AS family, l_discount AS correct, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("item"), F.col("l_returnflag").alias("family"), F.col("l_discount").alias("correct"), F.col("l_quantity").alias("weight"))
    return lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("story")), "source")


@query(
    f"""WITH {_PRED}, i AS (SELECT story, source, item, avg(correct) AS v, max(weight) AS w FROM (SELECT story, source, item, correct, max(weight) OVER (PARTITION BY source, item) AS weight FROM p) GROUP BY ALL),
s AS (SELECT story, source, sum(v * w) / sum(w) AS v FROM i GROUP BY ALL), t AS (SELECT story, avg(v) AS v, count(*) AS n FROM s GROUP BY story) SELECT count(*) AS stories, CAST(sum(n) AS BIGINT) AS sources, round(avg(v), 6) AS value FROM t"""
)
def macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to sources to stories to one number."""
    p = _predictions(spark, sf_dir)
    same = p.groupBy("source", "item").agg(F.max("weight").alias("weight"))
    return agg.macro_mean(p.drop("weight").join(same, ["source", "item"]), "correct", "item", "source", "story", "weight").withColumn("value", F.round("value", 6))


@query(
    f"""WITH {_PRED}, q AS (SELECT family, story, source, item, correct, max(weight) OVER (PARTITION BY source, item) AS weight FROM p), i AS (SELECT family, story, source, item, avg(correct) AS v, max(weight) AS w FROM q GROUP BY ALL),
s AS (SELECT family, story, source, sum(v * w) / sum(w) AS v FROM i GROUP BY ALL), t AS (SELECT family, story, avg(v) AS v, count(*) AS n FROM s GROUP BY ALL) SELECT family, count(*) AS stories, CAST(sum(n) AS BIGINT) AS sources, round(avg(v), 6) AS value FROM t GROUP BY family"""
)
def macro_mean_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per family."""
    p = _predictions(spark, sf_dir)
    same = p.groupBy("source", "item").agg(F.max("weight").alias("weight"))
    return agg.macro_mean(p.drop("weight").join(same, ["source", "item"]), "correct", "item", "source", "story", "weight", ["family"]).withColumn("value", F.round("value", 6))


@query(
    "SELECT unit_id, form, count(*) AS n, round(sum(weight), 6) AS weight FROM (SELECT m.unit_id, m.form, 1.0 / ((SELECT count(DISTINCT form) FROM d x WHERE x.unit_id = m.unit_id) * count(*) OVER (PARTITION BY m.unit_id, m.form)) AS weight FROM d m) GROUP BY ALL".replace(
        "SELECT unit_id, form", "WITH d AS (SELECT DISTINCT id, unit_id, form FROM mention WHERE form IS NOT NULL) SELECT unit_id, form", 1
    )
)
def family_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by family; each source's sum is 1."""
    m = table(spark, sf_dir, "mention").where("form IS NOT NULL").select("id", "unit_id", "form").distinct()
    return agg.family_weights(m, "unit_id", "form").groupBy("unit_id", "form").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    """WITH d AS (SELECT DISTINCT id, unit_id, story_id, form FROM mention WHERE form IS NOT NULL), s AS (SELECT story_id, count(DISTINCT unit_id) AS k FROM d GROUP BY story_id), m AS (SELECT unit_id, count(*) AS mass FROM d GROUP BY unit_id)
SELECT story_id, round(sum(100.0 / ((SELECT count(*) FROM s) * k * mass)), 6) AS weight FROM d JOIN s USING (story_id) JOIN m USING (unit_id) GROUP BY story_id"""
)
def objective_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 100 steps with equal stories, then equal sources."""
    m = table(spark, sf_dir, "mention").where("form IS NOT NULL").select("id", "unit_id", "story_id").distinct()
    units = m.groupBy("story_id", "unit_id").agg(F.count("*").alias("mass"))
    stories = units.groupBy("story_id").agg(F.count("*").alias("k"))
    weighted = m.join(units, ["story_id", "unit_id"]).join(stories, "story_id").crossJoin(stories.agg(F.count("*").alias("n_stories")))
    return weighted.groupBy("story_id").agg(F.round(F.sum(100 / (F.col("n_stories") * F.col("k") * F.col("mass"))), 6).alias("weight"))


@query(
    """WITH k AS (SELECT *, row_number() OVER (PARTITION BY unit_id, target ORDER BY recorded_utc, id, ingested_utc) AS r FROM mention WHERE target IS NOT NULL)
SELECT unit_id, target, id, (SELECT list_aggregate(list_sort(list(DISTINCT form)), 'string_agg', ',') FROM mention x WHERE x.unit_id = k.unit_id AND x.target = k.target) AS forms FROM k WHERE r = 1"""
)
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source and item, with all its forms."""
    m = table(spark, sf_dir, "mention").where("target IS NOT NULL").select("unit_id", "target", "id", "form", "recorded_utc", "ingested_utc")
    return agg.dedupe_first(m, ["unit_id", "target"], ["recorded_utc", "id", "ingested_utc"], "form").select("unit_id", "target", "id", F.array_join("form_all", ",").alias("forms"))


_VEC = "v AS (SELECT label, CAST(vec_id % 7 AS INTEGER) AS story, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), cell AS (SELECT label, story, i, avg(x) AS x FROM v GROUP BY ALL)"


@query(f"WITH {_VEC}, m AS (SELECT label, i, avg(x) AS x, count(*) AS stories FROM cell GROUP BY ALL HAVING count(*) >= 2) SELECT label, max(stories) AS stories, round(sum(x), 6) AS total, round(sqrt(sum(x * x)), 6) AS norm FROM m GROUP BY label")
def story_mean_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of equal-story means, here by sum and norm."""
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).cast("int").alias("story"), F.col("embedding").cast("array<double>").alias("v"))
    s = agg.story_means(e, "label", "story", "v", 2)
    total = F.aggregate("signature", F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("signature", F.lit(0.0), lambda a, x: a + x * x))
    return s.select("label", "stories", F.round(total, 6).alias("total"), F.round(norm, 6).alias("norm"))


@query("WITH d AS (SELECT DISTINCT user_id, event_type, value FROM events) SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM d GROUP BY event_type")
def distinct_value_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over exactly distinct values of a source and item."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value").distinct()
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("WITH q AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, count(*) AS n, round(avg(v), 4) AS mean FROM q GROUP BY event_type")
def two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over repeats, then over queries."""
    q = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return q.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"))


@query(
    """WITH a AS (SELECT DISTINCT form, target AS atom FROM mention WHERE support = 'explicit' AND target IS NOT NULL AND form IS NOT NULL), b AS (SELECT DISTINCT form, target AS atom FROM mention WHERE support = 'inferred' AND target IS NOT NULL AND form IS NOT NULL),
f AS (SELECT coalesce(a.form, b.form) AS form, a.atom AS x, b.atom AS y FROM a FULL JOIN b ON a.form = b.form AND a.atom = b.atom) SELECT form, count(x) AS n_first, count(y) AS n_second, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS shared, round(2.0 * count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) / nullif(count(x) + count(y), 0), 6) AS f1 FROM f GROUP BY form"""
)
def agreement_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetric F1 of two sets of atoms."""
    m = table(spark, sf_dir, "mention").where("target IS NOT NULL AND form IS NOT NULL").select("form", F.col("target").alias("atom"), "support")
    return agg.overlap_scores(m.where("support = 'explicit'"), m.where("support = 'inferred'"), "form", "atom").withColumn("f1", F.round("f1", 6))


@query(
    """WITH c AS (SELECT story_id, unnest(tr_centers_story_seconds) AS x FROM alignment)
SELECT story_id, count(x) AS n, round(avg(x) FILTER (WHERE isfinite(x)), 4) AS mean, round(stddev_pop(x) FILTER (WHERE isfinite(x)), 4) AS sd, min(x) FILTER (WHERE isfinite(x)) AS least, max(x) FILTER (WHERE isfinite(x)) AS most, count(*) FILTER (WHERE isnan(x)) AS nan, count(*) FILTER (WHERE isinf(x)) AS infinite, count(*) FILTER (WHERE x = 0) AS zero FROM c GROUP BY story_id"""
)
def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments, extremes and odd values."""
    c = table(spark, sf_dir, "alignment").select("story_id", F.explode("tr_centers_story_seconds").alias("x"))
    return agg.profile(c, "story_id", "x").withColumn("mean", F.round("mean", 4)).withColumn("sd", F.round("sd", 4))


@query(
    """WITH u AS (SELECT DISTINCT id, story_id, form, unit_id FROM mention WHERE form IS NOT NULL), n AS (SELECT form, count(*) FILTER (WHERE md5(story_id) < 'c') AS train, count(*) FILTER (WHERE md5(story_id) >= 'c') AS heldout FROM u GROUP BY form),
r AS (SELECT form, id, row_number() OVER (PARTITION BY form ORDER BY story_id, unit_id, id) AS k FROM u) SELECT form, train, heldout, (SELECT string_agg(id, ',' ORDER BY k) FROM r WHERE r.form = n.form AND k <= 3) AS examples FROM n"""
)
def label_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by split and the first three examples."""
    u = table(spark, sf_dir, "mention").where("form IS NOT NULL").select("id", "story_id", "form", "unit_id").distinct()
    counted = u.groupBy("form").agg(F.count_if(F.md5("story_id") < "c").alias("train"), F.count_if(F.md5("story_id") >= "c").alias("heldout"))
    ranked = u.withColumn("k", F.row_number().over(Window.partitionBy("form").orderBy("story_id", "unit_id", "id"))).where("k <= 3")
    first = ranked.groupBy("form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda s: s.id), ",").alias("examples"))
    return counted.join(first, "form").select("form", "train", "heldout", "examples")


@query(
    """WITH p AS (SELECT 'part/' || p_brand || '/' || p_type AS path, p_size AS bytes FROM part), e AS (SELECT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2), path]) AS prefix, bytes FROM p) SELECT prefix, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM e GROUP BY prefix"""
)
def path_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by every prefix of a path, by one rollup."""
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("a"), F.col("p_brand").alias("b"), F.col("p_type").alias("c"), F.col("p_size").alias("bytes"))
    rolled = p.rollup("a", "b", "c").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).where("a IS NOT NULL")
    return rolled.select(F.concat_ws("/", "a", "b", "c").alias("prefix"), "files", "bytes")


@query("SELECT o_orderpriority AS phase, o_orderstatus AS status, count(*) AS attempts, round(sum(o_totalprice), 2) AS seconds FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus))")
def runtime_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of attempts by phase and by phase and status, as grouping sets."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    return o.groupingSets([["phase"], ["phase", "status"]], "phase", "status").agg(F.count("*").alias("attempts"), F.round(F.sum("o_totalprice"), 2).alias("seconds"))


@query("SELECT story_id, form, count(DISTINCT id) AS queries, count(DISTINCT unit_id) AS sources FROM mention WHERE form IS NOT NULL GROUP BY ALL")
def distinct_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct queries and sources per story and family."""
    return table(spark, sf_dir, "mention").where("form IS NOT NULL").groupBy("story_id", "form").agg(F.countDistinct("id").alias("queries"), F.countDistinct("unit_id").alias("sources"))


@query(
    """WITH l AS (SELECT o_orderstatus AS fold, CAST(right(o_orderpriority, 1) = 'W' AS INTEGER) AS odd, o_orderpriority AS alpha, avg(o_totalprice) AS loss, count(*) AS w FROM orders GROUP BY ALL), m AS (SELECT alpha, sum(w * loss) / sum(w) AS loss FROM l GROUP BY alpha)
SELECT arg_min(alpha, struct_pack(loss := loss, alpha := alpha)) AS best, round(min(loss), 4) AS loss FROM m"""
)
def weighted_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of losses over folds and its first least argument."""
    losses = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("fold"), F.col("o_orderpriority").alias("alpha")).agg(F.avg("o_totalprice").alias("loss"), F.count("*").alias("w"))
    mean = losses.groupBy("alpha").agg((F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("loss"))
    return mean.agg(F.min_by("alpha", F.struct("loss", "alpha")).alias("best"), F.round(F.min("loss"), 4).alias("loss"))


@query("WITH e AS (SELECT story_id, unit_id, id, unnest(['pooled', 'scoped:' || support]) AS mode FROM mention WHERE support IS NOT NULL) SELECT mode, count(DISTINCT id) AS items, count(DISTINCT unit_id) AS sources, count(DISTINCT story_id) AS stories FROM e GROUP BY mode")
def support_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items, sources and stories, pooled and by scope."""
    e = table(spark, sf_dir, "mention").where("support IS NOT NULL").select("story_id", "unit_id", "id", F.explode(F.array(F.lit("pooled"), F.concat(F.lit("scoped:"), "support"))).alias("mode"))
    return e.groupBy("mode").agg(F.countDistinct("id").alias("items"), F.countDistinct("unit_id").alias("sources"), F.countDistinct("story_id").alias("stories"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
