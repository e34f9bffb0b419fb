"""Queries of features, statistics, geometry and linear algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import aggregates as agg
from loomspan.operators import annotation, clock, features, linalg, stats
from loomspan.plans.graphs import _GRAPH
from loomspan.plans.registry import Catalog
from loomspan.session import kept, table
from loomspan.streaming.history import shared_folder

catalog = Catalog()
query = catalog.query

#: Stories whose digest is below are for training: three quarters of them, at any number of stories.
TRAIN = "c"

# --- features ---------------------------------------------------------------------------------------------------------

_EMIT = (
    _GRAPH
    + """, um AS (SELECT DISTINCT id, unit_id, target, form, support FROM mention), pos AS (SELECT DISTINCT event, place, role, target, support FROM ar),
ec AS (SELECT DISTINCT id, concept FROM en WHERE concept IS NOT NULL), ep AS (SELECT DISTINCT id, predicate, unit_id FROM ev), nm AS (SELECT p.unit_id, a.event, p.predicate, a.role, c.concept, m.form, coalesce(a.support <> 'unresolved', true) AND coalesce(m.support <> 'unresolved', true) AS ok FROM (SELECT DISTINCT event, place, role, target, support, mention FROM ar) a JOIN ec c ON c.id = a.target JOIN ep p ON p.id = a.event JOIN (SELECT DISTINCT id, form, support FROM mention) m ON m.id = a.mention),
ab AS (SELECT p.unit_id, a.event, p.predicate, a.role, c.concept, coalesce(a.support <> 'unresolved', true) AS ok FROM pos a JOIN ec c ON c.id = a.target JOIN ep p ON p.id = a.event),
f AS (SELECT unit_id, 'C' AS grp, [concept] AS parts, coalesce(support <> 'unresolved', true) AS ok FROM um JOIN ec ON ec.id = um.target
UNION ALL SELECT unit_id, 'R', [coalesce(type, '')], coalesce(support <> 'unresolved', true) FROM (SELECT DISTINCT id, unit_id, type, source, target, contexts, support FROM relation)
UNION ALL SELECT unit_id, 'B', [coalesce(role, ''), concept], ok FROM ab UNION ALL SELECT unit_id, 'PB', [coalesce(predicate, ''), coalesce(role, ''), concept], ok FROM ab
UNION ALL SELECT unit_id, 'BC', unnest([['predicate', coalesce(predicate, '')], ['role', coalesce(role, '')], ['filler', concept]]), ok FROM ab
UNION ALL SELECT unit_id, 'D', [coalesce(polarity, ''), coalesce(tense, '')], true FROM (SELECT DISTINCT unit_id, id, predicate, polarity, tense, contexts FROM ev)
UNION ALL SELECT unit_id, 'S', [coalesce(kind, '')], coalesce(support <> 'unresolved', true) FROM (SELECT DISTINCT id, unit_id, kind, holder, parents, support FROM context)
UNION ALL SELECT unit_id, 'U', [coalesce(form, '')], true FROM um WHERE target IS NULL
UNION ALL SELECT unit_id, 'L', [md5(coalesce(quote, '')), coalesce(form, '')], true FROM (SELECT DISTINCT id, unit_id, target, form, support, evidence.quote AS quote FROM mention)
UNION ALL SELECT unit_id, 'BR', [coalesce(role, ''), concept, coalesce(form, '')], ok FROM nm UNION ALL SELECT unit_id, 'PBR', [coalesce(predicate, ''), coalesce(role, ''), concept, coalesce(form, '')], ok FROM nm
UNION ALL SELECT unit_id, 'GB', [string_agg(DISTINCT coalesce(role, '') || '/' || concept, ';' ORDER BY coalesce(role, '') || '/' || concept)], true FROM ab WHERE ok GROUP BY unit_id, event
UNION ALL SELECT unit_id, 'GBR', [string_agg(DISTINCT coalesce(role, '') || '/' || concept || '/' || coalesce(form, ''), ';' ORDER BY coalesce(role, '') || '/' || concept || '/' || coalesce(form, ''))], true FROM nm WHERE ok GROUP BY unit_id, event)"""
)


def _emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.emit(annotation.graph_view(spark, sf_dir))


@query(_EMIT + """ SELECT unit_id, grp AS "group", sha256('{"group":"' || grp || '","parts":["' || array_to_string(parts, '","') || '"]}') AS feature, count(*) AS n FROM f WHERE ok GROUP BY ALL""")
def unit_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature counts of every unit."""
    return features.feature_counts(_emitted(spark, sf_dir)).select("unit_id", "group", "feature", "n")


@query(_EMIT + """ SELECT DISTINCT unit_id, grp AS "group" FROM f WHERE NOT ok""")
def uncertain_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a withheld incidence masks."""
    return features.uncertain_groups(_emitted(spark, sf_dir))


@query(_EMIT + """, b AS (SELECT DISTINCT unit_id, grp FROM f WHERE NOT ok AND grp IN ('C', 'PB')) SELECT unit_id, unit_id NOT IN (SELECT unit_id FROM b WHERE grp = 'C') AS "C", unit_id NOT IN (SELECT unit_id FROM b WHERE grp = 'PB') AS "PB", unit_id NOT IN (SELECT unit_id FROM b) AS usable FROM (SELECT DISTINCT unit_id FROM f)""")
def group_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usable units by group and for a declared set of groups."""
    e = _emitted(spark, sf_dir)
    return features.group_masks(e, features.uncertain_groups(e), ["C", "PB"])


@query(
    _EMIT
    + """, m AS (SELECT parts[2] AS predicate, count(*) AS marginal FROM f WHERE grp = 'BC' AND ok AND parts[1] = 'predicate' GROUP BY 1) SELECT predicate, marginal, marginal AS direct FROM m"""
)
def marginal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metamorphic: a predicate's marginal is as often there as its events have a resolved argument whose filler has a concept, counted straight from the graph."""
    view = annotation.graph_view(spark, sf_dir)
    e = features.emit(view).where("included AND group = 'BC'").where(F.col("parts")[0] == "predicate").groupBy(F.col("parts")[1].alias("predicate")).agg(F.count("*").alias("marginal"))
    concepts = view.entities.where("concept IS NOT NULL").select(F.col("id").alias("target"), "concept").distinct().groupBy("target").agg(F.count("*").alias("c"))
    named = view.events.select(F.col("id").alias("event"), "predicate").distinct()
    direct = view.arguments.where(annotation.resolved()).join(concepts, "target").join(named, "event").groupBy(F.coalesce("predicate", F.lit("")).alias("predicate")).agg(F.sum("c").alias("direct"))
    return e.join(direct, "predicate", "full")


@query(
    _EMIT
    + """, k AS (SELECT unit_id, sha256('{"group":"' || grp || '","parts":["' || array_to_string(parts, '","') || '"]}') AS feature, count(*) AS n FROM f WHERE ok GROUP BY ALL),
v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS c FROM (SELECT feature FROM k WHERE md5(regexp_extract(unit_id, '^(.*)_u[0-9]+$', 1)) < 'c' GROUP BY feature HAVING count(DISTINCT unit_id) >= 3))
SELECT unit_id, coalesce(string_agg(c || ':' || n, ' ' ORDER BY c) FILTER (WHERE c IS NOT NULL), '') AS terms FROM k LEFT JOIN v USING (feature) GROUP BY unit_id"""
)
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse rows over a vocabulary of training stories only."""
    counts = kept(features.feature_counts(_emitted(spark, sf_dir)))
    vocab = features.fit_vocabulary(counts, counts.where(F.md5(F.regexp_extract("unit_id", "^(.*)_u[0-9]+$", 1)) < TRAIN), 3)
    rows = features.transform(counts, vocab)
    return rows.select("unit_id", F.array_join(F.transform(F.map_entries("terms"), lambda e: F.concat_ws(":", e.key.cast("string"), e.value.cast("string"))), " ").alias("terms"))


@query(
    _EMIT
    + """, k AS (SELECT unit_id, sha256('{"group":"' || grp || '","parts":["' || array_to_string(parts, '","') || '"]}') AS feature, count(*) AS n FROM f WHERE ok GROUP BY ALL),
v AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS c FROM (SELECT feature FROM k WHERE md5(regexp_extract(unit_id, '^(.*)_u[0-9]+$', 1)) < 'c' GROUP BY feature HAVING count(DISTINCT unit_id) >= 3)),
sl AS (SELECT DISTINCT id AS unit_id, story_id, raw_feature_bin AS slot FROM source_record WHERE raw_feature_bin >= 0), b AS (SELECT story_id, slot, c, sum(n) AS x FROM k JOIN v USING (feature) JOIN sl USING (unit_id) GROUP BY ALL), me AS (SELECT DISTINCT story_id, unnest(response_raw_indices) AS r FROM alignment)
SELECT b.story_id, CAST(slot + d AS INTEGER) AS "row", d AS delay, count(*) AS columns, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * (c % 97)) AS BIGINT) AS mixed FROM b, (SELECT unnest([1, 2, 3, 4]) AS d) JOIN me ON me.story_id = b.story_id AND me.r = slot + d GROUP BY ALL"""
)
def semantic_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts to vocabulary to bins to delayed measured rows, here summed by row and delay."""
    counts = kept(features.feature_counts(_emitted(spark, sf_dir)))
    vocab = features.fit_vocabulary(counts, counts.where(F.md5(F.regexp_extract("unit_id", "^(.*)_u[0-9]+$", 1)) < TRAIN), 3)
    slots = table(spark, sf_dir, "source_record").select(F.col("id").alias("unit_id"), "story_id", F.col("raw_feature_bin").alias("slot"))
    measured = table(spark, sf_dir, "alignment").select("story_id", F.explode("response_raw_indices").alias("row")).distinct()
    rows = features.design(counts.drop("story_id"), vocab, slots, "story_id", [1, 2, 3, 4], measured)
    return rows.groupBy("story_id", "row", "delay").agg(F.count("*").alias("columns"), F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("column") % 97)).alias("mixed"))


@query("WITH m AS (SELECT DISTINCT id, unit_id, target, form, evidence.start_token AS s FROM mention WHERE target IS NOT NULL) SELECT target, count(*) AS n, arg_min(id, struct_pack(u := CAST(regexp_extract(unit_id, '_u([0-9]+)$', 1) AS INTEGER), s := coalesce(s, -1), i := id)) AS first FROM m GROUP BY target")
def reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mentions of every record, here their number and first."""
    index = features.reference_index(annotation.graph_view(spark, sf_dir))
    return index.groupBy("target").agg(F.count("*").alias("n"), F.min_by("id", "place").alias("first"))


@query(
    "WITH m AS (SELECT DISTINCT id, target, support, evidence FROM mention), s AS (SELECT 'unresolved' AS reason, id FROM m WHERE target IS NULL UNION ALL SELECT 'unanchored', id FROM m WHERE evidence.verbatim IS NULL UNION ALL SELECT 'inferred', id FROM m WHERE support = 'inferred') SELECT id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM s GROUP BY id"
)
def review_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records to review, each with all reasons."""
    m = table(spark, sf_dir, "mention")
    chosen = features.selected_for_review({"unresolved": m.where("target IS NULL"), "unanchored": m.where("evidence.verbatim IS NULL"), "inferred": m.where("support = 'inferred'")}, "id")
    return chosen.select("id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "WITH o AS (SELECT DISTINCT id, unit_id, form, support FROM mention) SELECT o.id, count(q.id) AS n FROM o LEFT JOIN o q ON q.unit_id IS NOT DISTINCT FROM o.unit_id AND q.form IS NOT DISTINCT FROM o.form AND q.support IS NOT DISTINCT FROM o.support GROUP BY o.id"
)
def attached_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences linked to queries by the digest of what they ask."""
    m = table(spark, sf_dir, "mention").select("id", "unit_id", "form", "support").distinct()
    asked = m.withColumnRenamed("id", "query_id")
    return features.attach_queries(m, asked, ["unit_id", "form", "support"]).select("id", F.size("query_ids").cast("long").alias("n"))


# --- statistics -------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation per group, null without spread."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(stats.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query(
    """WITH r AS (SELECT c_mktsegment AS segment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS x, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS y FROM customer)
SELECT segment, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY segment"""
)
def spearman_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: rank correlation with averaged ties."""
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), "c_nationkey", "c_acctbal")
    return stats.spearman(c, ["segment"], "c_nationkey", "c_acctbal").withColumn("rho", F.round("rho", 6))


_SIG = "v AS (SELECT label, CAST(vec_id % 7 AS INTEGER) AS story, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), cell AS (SELECT label, story, i, avg(x) AS x FROM v GROUP BY ALL), m AS (SELECT label, i, avg(x) AS x FROM cell GROUP BY ALL HAVING count(*) >= 2)"
_RDM = _SIG + ", norm AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label), rdm AS (SELECT a.label AS item_i, b.label AS item_j, greatest(0, least(2, 1 - sum(a.x * b.x) / max(na.n * nb.n))) AS d FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN norm na ON na.label = a.label JOIN norm nb ON nb.label = b.label GROUP BY ALL)"


def _signatures(spark: SparkSession, sf_dir: str, half: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7).cast("int").alias("story"), F.col("embedding").cast("array<double>").alias("v"))
    e = e if half is None else e.where(F.col("story") % 2 == half)
    return agg.story_means(e, "label", "story", "v", 2 if half is None else 1)


@query(f"WITH {_RDM} SELECT item_i, item_j, round(d, 6) AS d FROM rdm")
def cosine_rdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dissimilarities of the items' equal-story signatures."""
    return stats.cosine_rdm(_signatures(spark, sf_dir), "label", "signature").withColumn("d", F.round("d", 6))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.cosine_rdm(_signatures(spark, sf_dir, 0), "label", "signature").withColumnRenamed("d", "a")
    b = stats.cosine_rdm(_signatures(spark, sf_dir, 1), "label", "signature").withColumnRenamed("d", "b")
    return a.join(b, ["item_i", "item_j"]).withColumn("panel", F.lit("halves"))


_HALF = "v AS (SELECT label, CAST(vec_id % 7 AS INTEGER) AS story, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), cell AS (SELECT label, story, i, avg(x) AS x FROM v GROUP BY ALL), m AS (SELECT story % 2 AS h, label, i, avg(x) AS x FROM cell GROUP BY ALL), norm AS (SELECT h, label, sqrt(sum(x * x)) AS n FROM m GROUP BY ALL), rdm AS (SELECT a.h, a.label AS p, b.label AS q, 1 - sum(a.x * b.x) / max(na.n * nb.n) AS d FROM m a JOIN m b ON a.i = b.i AND a.h = b.h AND a.label < b.label JOIN norm na ON na.label = a.label AND na.h = a.h JOIN norm nb ON nb.label = b.label AND nb.h = b.h GROUP BY ALL), j AS (SELECT x.p, x.q, x.d AS a, y.d AS b FROM rdm x JOIN rdm y USING (p, q) WHERE x.h = 0 AND y.h = 1)"


@query(f"WITH {_HALF}, r AS (SELECT rank() OVER (ORDER BY a) AS x, rank() OVER (ORDER BY b) AS y FROM j) SELECT 'halves' AS panel, count(*) AS n, round(corr(x, y), 5) AS rho FROM r")
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the dissimilarities of alternate stories."""
    return stats.spearman(_halves(spark, sf_dir), ["panel"], "a", "b").withColumn("rho", F.round("rho", 5))


@query()
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label permutation of the two halves' dissimilarities; random, so against numpy in the tests."""
    return stats.permutation_p(_halves(spark, sf_dir), "panel", 999)


@query("WITH s AS (SELECT DISTINCT o_custkey AS source, l_suppkey % 12 AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT item, count(*) AS n FROM s GROUP BY item) SELECT a.item AS item_i, b.item AS item_j, round(count(*) / sqrt(max(na.n) * max(nb.n)), 6) AS cosine FROM s a JOIN s b ON a.source = b.source AND a.item < b.item JOIN n na ON na.item = a.item JOIN n nb ON nb.item = b.item GROUP BY ALL")
def cooccurrence_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the sets of sources of two items."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("source"))
    s = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("source", (F.col("l_suppkey") % 12).alias("item")).distinct()
    n = s.groupBy("item").agg(F.count("*").alias("n"))
    lists = s.groupBy("source").agg(F.array_sort(F.collect_list("item")).alias("items"))
    pairs = lists.select(F.posexplode("items").alias("k", "item_i"), "items").select("item_i", F.explode(F.slice("items", F.col("k") + 2, F.size("items"))).alias("item_j"))
    shared = pairs.groupBy("item_i", "item_j").agg(F.count("*").alias("c"))
    sized = shared.join(n.select(F.col("item").alias("item_i"), F.col("n").alias("a")), "item_i").join(n.select(F.col("item").alias("item_j"), F.col("n").alias("b")), "item_j")
    return sized.select("item_i", "item_j", F.round(F.col("c") / F.sqrt(F.col("a") * F.col("b")), 6).alias("cosine"))


@query("WITH c AS (SELECT event_type AS contrast, user_id % 8 AS subject, CAST(event_id % 5 AS INTEGER) AS story, avg(value) AS v FROM events GROUP BY ALL) SELECT contrast, CASE WHEN count(*) = count(DISTINCT subject) * count(DISTINCT story) THEN round(avg(v), 4) END AS mean, CAST(count(DISTINCT subject) AS INTEGER) AS subjects, CAST(count(DISTINCT story) AS INTEGER) AS stories, count(*) = count(DISTINCT subject) * count(DISTINCT story) AS available FROM c GROUP BY contrast")
def crossed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a complete panel of subjects and stories; its interval is random and tested against numpy."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("contrast"), (F.col("user_id") % 8).alias("subject"), (F.col("event_id") % 5).alias("story"), "value")
    return stats.crossed_interval(e, "contrast", "subject", "story", "value", 200).select("contrast", F.round("mean", 4).alias("mean"), "subjects", "stories", "available")


@query()
def crossed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the interval."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("contrast"), (F.col("user_id") % 8).alias("subject"), (F.col("event_id") % 5).alias("story"), "value")
    return stats.crossed_interval(e, "contrast", "subject", "story", "value", 1000)


@query(
    """WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l, [label % 8, (label + 3) % 8] AS acc FROM embeddings), t AS (SELECT *, list_aggregate(l, 'max') AS top FROM p), s AS (SELECT *, list_aggregate(list_transform(l, lambda x: exp(x - top)), 'sum') AS z, list_aggregate(list_transform(acc, lambda i: exp(l[i + 1] - top)), 'sum') AS za, list_position(l, top) - 1 AS best FROM t)
SELECT vec_id, round(len(acc) / len(l), 6) AS chance, CAST(CAST(list_contains(acc, best) AS INTEGER) AS DOUBLE) AS correct, round(ln(z) - ln(za), 5) AS nll FROM s"""
)
def evaluate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, negative log likelihood and chance from logits."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("logits"), F.array(F.col("label") % 8, (F.col("label") + 3) % 8).alias("acceptable"))
    return stats.evaluate_predictions(p).select("vec_id", F.round("chance", 6).alias("chance"), "correct", F.round("nll", 5).alias("nll"))


@query("SELECT p_brand, p_size, round(exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY p_brand), 6) AS p FROM (SELECT p_brand, p_size, s, max(s) OVER (PARTITION BY p_brand) AS mx FROM (SELECT p_brand, p_size, max(p_retailprice) / 100.0 AS s FROM part GROUP BY ALL))")
def softmax_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: probabilities of the logits of a group."""
    s = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg((F.max("p_retailprice") / 100).alias("s"))
    return stats.softmax(s, ["p_brand"], "s").select("p_brand", "p_size", F.round("p", 6).alias("p"))


@query(
    """WITH c AS (SELECT form AS family, support AS candidate, count(*) + 1.0 AS c FROM mention WHERE form IS NOT NULL AND support IS NOT NULL AND md5(story_id) < 'c' GROUP BY ALL)
SELECT family, arg_max(candidate, struct_pack(c := c, k := candidate)) AS best, round(max(c) / sum(c), 6) AS p FROM c GROUP BY family"""
)
def query_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior answer of each family from training stories."""
    m = table(spark, sf_dir, "mention").where("form IS NOT NULL AND support IS NOT NULL").select("story_id", F.col("form").alias("family"), F.col("support").alias("candidate"))
    return stats.query_prior(m.where(F.md5("story_id") < TRAIN), m, "family", "candidate").withColumn("p", F.round("p", 6))


@query("WITH s AS (SELECT l_orderkey AS item, l_linenumber AS site, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey FROM lineitem)), a AS (SELECT item, sum(v) AS full_, sum(v) FILTER (WHERE k > 1) AS rest, avg(v) FILTER (WHERE k > 1) AS mean FROM s GROUP BY item) SELECT item, round(full_, 3) AS \"full\", round(coalesce(rest, 0) + coalesce(mean, 0), 3) AS replaced, round(full_ - (coalesce(rest, 0) + coalesce(mean, 0)), 3) AS \"drop\" FROM a")
def site_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop of a score when its strongest site is replaced by the mean of the others."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("site"), F.col("l_quantity").alias("v"))
    return stats.site_replacement(s, "item", "site", "v").select("item", *[F.round(c, 3).alias(c) for c in ("full", "replaced", "drop")])


@query("WITH s AS (SELECT l_orderkey AS item, l_linenumber AS site, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_orderkey || '/' || l_linenumber), l_linenumber, l_quantity DESC) AS k FROM lineitem), a AS (SELECT item, sum(v) AS full_, sum(v) FILTER (WHERE k > 1) AS rest, avg(v) FILTER (WHERE k > 1) AS mean FROM s GROUP BY item) SELECT item, round(full_, 3) AS \"full\", round(coalesce(rest, 0) + coalesce(mean, 0), 3) AS replaced, round(full_ - (coalesce(rest, 0) + coalesce(mean, 0)), 3) AS \"drop\" FROM a")
def random_site_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control of site_replacement: as many sites, but drawn by hash."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("site"), F.col("l_quantity").alias("v"))
    drawn = F.md5(F.concat_ws("/", F.col("item").cast("string"), F.col("site").cast("string")))
    return stats.site_replacement(s, "item", "site", "v", order=[drawn, F.col("site"), F.desc("v")]).select("item", *[F.round(c, 3).alias(c) for c in ("full", "replaced", "drop")])


@query("SELECT event_type, round(quantile_cont(value, 0.025), 4) AS low, round(quantile_cont(value, 0.975), 4) AS high, round(median(value), 4) AS mid FROM events GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: exact linear quantiles."""
    found = stats.quantiles(table(spark, sf_dir, "events"), "event_type", "value", {"low": 0.025, "high": 0.975, "mid": 0.5})
    return found.select("event_type", *[F.round(n, 4).alias(n) for n in ("low", "high", "mid")])


@query("WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem GROUP BY 1) SELECT l_returnflag, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS r FROM c")
def partial_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: correlation of two columns without what a third explains."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("a"), F.corr("l_quantity", "l_discount").alias("b"), F.corr("l_extendedprice", "l_discount").alias("c"))
    r = (F.col("a") - F.col("b") * F.col("c")) / F.sqrt((1 - F.col("b") ** 2) * (1 - F.col("c") ** 2))
    return c.select("l_returnflag", F.round(r, 6).alias("r"))


@query(
    """WITH a AS (SELECT o_orderkey % 4 AS fold, o_orderpriority AS cond, avg(o_totalprice) AS v, count(*) AS n, sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT)) AS h FROM orders GROUP BY ALL), b AS (SELECT o_orderkey % 4 AS fold, o_orderpriority AS cond, avg(o_totalprice) AS v, count(*) AS n, sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT)) AS h FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT fold, cond, round(a.v - b.v, 3) AS difference, a.n = b.n AND a.h = b.h AS matched FROM a JOIN b USING (fold, cond)"""
)
def paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired differences with a check that both sides rest on the same rows, by a digest of their keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("fold"), F.col("o_orderpriority").alias("cond"), "o_totalprice", "o_orderstatus")
    return stats.paired(o, o.where("o_orderstatus <> 'P'"), ["fold", "cond"], "o_orderkey", "o_totalprice").withColumn("difference", F.round("difference", 3))


# --- linear algebra ---------------------------------------------------------------------------------------------------


_LONG = "WITH x AS (SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(_LONG + " SELECT a.label, a.i, b.i AS j, round(sum(a.x * b.x), 6) AS s, count(*) AS n FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products by group, of all coordinates."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return linalg.gram(e, "label", "v").withColumn("s", F.round("s", 6))


@query(
    _LONG
    + """, f AS (SELECT label, i, avg(x) AS m, stddev_pop(x) AS s FROM x WHERE vec_id % 5 > 0 GROUP BY ALL HAVING stddev_pop(x) > 1e-8), k AS (SELECT label, count(*) AS k FROM f GROUP BY 1)
SELECT vec_id, i, round((x - m) / s / sqrt(k), 5) AS z FROM x JOIN f USING (label, i) JOIN k USING (label)"""
)
def group_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaling by training rows, equal variance per group, of all coordinates."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5 > 0).alias("train"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return linalg.group_scaled(long, "train", "label", "i", "x").select("vec_id", "i", F.round("z", 5).alias("z"))


@query()
def local_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components per group from merged moments; against numpy in the tests."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return linalg.principal_components(linalg.story_moments(e, "label", "v"), 3)


@query(
    """WITH g AS (SELECT l_returnflag AS by_, l_orderkey % 4 AS fold, l_quantity AS x, l_extendedprice / 1000.0 AS y FROM lineitem), s AS (SELECT by_, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM g GROUP BY 1) SELECT by_ AS l_returnflag, round(sxy / (sxx + 10.0), 6) AS slope, round(my - mx * sxy / (sxx + 10.0), 5) AS intercept FROM s"""
)
def ridge_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression on one feature, one penalty."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 4).alias("fold"), F.array("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fit = linalg.ridge(li, "l_returnflag", "x", "y", [10.0], "fold")
    return fit.select("l_returnflag", F.round(F.col("weights")[0], 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query()
def ridge_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Penalty chosen over folds by the closed-form loss; against direct fits in the tests."""
    e = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("panel"), (F.col("vec_id") % 5).alias("fold"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return linalg.ridge(e, "panel", "x", "y", [0.1, 1.0, 10.0, 100.0], "fold")


#: Mixtures of two feature groups, and penalties.
MIXTURES, PENALTIES = [[1.0, 1.0], [0.25, 4.0]], [1.0, 100.0]
_ENCODED = (
    "WITH g AS (SELECT l_returnflag AS f, l_orderkey % 4 AS fold, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) * 100 AS z, l_extendedprice / 1000.0 AS y FROM lineitem), grid AS (SELECT * FROM (VALUES (0, 1.0, 1.0), (1, 0.25, 4.0)) m(mixture, wx, wz), (VALUES (1.0), (100.0)) a(alpha)), "
    "s AS (SELECT a.f, k.fold, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy FROM g a, (SELECT unnest([-1, 0, 1, 2, 3]) AS fold) k WHERE a.fold <> k.fold GROUP BY ALL), "
    "c AS (SELECT s.*, mixture, alpha, wx * xx + alpha AS a, sqrt(wx * wz) * xz AS b, wz * zz + alpha AS d, sqrt(wx) * xy AS p, sqrt(wz) * zy AS q, wx, wz FROM s, grid), "
    "w AS (SELECT f, fold, mixture, alpha, sqrt(wx) * (p * d - b * q) / (a * d - b * b) AS w1, sqrt(wz) * (a * q - b * p) / (a * d - b * b) AS w2, mx, mz, my FROM c), "
    "l AS (SELECT g.f, mixture, alpha, avg((y - my - w1 * (x - mx) - w2 * (z - mz)) ** 2) AS loss FROM g JOIN w ON w.f = g.f AND w.fold = g.fold GROUP BY ALL)"
)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("f"), (F.col("l_orderkey") % 4).alias("fold"), F.array(F.col("l_quantity").cast("double")).alias("a"), F.array(F.col("l_discount").cast("double") * 100).alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))


@query(_ENCODED + " SELECT w.f, w.mixture, CAST(w.alpha AS DOUBLE) AS alpha, round(l.loss, 4) AS loss, round(w1, 6) AS first, round(w2, 6) AS second, round(my - w1 * mx - w2 * mz, 4) AS intercept FROM w JOIN l ON l.f = w.f AND l.mixture = w.mixture AND l.alpha = w.alpha WHERE w.fold = -1")
def group_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of features in two mixtures with two penalties: weights, and losses over folds in closed form."""
    grid = linalg.encoding_grid(linalg.fold_sums(_encoded(spark, sf_dir), "f", "fold", ["a", "b"], "y"), MIXTURES, PENALTIES)
    w = F.col("weights")
    return grid.select(F.col("by").alias("f"), "mixture", "alpha", F.round("loss", 4).alias("loss"), F.round(w[0], 6).alias("first"), F.round(w[1], 6).alias("second"), F.round("intercept", 4).alias("intercept"))


@query(
    _ENCODED
    + """, best AS (SELECT f, arg_min(mixture, struct_pack(l := loss, m := mixture, a := alpha)) AS mixture, arg_min(alpha, struct_pack(l := loss, m := mixture, a := alpha)) AS alpha FROM l GROUP BY f)
SELECT g.f, count(*) AS n, round(avg((y - my - w1 * (x - mx) - w2 * (z - mz)) ** 2), 4) AS mse, round(corr(y, my + w1 * (x - mx) + w2 * (z - mz)), 6) AS r FROM g JOIN best ON best.f = g.f JOIN w ON w.f = g.f AND w.fold = g.fold AND w.mixture = best.mixture AND w.alpha = best.alpha GROUP BY g.f"""
)
def held_out_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every row by the fit without its fold, after the fits were saved and loaded."""
    rows = kept(_encoded(spark, sf_dir))
    sums = linalg.fold_sums(rows, "f", "fold", ["a", "b"], "y")
    chosen = linalg.selected_encoding(linalg.encoding_grid(sums, MIXTURES, PENALTIES))
    root = shared_folder(spark, "fits")
    linalg.save_fit(root, {"held_out": linalg.held_out_fits(sums, chosen, MIXTURES), "selected": chosen}, {"penalties": PENALTIES, "mixtures": MIXTURES})
    out = linalg.predicted(rows, linalg.load_fit(spark, root, "held_out"), {"f": "by", "fold": "fold"}, ["a", "b"])
    error = F.col("y") - F.col("predicted")
    return out.groupBy("f").agg(F.count("*").alias("n"), F.round(F.avg(error * error), 4).alias("mse"), F.round(F.corr("y", "predicted"), 6).alias("r"))


@query("WITH n AS (SELECT o_custkey AS story, count(*) AS n FROM orders GROUP BY 1) SELECT story, round(sqrt((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n)), 6) AS scale FROM n")
def validation_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row scale that gives every story the same weight."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("story")).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return n.crossJoin(whole).select("story", F.round(F.sqrt(F.col("t") / (F.col("k") * F.col("n"))), 6).alias("scale"))


@query(
    """WITH p AS (SELECT story_id, r AS "row", avg(c) AS x FROM (SELECT story_id, unnest(response_raw_indices) AS r, unnest(tr_centers_story_seconds) AS c FROM (SELECT DISTINCT story_id, segment, response_raw_indices, tr_centers_story_seconds FROM alignment)) WHERE isfinite(c) GROUP BY ALL), u AS (SELECT DISTINCT id, story_id, raw_feature_bin AS slot FROM source_record WHERE raw_feature_bin >= 0)
SELECT u.id, round(avg(x), 7) AS v FROM u JOIN p ON p.story_id = u.story_id AND p."row" BETWEEN slot + 1 AND slot + 4 GROUP BY u.id HAVING count(*) = 4"""
)
def implied_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the predictions at the delayed rows of every unit, where all of them are there."""
    z = F.explode(F.arrays_zip(F.col("response_raw_indices").alias("row"), F.col("tr_centers_story_seconds").alias("x"))).alias("z")
    a = table(spark, sf_dir, "alignment").select("story_id", "segment", "response_raw_indices", "tr_centers_story_seconds").distinct()
    predicted = a.select("story_id", z).select("story_id", "z.row", "z.x").where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))).groupBy("story_id", "row").agg(F.avg("x").alias("x"))
    units = table(spark, sf_dir, "source_record").select("id", "story_id", F.col("raw_feature_bin").alias("slot")).distinct()
    return clock.delayed_means(units, "id", "story_id", "slot", [1, 2, 3, 4], predicted, "x").select("id", F.round("x", 7).alias("v"))


@query("WITH t AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY ALL), s AS (SELECT *, sum(v) OVER (PARTITION BY event_type) AS total, count(*) OVER (PARTITION BY event_type) AS n FROM t) SELECT event_type, user_id, round(v - (total - v) / (n - 1), 4) AS against_others FROM s")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each against the mean of the others."""
    w = Window.partitionBy("event_type")
    t = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    return t.select("event_type", "user_id", F.round(F.col("v") - (F.sum("v").over(w) - F.col("v")) / (F.count("*").over(w) - 1), 4).alias("against_others"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
