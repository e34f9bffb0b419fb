"""Queries that join, rank, sort and compare sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import relate
from loomspan.operators.aggregates import numbered
from loomspan.plans.registry import Catalog
from loomspan.session import table

catalog = Catalog()
query = catalog.query

# --- scans, predicates, projections -----------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN starts_with(p_name, 'small') THEN 'core' WHEN p_name LIKE '%ring' OR lower(p_type) = 'economy' THEN 'extended' ELSE 'none' END AS profile FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') AND l_quantity > 45")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned scan, filter with a list, profile by ordered rules."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 45))
    profile = F.when(F.startswith("p_name", F.lit("small")), "core").when(F.endswith("p_name", F.lit("ring")) | (F.lower("p_type") == "economy"), "extended").otherwise("none")
    return lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_quantity", profile.alias("profile"))


@query("SELECT id, support FROM (SELECT DISTINCT id, support, evidence FROM relation) WHERE coalesce(evidence.verbatim IS NOT NULL, true) AND coalesce(support, 'explicit') <> 'inferred'")
def grounded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe filter on grounding and support."""
    r = table(spark, sf_dir, "relation").select("id", "support", "evidence").distinct()
    return r.where(F.col("evidence.verbatim").isNotNull() & (F.coalesce("support", F.lit("explicit")) != "inferred")).select("id", "support")


@query("SELECT e.user_id, count(*) AS n FROM events e WHERE e.event_type = 'error' AND EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 100) GROUP BY e.user_id")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for which another table has a fitting one."""
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'error'").join(e.where("event_type = 'purchase' AND value > 100").select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a fitting one."""
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(pending, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT id, coalesce(CASE form WHEN 'pronoun' THEN 'reference' WHEN 'name' THEN 'naming' END, form) AS canonical FROM (SELECT DISTINCT id, form FROM mention)")
def alias_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names replaced by their canonical ones through a small table, others kept."""
    aliases = spark.createDataFrame([("pronoun", "reference"), ("name", "naming")], "form string, canonical string")
    m = table(spark, sf_dir, "mention").select("id", "form").distinct()
    return m.join(F.broadcast(aliases), "form", "left").select("id", F.coalesce("canonical", "form").alias("canonical"))


@query("SELECT id, CASE type WHEN 'after' THEN 'before' ELSE type END AS type, CASE type WHEN 'after' THEN target ELSE source END AS source, CASE type WHEN 'after' THEN source ELSE target END AS target FROM (SELECT DISTINCT id, type, source, target FROM relation)")
def relation_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical relation types, with the ends reversed where the type is."""
    r = table(spark, sf_dir, "relation").select("id", "type", "source", "target").distinct()
    back = F.coalesce(F.col("type") == "after", F.lit(False))
    return r.select("id", F.when(back, "before").otherwise(F.col("type")).alias("type"), F.when(back, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("target"))


@query("WITH m AS (SELECT DISTINCT id, form, support FROM mention) SELECT id, coalesce(form IS NOT DISTINCT FROM 'pronoun' AND support IS NOT DISTINCT FROM 'explicit', false) AS fits FROM m")
def subset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: whether every entry of a label equals the description's; null is a value."""
    label = F.create_map(F.lit("form"), F.lit("pronoun"), F.lit("support"), F.lit("explicit"))
    described = F.create_map(F.lit("form"), F.col("form"), F.lit("support"), F.col("support"))
    m = table(spark, sf_dir, "mention").select("id", "form", "support").distinct()
    return m.select("id", F.forall(F.map_entries(label), lambda e: F.try_element_at(described, e.key).eqNullSafe(e.value)).alias("fits"))


@query("SELECT id, lower(trim(evidence.quote)) AS quote FROM (SELECT DISTINCT id, form, evidence FROM mention) WHERE form = 'pronoun' AND lower(trim(evidence.quote)) NOT IN ('he','she','it','they','him','her','them','i','we','us','you','me')")
def suspicious_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pronoun mentions whose quote is no pronoun."""
    m = table(spark, sf_dir, "mention").select("id", "form", "evidence").distinct().where("form = 'pronoun'")
    quote = F.lower(F.trim("evidence.quote"))
    return m.where(~quote.isin("he", "she", "it", "they", "him", "her", "them", "i", "we", "us", "you", "me")).select("id", quote.alias("quote"))


@query("WITH r AS (SELECT DISTINCT id, story_id FROM relation), k AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY id) AS k FROM r) SELECT story_id, id FROM k WHERE k > 5 AND k <= 10")
def page_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each story's records."""
    r = table(spark, sf_dir, "relation").select("id", "story_id").distinct()
    ranked = r.withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy("id")))
    return ranked.where("k <= 10").where("k > 5").select("story_id", "id")


@query("SELECT decision_id, CASE WHEN assessment IS NULL THEN 'none' WHEN regexp_matches(lower(assessment), 'build|hash') THEN 'build' WHEN regexp_matches(lower(assessment), 'unit|unclear') THEN 'unit' ELSE 'other' END AS class FROM (SELECT DISTINCT decision_id, assessment FROM decision)")
def message_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of a message by the first fitting rule."""
    d = table(spark, sf_dir, "decision").select("decision_id", "assessment").distinct()
    low = F.lower("assessment")
    return d.select("decision_id", F.when(F.col("assessment").isNull(), "none").when(low.rlike("build|hash"), "build").when(low.rlike("unit|unclear"), "unit").otherwise("other").alias("class"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def equi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner equi-join."""
    o = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("WITH d AS (SELECT DISTINCT id, alternatives FROM mention), e AS (SELECT id, i, alternatives[i] AS alt FROM (SELECT id, alternatives, unnest(range(1, len(alternatives) + 1)) AS i FROM d)) SELECT id, string_agg(coalesce(m.form, '?'), ',' ORDER BY i) AS forms FROM e LEFT JOIN (SELECT target, min(form) AS form FROM mention GROUP BY target) m ON m.target = e.alt GROUP BY id")
def dictionary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a set replaced by what they describe, in their order."""
    m = table(spark, sf_dir, "mention")
    described = m.groupBy(F.col("target").alias("alt")).agg(F.min("form").alias("form"))
    each = m.select("id", "alternatives").distinct().select("id", F.posexplode("alternatives").alias("i", "alt"))
    decoded = each.join(described, "alt", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("form", F.lit("?")).alias("f")))).alias("s"))
    return decoded.select("id", F.array_join(F.transform("s", lambda x: x.f), ",").alias("forms"))


@query(
    """WITH nodes AS (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part),
refs AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'supplier' ELSE 'part' END AS kind, user_id AS id FROM events) SELECT event_id, r.kind, name FROM refs r LEFT JOIN nodes n ON n.kind = r.kind AND n.id = r.id"""
)
def polymorphic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a reference picks the table, as one join on kind and id."""
    parts = [("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")]
    nodes = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name")) for t, i, n in parts]
    m = F.col("event_id") % 3
    refs = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, "customer").when(m == 1, "supplier").otherwise("part").alias("kind"), F.col("user_id").alias("id"))
    return refs.join(nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), ["kind", "id"], "left").select("event_id", "kind", "name")


_MENTIONS = "m AS (SELECT id, min(unit_id) AS unit_id, min(story_id) AS story_id, min(target) AS target, min(antecedent) AS antecedent, min(form) AS form, min(evidence.start_token) AS s, min(evidence.end_token) AS e FROM mention GROUP BY id)"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "mention")
    return m.groupBy("id").agg(*[F.min(c).alias(c) for c in ("unit_id", "story_id", "target", "antecedent", "form")], F.min("evidence.start_token").alias("s"), F.min("evidence.end_token").alias("e"))


@query(f"WITH {_MENTIONS} SELECT a.id, CASE WHEN a.antecedent IS NULL THEN 'none' WHEN b.id IS NULL THEN 'unavailable' ELSE b.form END AS antecedent_form FROM m a LEFT JOIN m b ON b.id = a.antecedent")
def left_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join in which a missing partner stays missing."""
    m = _mentions(spark, sf_dir)
    b = m.select(F.col("id").alias("antecedent"), F.col("form").alias("b_form"), F.lit(True).alias("b"))
    state = F.when(F.col("antecedent").isNull(), "none").when(F.col("b").isNull(), "unavailable").otherwise(F.col("b_form"))
    return m.join(b, "antecedent", "left").select("id", state.alias("antecedent_form"))


@query(f"WITH {_MENTIONS} SELECT a.id, b.id AS antecedent, a.s - b.s AS distance, CASE WHEN a.unit_id = b.unit_id THEN 'same' ELSE 'previous' END AS bucket FROM m a JOIN m b ON b.id = a.antecedent")
def antecedent_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Self-join of mentions with their antecedents."""
    a = _mentions(spark, sf_dir).alias("a")
    b = _mentions(spark, sf_dir).alias("b")
    return a.join(b, F.col("a.antecedent") == F.col("b.id")).select("a.id", F.col("b.id").alias("antecedent"), (F.col("a.s") - F.col("b.s")).alias("distance"), F.when(F.col("a.unit_id") == F.col("b.unit_id"), "same").otherwise("previous").alias("bucket"))


_UNIQUE = "q AS (SELECT DISTINCT p_brand AS brand, p_size AS size, p_partkey AS pk FROM part), r AS (SELECT p_brand AS brand, p_size AS size, count(*) AS n, min(p_name) AS name FROM part GROUP BY ALL)"


@query(f"WITH {_UNIQUE} SELECT pk, name FROM q JOIN r USING (brand, size) WHERE n = 1")
def unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors that fit exactly one row."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"))
    return relate.unique_matches(p.select("brand", "size", "pk"), p.select("brand", "size", "name"), ["brand", "size"])[0].select("pk", "name")


@query(f"WITH {_UNIQUE} SELECT 'ambiguous' AS reason, count(*) AS n FROM q JOIN r USING (brand, size) WHERE n > 1 HAVING count(*) > 0")
def unique_lookup_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lookup skips, by reason."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("pk"), F.col("p_name").alias("name"))
    return relate.unique_matches(p.select("brand", "size", "pk"), p.select("brand", "size", "name"), ["brand", "size"])[1]


_SPANS = "a AS (SELECT DISTINCT id, story_id, evidence.char_start AS s, evidence.char_end AS e FROM relation WHERE evidence.char_start < evidence.char_end), b AS (SELECT DISTINCT id AS cid, story_id, evidence.char_start AS cs, evidence.char_end AS ce FROM context WHERE evidence.char_start < evidence.char_end)"


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "relation").select("id", "story_id", F.col("evidence.char_start").alias("s"), F.col("evidence.char_end").alias("e")).distinct()
    b = table(spark, sf_dir, "context").select(F.col("id").alias("cid"), "story_id", F.col("evidence.char_start").alias("cs"), F.col("evidence.char_end").alias("ce")).distinct()
    return a, b


@query(f"WITH {_SPANS} SELECT id, cid FROM a JOIN b ON a.story_id = b.story_id AND s < ce AND cs < e")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that overlap, by blocks of the axis."""
    a, b = _spans(spark, sf_dir)
    return relate.overlap_join(a, b, ["story_id"], ("s", "e"), ("cs", "ce"), 64).select("id", "cid")


@query(f"WITH {_SPANS} SELECT id, cid FROM a JOIN b ON a.story_id = b.story_id AND cs <= s AND e <= ce")
def contain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans inside others."""
    a, b = _spans(spark, sf_dir)
    return relate.overlap_join(a, b, ["story_id"], ("s", "e"), ("cs", "ce"), 64, contained=True).select("id", "cid")


@query("WITH r AS (SELECT DISTINCT id, unit_id, contexts FROM relation), c AS (SELECT DISTINCT id AS cid, unit_id, parents FROM context) SELECT r.id, c.cid FROM r JOIN c USING (unit_id) WHERE len(list_intersect(contexts, parents)) > 0")
def array_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a unit whose arrays share an element."""
    r = table(spark, sf_dir, "relation").select("id", "unit_id", "contexts").distinct()
    c = table(spark, sf_dir, "context").select(F.col("id").alias("cid"), "unit_id", "parents").distinct()
    return r.join(c, "unit_id").where(F.arrays_overlap("contexts", "parents")).select("id", "cid")


@query(
    f"""WITH {_MENTIONS} SELECT id, prev FROM (SELECT a.id, b.id AS prev, row_number() OVER (PARTITION BY a.id ORDER BY b.s DESC, b.e DESC, b.id DESC) AS k FROM (SELECT * FROM m WHERE target IS NOT NULL AND s IS NOT NULL) a LEFT JOIN m b ON b.story_id = a.story_id AND b.target = a.target AND b.s < a.s) WHERE k = 1"""
)
def latest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last earlier mention of the same target; of those that begin together the one that ends last."""
    m = _mentions(spark, sf_dir).where("target IS NOT NULL AND s IS NOT NULL")
    right = m.select("story_id", "target", "s", "e", F.col("id").alias("prev"))
    return relate.as_of(m.select("story_id", "target", "s", "id"), right, ["story_id", "target"], "s", ["e", "prev"]).select("id", "prev")


@query("WITH a AS (SELECT o_custkey, sum(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT coalesce(a.o_custkey, b.o_custkey) AS custkey, round(x - y, 2) AS difference, x IS NOT NULL AND y IS NOT NULL AS available FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def full_outer_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two scores, unmatched ones unavailable."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    a = o.where("o_orderstatus = 'F'").groupBy("custkey").agg(F.sum("o_totalprice").alias("x"))
    b = o.where("o_orderstatus = 'P'").groupBy("custkey").agg(F.sum("o_totalprice").alias("y"))
    return a.join(b, "custkey", "full").select("custkey", F.round(F.col("x") - F.col("y"), 2).alias("difference"), (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("available"))


@query("WITH c AS (SELECT DISTINCT id, parents FROM context WHERE len(parents) > 0), k AS (SELECT DISTINCT id FROM context), e AS (SELECT id, unnest(parents) AS p FROM c) SELECT e.id, count(DISTINCT e.p) AS linked, count(DISTINCT k.id) AS available, list_aggregate(list_sort(list(DISTINCT e.p) FILTER (WHERE k.id IS NULL)), 'string_agg', ',') AS missing FROM e LEFT JOIN k ON k.id = e.p GROUP BY e.id")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a record, those that lead somewhere, and those that do not."""
    c = table(spark, sf_dir, "context").select("id", F.explode("parents").alias("p")).distinct()
    k = table(spark, sf_dir, "context").select(F.col("id").alias("p"), F.lit(True).alias("there")).distinct()
    absent = F.array_join(F.array_sort(F.collect_set(F.when(F.col("there").isNull(), F.col("p")))), ",")
    joined = c.join(k, "p", "left").groupBy("id").agg(F.countDistinct("p").alias("linked"), F.countDistinct(F.when(F.col("there"), F.col("p"))).alias("available"), absent.alias("missing"))
    return joined.withColumn("missing", F.when(F.col("missing") != "", F.col("missing")))


@query("WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), w AS (SELECT *, lead(q) OVER (PARTITION BY l_orderkey ORDER BY n, l_returnflag) AS nxt FROM g) SELECT l_orderkey, l_returnflag, round(nxt - q, 2) AS step FROM w WHERE nxt IS NOT NULL")
def adjacent_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of conditions that follow each other by size."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    nxt = F.lead("q").over(Window.partitionBy("l_orderkey").orderBy("n", "l_returnflag"))
    return g.withColumn("nxt", nxt).where("nxt IS NOT NULL").select("l_orderkey", "l_returnflag", F.round(F.col("nxt") - F.col("q"), 2).alias("step"))


@query(
    """WITH s AS (SELECT o_custkey, md5(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority)) AS support, avg(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT *, o_custkey // 2 AS pair FROM s WHERE o_custkey % 2 = 0), b AS (SELECT *, o_custkey // 2 AS pair FROM s WHERE o_custkey % 2 = 1)
SELECT a.pair, a.support = b.support AS available, CASE WHEN a.support = b.support THEN round(a.v - b.v, 2) END AS difference FROM a JOIN b USING (pair)"""
)
def guarded_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contrast only where both sides have the same support."""
    o = table(spark, sf_dir, "orders")
    s = o.groupBy("o_custkey").agg(F.md5(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",")).alias("support"), F.avg("o_totalprice").alias("v")).withColumn("pair", F.floor(F.col("o_custkey") / 2))
    a, b = s.where("o_custkey % 2 = 0").alias("a"), s.where("o_custkey % 2 = 1").alias("b")
    same = F.col("a.support") == F.col("b.support")
    return a.join(b, "pair").select("pair", same.alias("available"), F.when(same, F.round(F.col("a.v") - F.col("b.v"), 2)).alias("difference"))


@query("SELECT a.n_nationkey AS first, b.n_nationkey AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (a.n_regionkey <> 2 OR a.n_nationkey < b.n_nationkey)")
def conditional_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of equal kind, with a further condition for some."""
    n = table(spark, sf_dir, "nation")
    return n.alias("a").join(n.alias("b"), "n_regionkey").where((F.col("n_regionkey") != 2) | (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("first"), F.col("b.n_nationkey").alias("second"))


@query("SELECT r_name, t.event_type, m.mode FROM region, (SELECT DISTINCT event_type FROM events) t, (SELECT unnest(['pooled', 'scoped']) AS mode) m")
def option_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of small option lists."""
    modes = spark.createDataFrame([("pooled",), ("scoped",)], "mode string")
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "events").select("event_type").distinct()).crossJoin(modes)


@query("WITH z AS (SELECT DISTINCT story_id, segment, response_raw_indices AS a, tr_centers_story_seconds AS b FROM alignment) SELECT story_id, segment, len(a) AS n, round(list_sum(list_transform(list_zip(a, b), lambda z: CASE WHEN isfinite(z[2]) THEN z[1] * z[2] END)), 3) AS mixed FROM z")
def strict_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays place by place, of which different lengths raise."""
    z = table(spark, sf_dir, "alignment").select("story_id", "segment", F.col("response_raw_indices").alias("a"), F.col("tr_centers_story_seconds").alias("b")).distinct()
    product = F.filter(F.transform("z", lambda x: F.when(~F.isnan(x["b"]), x["a"] * x["b"])), lambda x: x.isNotNull())
    total = F.when(F.size(product) > 0, F.aggregate(product, F.lit(0.0), lambda s, x: s + x))
    return relate.strict_zip(z, "a", "b", "z").select("story_id", "segment", F.size("z").cast("long").alias("n"), F.round(total, 3).alias("mixed"))


@query(
    """WITH u AS (SELECT DISTINCT story_id, id, unit_index AS i, unit_index * 3 AS row FROM source_record), n AS (SELECT story_id, count(*) AS n FROM u GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY i, row, id) - 1 AS r FROM u JOIN n USING (story_id)),
k AS (SELECT story_id, n, unnest(range(1, n)) AS k FROM n), ok AS (SELECT k.story_id, k.k, k.n FROM k JOIN r a ON a.story_id = k.story_id JOIN r b ON b.story_id = k.story_id AND b.r = (a.r + k.k) % k.n GROUP BY ALL HAVING bool_and(abs(a.row - b.row) > 4)),
c AS (SELECT story_id, n, arg_min(k, struct_pack(f := abs(k - n / 2.0), k := k)) AS k FROM ok GROUP BY ALL) SELECT a.story_id, a.id, b.id AS partner, CAST(c.k AS INTEGER) AS "offset" FROM c JOIN r a USING (story_id) JOIN r b ON b.story_id = a.story_id AND b.r = (a.r + c.k) % c.n"""
)
def circular_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit with the one half a story further, at least five rows apart."""
    u = table(spark, sf_dir, "source_record").select("story_id", "id", F.col("unit_index").alias("i"), (F.col("unit_index") * 3).alias("row")).distinct()
    return relate.circular_shift(u, "story_id", "i", "id", "row")


@query(
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type = 'click')
SELECT a.user_id, a.event_id, b.event_id AS partner FROM a JOIN b ON a.user_id = b.user_id AND b.r = floor((a.r + 0.5) * b.m / a.n)"""
)
def rank_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ordered lists of different length by proportional rank."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    made = relate.proportional(e.where("event_type = 'view'").withColumn("o", F.col("event_id")), e.where("event_type = 'click'").withColumn("o", F.col("event_id")), "user_id", "o", "event_id")
    return made.select("user_id", "event_id", "partner")


@query("SELECT o.o_orderkey, CASE WHEN n IS NULL THEN 'lost' WHEN o_orderstatus = 'P' THEN 'pending' WHEN n < 3 THEN 'partial' ELSE 'complete' END AS state FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest against receipts, with the state of each."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "lost").when(F.col("o_orderstatus") == "P", "pending").when(F.col("n") < 3, "partial").otherwise("complete")
    return table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@query("WITH r AS (SELECT l_orderkey, sum(abs(l_extendedprice)) AS s FROM lineitem GROUP BY 1) SELECT l_suppkey % 10 AS parcel, l_partkey % 50 AS voxel, round(sum(abs(l_extendedprice) / s), 4) AS weight FROM lineitem JOIN r USING (l_orderkey) GROUP BY ALL")
def sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping times a mapper whose rows are normalised by absolute weight."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", F.abs("l_extendedprice").alias("w"))
    s = li.groupBy("l_orderkey").agg(F.sum("w").alias("s"))
    return li.join(s, "l_orderkey").groupBy((F.col("l_suppkey") % 10).alias("parcel"), (F.col("l_partkey") % 50).alias("voxel")).agg(F.round(F.sum(F.col("w") / F.col("s")), 4).alias("weight"))


@query("WITH v AS (SELECT l_partkey AS voxel, l_suppkey % 10 AS parcel, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), m AS (SELECT voxel, max(w) AS w FROM v GROUP BY 1) SELECT voxel, min(parcel) AS parcel FROM v JOIN m USING (voxel, w) GROUP BY voxel HAVING count(*) = 1")
def surface_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel with the greatest weight per voxel; ties are left out."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("voxel"), (F.col("l_suppkey") % 10).alias("parcel")).agg(F.sum("l_quantity").alias("w"))
    best = v.groupBy("voxel").agg(F.max(F.struct("w", "parcel")).alias("b"), F.collect_list("w").alias("all"))
    return best.where(F.size(F.filter("all", lambda x: x == F.col("b.w"))) == 1).select("voxel", F.col("b.parcel").alias("parcel"))


@query(
    "WITH r AS (SELECT DISTINCT id, source, target, contexts FROM relation), c AS (SELECT DISTINCT id, holder, attribution FROM context), x AS (SELECT c.id AS cid, r.id FROM c JOIN r ON list_contains(r.contexts, c.id) UNION SELECT c.id, r.id FROM c JOIN r ON r.source = c.holder UNION SELECT c.id, r.id FROM c JOIN r ON r.target = c.holder) SELECT cid, count(*) AS n FROM x GROUP BY cid"
)
def any_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a case reaches by any of three links, as a union of equi-joins."""
    r = table(spark, sf_dir, "relation").select("id", "source", "target", "contexts").distinct()
    c = table(spark, sf_dir, "context").select(F.col("id").alias("cid"), "holder").distinct()
    by_context = r.select("id", F.explode("contexts").alias("cid")).join(c.select("cid").distinct(), "cid").select("cid", "id")
    ends = [r.select("id", F.col(e).alias("holder")).join(c, "holder").select("cid", "id") for e in ("source", "target")]
    return by_context.union(ends[0]).union(ends[1]).distinct().groupBy("cid").agg(F.count("*").alias("n"))


# --- windows ----------------------------------------------------------------------------------------------------------


@query("WITH d AS (SELECT DISTINCT draft_id, story_id, unit_index, md5(coalesce(graph, '')) AS h FROM draft), p AS (SELECT *, lag(h) OVER (PARTITION BY story_id ORDER BY unit_index, draft_id) AS parent, lag(draft_id) OVER (PARTITION BY story_id ORDER BY unit_index, draft_id) AS before FROM d) SELECT draft_id, h, parent, before IS NULL OR parent IS NOT DISTINCT FROM h AS repeats FROM p")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each graph and of the one before it in the story."""
    d = table(spark, sf_dir, "draft").select("draft_id", "story_id", "unit_index", F.md5(F.coalesce("graph", F.lit(""))).alias("h")).distinct()
    w = Window.partitionBy("story_id").orderBy("unit_index", "draft_id")
    p = d.withColumn("parent", F.lag("h").over(w)).withColumn("before", F.lag("draft_id").over(w))
    return p.select("draft_id", "h", "parent", (F.col("before").isNull() | F.col("parent").eqNullSafe(F.col("h"))).alias("repeats"))


@query("WITH d AS (SELECT DISTINCT decision_id, unit_id, revision, committed_utc AS t FROM decision), p AS (SELECT *, lag(t) OVER (PARTITION BY unit_id ORDER BY revision, decision_id) AS before FROM d) SELECT decision_id, before > t AS reversed FROM p WHERE before IS NOT NULL AND t IS NOT NULL")
def monotone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that were committed before the one they follow."""
    d = table(spark, sf_dir, "decision").select("decision_id", "unit_id", "revision", F.col("committed_utc").alias("t")).distinct()
    p = d.withColumn("before", F.lag("t").over(Window.partitionBy("unit_id").orderBy("revision", "decision_id")))
    return p.where("before IS NOT NULL AND t IS NOT NULL").select("decision_id", (F.col("before") > F.col("t")).alias("reversed"))


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY revision DESC, decision_id DESC, ingested_utc DESC) AS k FROM decision) SELECT unit_id, revision, decision_id, status FROM k WHERE k = 1 AND status <> 'rejected'")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last decision per unit, where it keeps the unit."""
    d = table(spark, sf_dir, "decision").select("unit_id", "revision", "decision_id", "status", "ingested_utc")
    return relate.latest(d, ["unit_id"], [F.desc("revision"), F.desc("decision_id"), F.desc("ingested_utc")]).where("status <> 'rejected'").select("unit_id", "revision", "decision_id", "status")


@query("WITH k AS (SELECT list_sort([\"left\", \"right\"]) AS pair, relation, row_number() OVER (PARTITION BY list_sort([\"left\", \"right\"]) ORDER BY recorded_utc DESC, id DESC, ingested_utc DESC) AS k FROM identity_link WHERE \"left\" IS NOT NULL AND \"right\" IS NOT NULL) SELECT pair[1] AS a, pair[2] AS b, relation FROM k WHERE k = 1")
def latest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last link of an unordered pair."""
    d = table(spark, sf_dir, "identity_link").where("`left` IS NOT NULL AND `right` IS NOT NULL").select(F.array_sort(F.array("left", "right")).alias("pair"), "relation", "recorded_utc", "id", "ingested_utc")
    last = relate.latest(d, ["pair"], [F.desc("recorded_utc"), F.desc("id"), F.desc("ingested_utc")])
    return last.select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"), "relation")


@query("WITH d AS (SELECT story_id, unit_index, bool_or(status = 'accepted') AS ok FROM draft GROUP BY ALL), g AS (SELECT *, max(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY story_id ORDER BY unit_index) AS gap FROM d) SELECT story_id, unit_index, CASE WHEN gap = 0 THEN 'taken' WHEN NOT ok THEN 'missing' ELSE 'blocked' END AS state FROM g")
def contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units up to the first gap, what is missing and what waits behind it."""
    d = table(spark, sf_dir, "draft").groupBy("story_id", "unit_index").agg(F.max(F.col("status") == "accepted").alias("ok"))
    return relate.contiguous_prefix(d, "story_id", "unit_index", "ok").select("story_id", "unit_index", "state")


@query("WITH r AS (SELECT DISTINCT id, story_id, evidence.char_start AS s, evidence.char_end AS e FROM relation WHERE evidence.char_start IS NOT NULL), p AS (SELECT *, lag(e) OVER (PARTITION BY story_id ORDER BY s, e, id) AS before FROM r) SELECT story_id, count(*) FILTER (WHERE before > s) AS overlaps, max(before - s) FILTER (WHERE before > s) AS most FROM p GROUP BY story_id")
def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that begin before the one before them ends."""
    r = table(spark, sf_dir, "relation").select("id", "story_id", F.col("evidence.char_start").alias("s"), F.col("evidence.char_end").alias("e")).where("s IS NOT NULL").distinct()
    p = r.withColumn("before", F.lag("e").over(Window.partitionBy("story_id").orderBy("s", "e", "id")))
    return p.groupBy("story_id").agg(F.count_if(F.col("before") > F.col("s")).alias("overlaps"), F.max(F.when(F.col("before") > F.col("s"), F.col("before") - F.col("s"))).alias("most"))


@query("SELECT vec_id % 5 AS grp, vec_id, rank() OVER (PARTITION BY vec_id % 5 ORDER BY label) + (count(*) OVER (PARTITION BY vec_id % 5, label) - 1) / 2.0 AS rank FROM embeddings")
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in which ties share their mean."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("grp"), "vec_id", "label")
    return e.select("grp", "vec_id", relate.average_rank("label", ["grp"]).alias("rank"))


_P = "p AS (SELECT event_type AS family, event_id, value / 1000.0 AS p FROM events)"


@query(f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS m FROM p) SELECT family, event_id, CAST(floor(least(1.0, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC)) * 1e6 + 0.001) AS BIGINT) AS adjusted_ppm FROM r WHERE p BETWEEN 0 AND 1")
def bh_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-up adjusted p values by family, in whole millionths."""
    p = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), "event_id", (F.col("value") / 1000).alias("p"))
    return relate.benjamini_hochberg(p, "family", "p").where("p BETWEEN 0 AND 1").select("family", "event_id", F.floor(F.col("adjusted") * 1e6 + 0.001).alias("adjusted_ppm"))


@query("WITH s AS (SELECT DISTINCT story_id FROM draft) SELECT story_id, CAST((row_number() OVER (ORDER BY story_id) - 1) % 3 AS INTEGER) AS fold FROM s")
def round_robin_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted stories dealt to folds in turn."""
    s = numbered(table(spark, sf_dir, "draft").select("story_id").distinct(), ["story_id"], "r")
    return s.select("story_id", (F.col("r") % 3).cast("int").alias("fold"))


@query("SELECT story_id, min(unit_index) AS first_unit, max(unit_index) AS last_unit, count(DISTINCT unit_index) AS n FROM draft GROUP BY story_id")
def prefix_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last unit of each story."""
    return table(spark, sf_dir, "draft").groupBy("story_id").agg(F.min("unit_index").alias("first_unit"), F.max("unit_index").alias("last_unit"), F.countDistinct("unit_index").alias("n"))


@query("SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 9 AS BIGINT) AS chunk FROM orders")
def chunked_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members in chunks of at most nine."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor((k - 1) / 9).alias("chunk"))


# --- sort, limit, sets ------------------------------------------------------------------------------------------------


@query("SELECT unit_id, id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY sha256('[\"11\",\"' || unit_id || '\",\"' || id || '\"]')) AS INTEGER) AS place FROM (SELECT DISTINCT unit_id, id FROM mention)")
def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: candidates in a reproducible pseudo-random order."""
    m = table(spark, sf_dir, "mention").select("unit_id", "id").distinct()
    return m.select("unit_id", "id", F.row_number().over(Window.partitionBy("unit_id").orderBy(relate.hash_order(11, "unit_id", "id"))).alias("place"))


@query("SELECT story_id, id FROM (SELECT story_id, id, row_number() OVER (PARTITION BY story_id ORDER BY sha256('[\"7\",\"' || id || '\"]')) AS k FROM (SELECT DISTINCT story_id, id FROM relation)) WHERE k <= 3")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three of each story that come first by digest."""
    r = table(spark, sf_dir, "relation").select("story_id", "id").distinct()
    return r.withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy(relate.hash_order(7, "id")))).where("k <= 3").select("story_id", "id")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def ready_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the first fifty by several keys, as a top-k."""
    return table(spark, sf_dir, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT target AS id FROM mention WHERE target IS NOT NULL UNION SELECT source FROM relation WHERE source IS NOT NULL")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct union."""
    return table(spark, sf_dir, "mention").select(F.col("target").alias("id")).union(table(spark, sf_dir, "relation").select("source")).where("id IS NOT NULL").distinct()


@query("SELECT target AS id FROM mention WHERE target IS NOT NULL INTERSECT SELECT source FROM relation")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both hold."""
    return table(spark, sf_dir, "mention").where("target IS NOT NULL").select(F.col("target").alias("id")).intersect(table(spark, sf_dir, "relation").select("source"))


@query("SELECT source AS id FROM relation WHERE source IS NOT NULL EXCEPT SELECT target FROM mention")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: what only the first holds."""
    return table(spark, sf_dir, "relation").where("source IS NOT NULL").select(F.col("source").alias("id")).subtract(table(spark, sf_dir, "mention").select("target"))


@query("SELECT (SELECT count(*) FROM (SELECT story_id FROM draft WHERE unit_index % 2 = 0 INTERSECT SELECT story_id FROM draft WHERE unit_index % 2 = 1)) = 0 AS disjoint")
def disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two parts share a story."""
    d = table(spark, sf_dir, "draft")
    shared = d.where("unit_index % 2 = 0").select("story_id").intersect(d.where("unit_index % 2 = 1").select("story_id"))
    return shared.agg((F.count("*") == 0).alias("disjoint"))


@query("WITH s AS (SELECT DISTINCT id, story_id, unit_index, local_word_span AS w FROM source_record), p AS (SELECT *, lag(w[2]) OVER (PARTITION BY story_id ORDER BY unit_index) AS before FROM s) SELECT story_id, count(*) AS units, bool_and(coalesce(before, 0) = w[1]) AS covers FROM p WHERE w IS NOT NULL GROUP BY story_id")
def partition_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the spans of a story's units follow each other without gap."""
    s = table(spark, sf_dir, "source_record").select("id", "story_id", "unit_index", F.col("local_word_span").alias("w")).distinct()
    p = s.withColumn("before", F.lag(F.get("w", F.lit(1))).over(Window.partitionBy("story_id").orderBy("unit_index"))).where("w IS NOT NULL")
    return p.groupBy("story_id").agg(F.count("*").alias("units"), F.bool_and(F.coalesce("before", F.lit(0)) == F.get("w", F.lit(0))).alias("covers"))


@query("SELECT collection, count(*) AS n FROM (SELECT 'mention' AS collection FROM mention UNION ALL SELECT 'relation' FROM relation UNION ALL SELECT 'identity_link' FROM identity_link UNION ALL SELECT 'context' FROM context) GROUP BY collection")
def union_record_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections of different shape as one."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("collection"), "*") for t in ("mention", "relation", "identity_link", "context")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy("collection").agg(F.count("*").alias("n"))


@query(
    """WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber <= 2), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber >= 2), d AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber <= 2), u AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber = 1),
x AS (SELECT 'parts' AS pair, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM u)) AS only_first, (SELECT count(*) FROM (SELECT * FROM u EXCEPT ALL SELECT * FROM a)) AS only_second UNION ALL SELECT 'distinct', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM d)), (SELECT count(*) FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM a)) UNION ALL SELECT 'other', (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)), (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT *, only_first + only_second = 0 AS same FROM x"""
)
def multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that one of two frames holds more often: the same from two parts, without repeats, and from other lines."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linenumber")
    rows = lambda condition: li.where(condition).select("l_partkey", "l_returnflag")
    first = rows("l_linenumber <= 2")
    pairs = {"parts": rows("l_linenumber = 2").unionAll(rows("l_linenumber = 1")), "distinct": first.distinct(), "other": rows("l_linenumber >= 2")}
    each = [relate.multiset_difference(first, other).select(F.lit(name).alias("pair"), "only_first", "only_second") for name, other in pairs.items()]
    return each[0].unionAll(each[1]).unionAll(each[2]).withColumn("same", F.col("only_first") + F.col("only_second") == 0)


QUERIES, ORACLE = catalog.queries, catalog.oracle
