"""Queries over the annotation graph: closures, the query language, validation, history, plans of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import annotation, graph, relate
from loomspan.plans.registry import Catalog
from loomspan.session import table

catalog = Catalog()
query = catalog.query

#: DuckDB: events and arguments of the accepted drafts.
_GRAPH = """WITH RECURSIVE g AS (SELECT DISTINCT story_id, unit_id, unit_index, CAST(graph AS JSON) AS j FROM draft WHERE status = 'accepted' AND json_valid(graph) AND json_type(graph) = 'OBJECT'),
ee AS (SELECT unit_id, unnest(CASE json_type(j, '$.events') WHEN 'ARRAY' THEN json_extract(j, '$.events[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.events')] ELSE [] END) AS e FROM g),
ev AS (SELECT DISTINCT unit_id, e->>'$.id' AS id, e->>'$.predicate' AS predicate, e->>'$.polarity' AS polarity, e->>'$.tense' AS tense, json_extract_string(e, '$.contexts[*]') AS contexts, e FROM ee WHERE json_type(e) = 'OBJECT'),
aa AS (SELECT id AS event, CASE json_type(e, '$.arguments') WHEN 'ARRAY' THEN json_extract(e, '$.arguments[*]') WHEN 'OBJECT' THEN [json_extract(e, '$.arguments')] ELSE [] END AS l FROM ev),
ar AS (SELECT DISTINCT event, i AS place, l[i]->>'$.role' AS role, l[i]->>'$.target' AS target, l[i]->>'$.support' AS support, l[i]->>'$.mention' AS mention FROM (SELECT event, l, unnest(range(1, len(l) + 1)) AS i FROM aa) WHERE json_type(l[i]) = 'OBJECT'),
en AS (SELECT DISTINCT unit_id, x->>'$.id' AS id, x->>'$.concept' AS concept FROM (SELECT unit_id, unnest(CASE json_type(j, '$.entities') WHEN 'ARRAY' THEN json_extract(j, '$.entities[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.entities')] ELSE [] END) AS x FROM g) WHERE json_type(x) = 'OBJECT')
"""
_LABELS = "list_aggregate(list_sort(list(DISTINCT label)), 'string_agg', ',') AS labels"


def _rendered(answers: DataFrame) -> DataFrame:
    return answers.select("query_id", F.array_join("labels", ",").alias("labels")).withColumn("labels", F.when(F.col("labels") != "", F.col("labels")))


# --- the query language -----------------------------------------------------------------------------------------------


@query(_GRAPH + ", m AS (SELECT DISTINCT unit_id, target FROM mention), q AS (SELECT DISTINCT unit_id, concept FROM en) SELECT q.unit_id || '/' || q.concept AS query_id, CASE WHEN EXISTS (SELECT 1 FROM m JOIN en x ON m.target = x.id WHERE m.unit_id = q.unit_id AND x.concept = q.concept) THEN 'supported' END AS labels FROM q WHERE q.concept IS NOT NULL")
def q_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: whether each unit mentions an entity of each of its concepts."""
    view = annotation.graph_view(spark, sf_dir)
    asked = view.entities.where("concept IS NOT NULL").select("unit_id", "concept").distinct().withColumn("query_id", F.concat("unit_id", F.lit("/"), "concept"))
    return _rendered(annotation.q_concept(view, asked))


@query(_GRAPH + f"SELECT q.event || '/' || q.role AS query_id, (SELECT {_LABELS} FROM (SELECT target AS label FROM ar x WHERE x.event = q.event AND x.role = q.role AND coalesce(support <> 'unresolved', true) AND target IS NOT NULL)) AS labels FROM (SELECT DISTINCT event, role FROM ar) q")
def q_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: fillers of every role of every event."""
    view = annotation.graph_view(spark, sf_dir)
    return _rendered(annotation.q_role(view, view.arguments.select("event", "role").distinct().withColumn("query_id", F.concat("event", F.lit("/"), "role"))))


_SAME = """l AS (SELECT DISTINCT "left" AS a, "right" AS b, relation FROM identity_link WHERE coalesce(support <> 'unresolved', true) AND "left" IS NOT NULL AND "right" IS NOT NULL),
s AS (SELECT a, b FROM l WHERE relation = 'same' AND a <> b UNION SELECT b, a FROM l WHERE relation = 'same' AND a <> b),
c AS (SELECT a AS id, a AS r FROM s UNION SELECT c.id, s.b FROM c JOIN s ON s.a = c.r),
k0 AS (SELECT id, min(r) AS root FROM c GROUP BY id),
bad AS (SELECT DISTINCT x.root FROM l JOIN k0 x ON x.id = l.a JOIN k0 y ON y.id = l.b WHERE relation = 'different' AND x.root = y.root),
k AS (SELECT id, CASE WHEN root IN (SELECT root FROM bad) THEN id ELSE root END AS root FROM k0)"""


@query(f"WITH RECURSIVE {_SAME} SELECT id, root FROM k")
def equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of what is the same; contradictory ones fall apart."""
    links = annotation.graph_view(spark, sf_dir).identity_links.where(annotation.resolved())
    return graph.equivalence_classes(links.where("relation = 'same'"), links.where("relation = 'different'"), "left_id", "right_id")


@query(
    f"""WITH RECURSIVE {_SAME}, q AS (SELECT DISTINCT id, target, support FROM mention) SELECT q.id AS query_id, CASE WHEN q.target IS NOT NULL AND coalesce(q.support <> 'unresolved', true) THEN coalesce((SELECT string_agg(DISTINCT o.id, ',' ORDER BY o.id) FROM k JOIN k o ON o.root = k.root WHERE k.id = q.target), nullif(q.target, '')) END AS labels FROM q"""
)
def q_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: the class of what every mention names."""
    view = annotation.graph_view(spark, sf_dir)
    return _rendered(annotation.q_reference(view, view.mentions.select(F.col("id").alias("query_id"), F.col("id").alias("mention")).distinct()))


@query(_GRAPH + ", p AS (SELECT id, CASE WHEN count(DISTINCT polarity) = 1 THEN nullif(min(polarity), 'unresolved') END AS labels FROM ev GROUP BY id) SELECT id AS query_id, labels FROM p")
def q_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: polarity of every event."""
    view = annotation.graph_view(spark, sf_dir)
    return _rendered(annotation.q_polarity(view, view.events.select(F.col("id").alias("query_id"), F.col("id").alias("event")).distinct()))


@query(
    _GRAPH
    + """, x AS (SELECT DISTINCT id, unnest(CASE WHEN len(contexts) > 0 THEN contexts ELSE [NULL] END) AS c FROM ev), k AS (SELECT id AS c, min(kind) AS kind, bool_and(coalesce(support <> 'unresolved', true)) AS ok FROM context GROUP BY id),
p AS (SELECT x.id, bool_and(x.c IS NULL OR coalesce(ok, false)) AS ok, '[' || coalesce(string_agg('"' || kind || '"', ',' ORDER BY kind), '') || ']' AS kinds FROM x LEFT JOIN k USING (c) GROUP BY x.id) SELECT id AS query_id, CASE WHEN ok THEN sha256(kinds) END AS labels FROM p"""
)
def q_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: digest of the kinds of every event's contexts."""
    view = annotation.graph_view(spark, sf_dir)
    return _rendered(annotation.q_status(view, view.events.select(F.col("id").alias("query_id"), F.col("id").alias("event")).distinct()))


@query(
    """WITH r AS (SELECT DISTINCT id, type, source, target, list_sort(contexts) AS contexts, support FROM relation), q AS (SELECT min(id) AS query_id, source, target, contexts FROM r WHERE source IS NOT NULL AND target IS NOT NULL AND contexts IS NOT NULL GROUP BY ALL)
SELECT query_id, (SELECT string_agg(DISTINCT type, ',' ORDER BY type) FROM r WHERE r.source = q.source AND r.target = q.target AND r.contexts = q.contexts AND coalesce(support <> 'unresolved', true)) AS labels FROM q"""
)
def q_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: types of the relations between two records in equal contexts."""
    view = annotation.graph_view(spark, sf_dir)
    asked = view.relations.where("source IS NOT NULL AND target IS NOT NULL AND contexts IS NOT NULL").groupBy("source", "target", F.array_sort("contexts").alias("contexts")).agg(F.min("id").alias("query_id"))
    return _rendered(annotation.q_relation(view, asked))


@query(
    """WITH l AS (SELECT DISTINCT list_sort(["left", "right"]) AS pair, relation, support FROM identity_link WHERE "left" IS NOT NULL AND "right" IS NOT NULL), r AS (SELECT pair, count(DISTINCT relation) AS n, min(relation) AS label FROM l WHERE coalesce(support <> 'unresolved', true) GROUP BY pair)
SELECT q.pair[1] || '/' || q.pair[2] AS query_id, CASE WHEN n = 1 THEN label END AS labels FROM (SELECT DISTINCT pair FROM l) q LEFT JOIN r USING (pair)"""
)
def q_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: the one label between two records, if there is just one."""
    view = annotation.graph_view(spark, sf_dir)
    pair = F.array_sort(F.array("left_id", "right_id"))
    asked = view.identity_links.where("left_id IS NOT NULL AND right_id IS NOT NULL").select(pair[0].alias("left_id"), pair[1].alias("right_id")).distinct()
    return _rendered(annotation.q_identity(view, asked.withColumn("query_id", F.concat("left_id", F.lit("/"), "right_id"))))


@query(
    _GRAPH
    + """, q AS (SELECT DISTINCT event, role, target FROM ar WHERE place = 1 AND target IS NOT NULL), p AS (SELECT id AS event, min(polarity) AS is_ FROM ev GROUP BY id)
SELECT event || '/' || role || '/' || target AS query_id, CASE WHEN is_ <> 'unresolved' AND EXISTS (SELECT 1 FROM ar WHERE ar.event = q.event AND ar.role = q.role AND ar.target = q.target AND coalesce(support <> 'unresolved', true)) THEN CASE WHEN is_ = 'positive' THEN 'supported' ELSE 'contradicted' END END AS labels FROM q JOIN p USING (event)"""
)
def q_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: whether the first argument of every event holds positively."""
    view = annotation.graph_view(spark, sf_dir)
    first = view.arguments.where("place = 0 AND target IS NOT NULL").select("event", "role", "target").distinct()
    asked = first.select(F.concat_ws("/", "event", "role", "target").alias("query_id"), "event", F.array(F.struct("role", "target")).alias("requested"), F.lit("positive").alias("polarity"))
    return _rendered(annotation.q_binding(view, asked))


@query(
    _GRAPH
    + """, a AS (SELECT DISTINCT event, role, target FROM ar WHERE coalesce(support <> 'unresolved', true) AND target IS NOT NULL), q AS (SELECT DISTINCT id AS event FROM ev)
SELECT event AS query_id, (SELECT string_agg(DISTINCT y.target, ',' ORDER BY y.target) FROM a x JOIN a y ON y.event = x.target WHERE x.event = q.event AND x.role = 'experiencer' AND y.role = 'theme' AND x.target IN (SELECT id FROM ev)) AS labels FROM q"""
)
def q_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps from every event: the event that it experiences, and that one's theme."""
    view = annotation.graph_view(spark, sf_dir)
    asked = view.events.select(F.col("id").alias("query_id"), F.col("id").alias("event")).distinct()
    return _rendered(annotation.q_compose(view, asked, [{"op": "argument_event", "role": "experiencer"}, {"op": "role", "role": "theme"}]))


@query(
    _GRAPH
    + """, a AS (SELECT DISTINCT event, role, target, support FROM ar), q AS (SELECT DISTINCT event, role FROM a), x AS (SELECT q.event, q.role, (SELECT count(DISTINCT target) FROM a WHERE a.event = q.event AND a.role = q.role AND coalesce(support <> 'unresolved', true)) AS n FROM q)
SELECT role AS family, count(*) AS asked, count(*) FILTER (WHERE n = 0) AS unlabelled FROM x GROUP BY role"""
)
def q_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued count: queries asked and left without label, by family."""
    view = annotation.graph_view(spark, sf_dir)
    asked = view.arguments.select("event", "role").distinct().withColumn("query_id", F.concat("event", F.lit("/"), "role"))
    return annotation.q_role(view, asked).join(asked, "query_id").groupBy(F.col("role").alias("family")).agg(F.count("*").alias("asked"), F.count_if(F.col("labels").isNull()).alias("unlabelled"))


_CONFLICT = "a AS (SELECT DISTINCT target AS query_id, form AS gold FROM mention WHERE target IS NOT NULL AND form IS NOT NULL)"


@query(f"WITH {_CONFLICT} SELECT label_state, count(*) AS n FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 THEN 'unresolved' ELSE 'annotation_supported' END AS label_state FROM a) GROUP BY 1")
def conflicting_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: copies of a query with different gold are all unresolved."""
    a = table(spark, sf_dir, "mention").where("target IS NOT NULL AND form IS NOT NULL").select(F.col("target").alias("query_id"), F.col("form").alias("gold")).distinct()
    return annotation.conflicts(a, ["query_id"], "gold").groupBy("label_state").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT DISTINCT unit_id, form, support, id FROM mention), d AS (SELECT unit_id, form, support, string_agg(id, ',' ORDER BY id) AS items, sha256('{"form":' || coalesce('"' || form || '"', 'null') || ',"support":' || coalesce('"' || support || '"', 'null') || '}') AS h FROM m GROUP BY ALL)
SELECT unit_id, form, support, items, CAST("index" AS INTEGER) AS "index" FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY h) - 1 AS "index", count(*) OVER (PARTITION BY unit_id) AS n FROM d) WHERE n > 1"""
)
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: mentions of a unit that cannot be told apart share a candidate."""
    m = table(spark, sf_dir, "mention").select("unit_id", "form", "support", "id").distinct()
    return annotation.candidate_sets(m, "unit_id", ["form", "support"], "id").withColumn("items", F.array_join("items", ","))


@query(
    """WITH d AS (SELECT DISTINCT story_id, form, support FROM mention WHERE form IS NOT NULL AND support IS NOT NULL), held AS (SELECT DISTINCT story_id FROM d WHERE form = 'name' AND support = 'inferred'), tr AS (SELECT * FROM d WHERE story_id NOT IN (SELECT story_id FROM held))
SELECT (SELECT count(*) FROM held) AS purged_stories, (SELECT count(DISTINCT story_id) FROM tr) AS training_stories, EXISTS (SELECT 1 FROM tr WHERE form = 'name') AS form_seen, EXISTS (SELECT 1 FROM tr WHERE support = 'inferred') AS support_seen"""
)
def composition_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: stories with a configuration are purged; its parts must still be seen in training."""
    d = table(spark, sf_dir, "mention").where("form IS NOT NULL AND support IS NOT NULL").select("story_id", "form", "support").distinct()
    held = d.where("form = 'name' AND support = 'inferred'").select("story_id").distinct()
    train = d.join(held, "story_id", "left_anti")
    seen = train.agg(F.countDistinct("story_id").alias("training_stories"), F.coalesce(F.max(F.col("form") == "name"), F.lit(False)).alias("form_seen"), F.coalesce(F.max(F.col("support") == "inferred"), F.lit(False)).alias("support_seen"))
    return held.agg(F.count("*").alias("purged_stories")).crossJoin(seen)


# --- closures ---------------------------------------------------------------------------------------------------------

_PARENTS = "e AS (SELECT DISTINCT id AS src, p AS dst FROM (SELECT id, unnest(parents) AS p FROM context) WHERE p IS NOT NULL)"


def _parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "context").select(F.col("id").alias("src"), F.explode("parents").alias("dst")).where("dst IS NOT NULL").distinct()


@query(f"WITH RECURSIVE {_PARENTS}, t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON e.src = t.dst) SELECT src, dst FROM t")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: every context above each context, loops included."""
    return graph.closure(_parent_edges(spark, sf_dir), "src", "dst").select("src", "dst")


@query(f"WITH RECURSIVE {_PARENTS}, t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON e.src = t.dst) SELECT DISTINCT src AS id FROM t WHERE src = dst")
def context_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that reach themselves."""
    return graph.on_cycles(_parent_edges(spark, sf_dir), "src", "dst")


@query(
    """WITH RECURSIVE o AS (SELECT DISTINCT CASE type WHEN 'after' THEN target ELSE source END AS src, CASE type WHEN 'after' THEN source ELSE target END AS dst FROM relation WHERE type IN ('before', 'after') AND source IS NOT NULL AND target IS NOT NULL),
t AS (SELECT src, dst FROM o UNION SELECT t.src, o.dst FROM t JOIN o ON o.src = t.dst) SELECT DISTINCT src AS id FROM t WHERE src = dst"""
)
def order_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that come before themselves, `after` being reversed."""
    r = table(spark, sf_dir, "relation").where("type IN ('before', 'after') AND source IS NOT NULL AND target IS NOT NULL")
    back = F.col("type") == "after"
    edges = r.select(F.when(back, F.col("target")).otherwise(F.col("source")).alias("src"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("dst"))
    return graph.on_cycles(edges, "src", "dst")


_JOBS = "j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey - o_orderkey % 7 + (o_orderkey % 7 - 1) // 2 END AS need FROM orders)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("job"), F.when(k % 7 > 0, k - k % 7 + F.floor((k % 7 - 1) / 2)).alias("need"))


@query(f"WITH RECURSIVE {_JOBS}, t AS (SELECT job, need, 1 AS steps FROM j WHERE need IS NOT NULL UNION SELECT t.job, j.need, t.steps + 1 FROM t JOIN j ON j.job = t.need WHERE j.need IS NOT NULL) SELECT job, need, CAST(min(steps) AS INTEGER) AS steps FROM t GROUP BY ALL")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs that a job needs, directly or not."""
    closed = graph.closure(_jobs(spark, sf_dir), "job", "need")
    return closed.select(F.col("src").alias("job"), F.col("dst").alias("need"), "steps")


@query(f"WITH RECURSIVE {_JOBS}, t AS (SELECT job, 0 AS wave FROM j WHERE need IS NULL UNION SELECT j.job, t.wave + 1 FROM t JOIN j ON j.need = t.job) SELECT job, CAST(max(wave) AS INTEGER) AS wave FROM t GROUP BY job")
def job_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave in which each job can run."""
    j = _jobs(spark, sf_dir)
    return graph.waves(j, j.where("need IS NOT NULL"), "job", "need")


@query("SELECT n_name AS start, count(DISTINCT l_partkey) AS reached FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def bounded_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps over different edges."""
    edge = lambda t, s, d: table(spark, sf_dir, t).select(F.col(s).cast("long").alias("src"), F.col(d).cast("long").alias("dst"))
    start = table(spark, sf_dir, "nation").select(F.col("n_name").alias("query"), F.col("n_nationkey").cast("long").alias("node"))
    reached = graph.traverse(start, [edge("customer", "c_nationkey", "c_custkey"), edge("orders", "o_custkey", "o_orderkey"), edge("lineitem", "l_orderkey", "l_partkey")])
    return reached.groupBy(F.col("query").alias("start")).agg(F.count("*").alias("reached"))


# --- history ----------------------------------------------------------------------------------------------------------


@query("SELECT story_id, count(DISTINCT id) AS mentions, count(DISTINCT target) AS targets FROM mention WHERE CAST(regexp_extract(unit_id, '_u([0-9]+)$', 1) AS INTEGER) <= 10 GROUP BY story_id")
def state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as it was at the end of the eleventh unit."""
    view = annotation.graph_view(spark, sf_dir).at(10)
    return view.mentions.groupBy("story_id").agg(F.countDistinct("id").alias("mentions"), F.countDistinct("target").alias("targets"))


@query(
    """WITH d AS (SELECT DISTINCT decision_id, unit_id, revision, status FROM decision), v AS (SELECT decision_id, unit_id, revision AS valid_from, lead(revision) OVER (PARTITION BY unit_id ORDER BY revision, decision_id) AS valid_to, status FROM d) SELECT decision_id, unit_id, valid_from, valid_to, status FROM v"""
)
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions with the half-open range in which each holds."""
    d = table(spark, sf_dir, "decision").select("decision_id", "unit_id", "revision", "status").distinct()
    to = F.lead("revision").over(Window.partitionBy("unit_id").orderBy("revision", "decision_id"))
    return d.select("decision_id", "unit_id", F.col("revision").alias("valid_from"), to.alias("valid_to"), "status")


@query(
    """WITH o AS (SELECT DISTINCT ON (id) id, form FROM mention ORDER BY id, ingested_utc), x AS (SELECT decision_id, revision, i, operations[i] AS op FROM (SELECT *, unnest(range(1, len(operations) + 1)) AS i FROM decision)), c AS (SELECT op.id AS id, arg_max(op.value, struct_pack(r := revision, d := decision_id, i := i)) AS value FROM x WHERE op.op = 'set' AND op.field = 'label' GROUP BY 1)
SELECT o.id, coalesce(c.value, o.form) AS form, c.id IS NOT NULL AS corrected FROM o LEFT JOIN c ON c.id = replace(o.id, ':m', ':r')"""
)
def corrections_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: original values, replaced where a later correction has one."""
    original = table(spark, sf_dir, "mention").groupBy("id").agg(F.min_by("form", "ingested_utc").alias("form"))
    ops = table(spark, sf_dir, "decision").select("decision_id", "revision", F.posexplode("operations").alias("i", "op")).where("op.op = 'set' AND op.field = 'label'")
    last = ops.groupBy(F.col("op.id").alias("_key")).agg(F.max_by("op.value", F.struct("revision", "decision_id", "i")).alias("value"))
    keyed = original.withColumn("_key", F.replace("id", F.lit(":m"), F.lit(":r")))
    return keyed.join(last, "_key", "left").select("id", F.coalesce("value", "form").alias("form"), F.col("value").isNotNull().alias("corrected"))


# --- validation and plans ---------------------------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT DISTINCT id, story_id, unit_id, target, antecedent, support, evidence FROM mention), c AS (SELECT DISTINCT id, parents FROM context), e AS (SELECT id, unnest(parents) AS p FROM c), r AS (SELECT DISTINCT id, source, target, type FROM relation), l AS (SELECT DISTINCT id, "left" AS a, "right" AS b FROM identity_link), d AS (SELECT DISTINCT decision_id, operations FROM decision), o AS (SELECT decision_id, unnest(operations) AS x FROM d),
v AS (SELECT 'duplicate_id' AS rule, id FROM m GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'foreign_prefix', id FROM m WHERE NOT starts_with(id, story_id || ':')
UNION ALL SELECT 'null_target_not_unresolved', id FROM m WHERE target IS NULL AND support <> 'unresolved' UNION ALL SELECT 'missing_antecedent', id FROM m WHERE antecedent IS NOT NULL AND antecedent NOT IN (SELECT id FROM m) UNION ALL SELECT 'empty_span', id FROM m WHERE evidence.start_token >= evidence.end_token UNION ALL SELECT 'unanchored_evidence', id FROM m WHERE evidence.verbatim IS NULL
UNION ALL SELECT 'blank_target', id FROM m WHERE trim(target) = '' UNION ALL SELECT 'changed_quote', id FROM m WHERE evidence.quote <> evidence.verbatim UNION ALL SELECT DISTINCT 'missing_parent', id FROM e WHERE p IS NOT NULL AND p NOT IN (SELECT id FROM c) UNION ALL SELECT 'own_parent', id FROM c WHERE list_contains(parents, id) UNION ALL SELECT 'repeated_parent', id FROM c WHERE len(list_distinct(parents)) < len(list_filter(parents, lambda x: x IS NOT NULL))
UNION ALL SELECT 'open_relation', id FROM r WHERE source IS NULL OR target IS NULL UNION ALL SELECT 'relation_to_itself', id FROM r WHERE source = target UNION ALL SELECT 'link_to_itself', id FROM l WHERE a = b UNION ALL SELECT 'no_operations', CAST(decision_id AS VARCHAR) FROM d WHERE coalesce(len(operations), 0) = 0 UNION ALL SELECT DISTINCT 'operation_without_reason', CAST(decision_id AS VARCHAR) FROM o WHERE coalesce(trim(x.reason), '') = ''
UNION ALL SELECT 'no_object', CAST(draft_id AS VARCHAR) FROM (SELECT DISTINCT draft_id, graph FROM draft) WHERE NOT CASE WHEN json_valid(graph) THEN json_type(graph) = 'OBJECT' ELSE false END) SELECT rule, count(*) AS n FROM v GROUP BY rule"""
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: one select per rule over all record tables, all violations collected."""
    found = annotation.violations(*(table(spark, sf_dir, name) for name in ("mention", "context", "relation", "identity_link", "decision", "draft")))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT kind, fold, sha256('[\"' || kind || '\",\"' || fold || '\"]') AS job_id FROM (SELECT DISTINCT event_type AS kind FROM events), (SELECT r_name AS fold FROM region) WHERE kind <> 'error' OR fold <> 'ASIA'")
def job_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as product of options, with ids from their content, each once."""
    kinds, folds = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind")).distinct(), table(spark, sf_dir, "region").select(F.col("r_name").alias("fold"))
    jobs = kinds.crossJoin(folds).where("kind <> 'error' OR fold <> 'ASIA'")
    return jobs.withColumn("job_id", F.sha2(F.to_json(F.array("kind", "fold")), 256)).dropDuplicates(["job_id"])


@query("SELECT o_orderpriority AS stage, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 4 END * CAST(o_orderkey AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def byte_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper bound of bytes by stage."""
    size = F.when(F.col("o_orderstatus") == "F", 8).otherwise(4) * F.col("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.sum(size).alias("bytes"))


@query(f"WITH {_JOBS} SELECT j.job FROM j LEFT JOIN orders o ON o.o_orderkey = j.need WHERE j.need IS NULL OR o.o_orderstatus = 'F'")
def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose needs are all done."""
    j = _jobs(spark, sf_dir)
    undone = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("need"))
    blocked = j.where("need IS NOT NULL").join(undone, "need", "left_semi").select("job")
    return j.select("job").join(blocked, "job", "left_anti")


@query(
    """WITH d AS (SELECT DISTINCT id, story_id, type, source, target FROM relation), h AS (SELECT story_id, md5(concat_ws('|', id, type, coalesce(source, ''), coalesce(target, ''))) AS h FROM d), s AS (SELECT story_id, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b FROM h GROUP BY 1)
SELECT story_id, md5(n || '|' || a || '|' || b) AS digest, n FROM s"""
)
def build_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: digest of each story's artifact, whatever the order of its rows: from sums of the rows' digests, so that no story's rows meet in one place."""
    d = table(spark, sf_dir, "relation").select("id", "story_id", "type", "source", "target").distinct()
    row = F.md5(F.concat_ws("|", "id", "type", F.coalesce("source", F.lit("")), F.coalesce("target", F.lit(""))))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    summed = d.select("story_id", row.alias("h")).groupBy("story_id").agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return summed.select("story_id", F.md5(F.concat_ws("|", F.col("n").cast("string"), "a", "b")).alias("digest"), "n")


QUERIES, ORACLE = catalog.queries, catalog.oracle
