"""Further queries: generated questions, scope profiles, atoms, repairs, reuse, readouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators import annotation, changefeed, planning, relate
from loomspan.operators.graph import closure
from loomspan.plans.graphs import _GRAPH
from loomspan.plans.registry import Catalog
from loomspan.session import kept, table
from loomspan.sources.dataset import Dataset

catalog = Catalog()
query = catalog.query


@query(
    _GRAPH
    + """, d AS (SELECT DISTINCT unit_id, id, concept FROM en WHERE concept IS NOT NULL), q AS (SELECT DISTINCT v.unit_id, a.event, a.role FROM ar a JOIN (SELECT DISTINCT id, unit_id FROM ev) v ON v.id = a.event),
c AS (SELECT unit_id, list_sort(list(DISTINCT concept)) AS candidates FROM d GROUP BY unit_id), gq AS (SELECT q.unit_id, q.event, q.role, list(DISTINCT x.concept) AS gold FROM q JOIN ar a ON a.event = q.event AND a.role = q.role AND coalesce(a.support <> 'unresolved', true) JOIN (SELECT DISTINCT id, concept FROM d) x ON x.id = a.target GROUP BY ALL)
SELECT event, role, len(candidates) AS n_candidates, len(list_intersect(candidates, gold)) AS n_acceptable FROM gq JOIN c USING (unit_id) WHERE len(candidates) >= 2 AND len(list_intersect(candidates, gold)) BETWEEN 1 AND len(candidates) - 1"""
)
def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10, Q11: questions for role fillers among the concepts of the unit; those with fewer than two candidates, with no or only acceptable ones are left out."""
    view = annotation.graph_view(spark, sf_dir)
    concept = view.entities.where("concept IS NOT NULL").select("unit_id", "id", "concept").distinct()
    candidates = concept.groupBy("unit_id").agg(F.array_sort(F.collect_set("concept")).alias("candidates"))
    named = concept.select(F.col("id").alias("target"), "concept").distinct()
    event = view.events.select(F.col("id").alias("event"), "unit_id").distinct()
    gold = view.arguments.drop("unit_id").where(annotation.resolved()).join(named, "target").join(event, "event").groupBy("unit_id", "event", "role").agg(F.collect_set("concept").alias("gold"))
    counted = gold.join(candidates, "unit_id").select("event", "role", F.size("candidates").cast("long").alias("n_candidates"), F.size(F.array_intersect("candidates", "gold")).cast("long").alias("n_acceptable"))
    return counted.where("n_candidates >= 2 AND n_acceptable BETWEEN 1 AND n_candidates - 1")


@query(
    """WITH RECURSIVE k AS (SELECT id, min(kind) AS kind FROM context GROUP BY id), e AS (SELECT c.id, min(p) AS p FROM (SELECT id, unnest(parents) AS p FROM context) c JOIN k ON k.id = p GROUP BY c.id), w AS (SELECT id, id AS node, 0 AS d FROM k UNION ALL SELECT w.id, e.p, d + 1 FROM w JOIN e ON e.id = w.node WHERE d < 200)
SELECT id, CASE WHEN max(d) < 200 THEN arg_max(node, d) END AS "end" FROM w WHERE id IN (SELECT id FROM e) GROUP BY id"""
)
def pointer_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End of every chain of first parents; circles have none."""
    c = table(spark, sf_dir, "context")
    edges = c.select("id", F.explode("parents").alias("p")).join(c.select(F.col("id").alias("p")).distinct(), "p", "left_semi")
    return planning.follow(edges, "id", "p")


@query(
    """WITH RECURSIVE k AS (SELECT id, min(kind) AS kind FROM context GROUP BY id), e AS (SELECT DISTINCT c.id, p FROM (SELECT id, unnest(parents) AS p FROM context) c JOIN k ON k.id = p), t AS (SELECT id, p FROM e UNION SELECT t.id, e.p FROM t JOIN e ON e.id = t.p)
SELECT k.id, k.kind || coalesce('<' || string_agg(DISTINCT a.kind, ',' ORDER BY a.kind), '') AS profile FROM k LEFT JOIN t ON t.id = k.id LEFT JOIN k a ON a.id = t.p GROUP BY k.id, k.kind"""
)
def scope_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every context with the kinds of all contexts around it."""
    c = table(spark, sf_dir, "context")
    kinds = kept(c.groupBy("id").agg(F.min("kind").alias("kind")))
    edges = c.select("id", F.explode("parents").alias("p")).join(kinds.select(F.col("id").alias("p")), "p", "left_semi")
    around = closure(edges, "id", "p").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("_k")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("_k")), ",").alias("_a"))
    return kinds.join(around, "id", "left").select("id", F.concat("kind", F.coalesce(F.concat(F.lit("<"), "_a"), F.lit(""))).alias("profile"))


@query(
    _GRAPH
    + """, x AS (SELECT unit_id, 'event:' || predicate AS atom FROM ev UNION SELECT unit_id, 'polarity:' || predicate || ':' || polarity FROM ev UNION SELECT v.unit_id, 'argument:' || v.predicate || ':' || a.role FROM ar a JOIN ev v ON v.id = a.event UNION SELECT unit_id, 'entity:' || concept FROM en
UNION SELECT unit_id, 'relation:' || type FROM relation UNION SELECT unit_id, 'context:' || kind FROM context UNION SELECT unit_id, 'identity:' || relation FROM identity_link UNION SELECT unit_id, 'mention:' || form FROM mention)
SELECT split_part(atom, ':', 1) AS family, count(*) AS n, count(DISTINCT atom) AS n_distinct FROM x WHERE atom IS NOT NULL GROUP BY 1"""
)
def semantic_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: atoms of eight families on which two annotations are compared."""
    view = annotation.graph_view(spark, sf_dir)
    events = view.events
    named = view.arguments.drop("unit_id").join(events.select(F.col("id").alias("event"), "predicate", "unit_id").distinct(), "event")
    atom = lambda df, family, *columns: df.select("unit_id", F.lit(family).alias("family"), F.concat(*[F.col(c) if i == 0 else F.concat(F.lit(":"), c) for i, c in enumerate(columns)]).alias("atom"))
    each = [
        atom(events, "event", "predicate"), atom(events, "polarity", "predicate", "polarity"), atom(named, "argument", "predicate", "role"), atom(view.entities, "entity", "concept"),
        atom(view.relations, "relation", "type"), atom(view.contexts, "context", "kind"), atom(view.identity_links, "identity", "relation"), atom(view.mentions, "mention", "form"),
    ]
    whole = each[0]
    for e in each[1:]:
        whole = whole.unionByName(e)
    return whole.where("atom IS NOT NULL").distinct().groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("atom").alias("n_distinct"))


@query(
    _GRAPH
    + """, m AS (SELECT DISTINCT id, unit_id, target FROM mention WHERE target IS NOT NULL AND trim(target) <> ''), known AS (SELECT id FROM en UNION SELECT id FROM ev), o AS (SELECT * FROM m WHERE target NOT IN (SELECT id FROM known)), c AS (SELECT unit_id, string_agg(DISTINCT id, ',' ORDER BY id) AS choices FROM en GROUP BY unit_id)
SELECT o.id, o.target, coalesce(choices, '') AS choices FROM o LEFT JOIN c USING (unit_id)"""
)
def repair_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: references that name no entity or event, with the entities of the unit to choose from."""
    view = annotation.graph_view(spark, sf_dir)
    known = view.entities.select(F.col("id").alias("target")).union(view.events.select("id")).distinct()
    choices = view.entities.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("choices"))
    broken = view.mentions.where("trim(target) <> ''").select("id", "unit_id", "target").distinct().join(known, "target", "left_anti")
    return broken.join(choices, "unit_id", "left").select("id", "target", F.coalesce("choices", F.lit("")).alias("choices"))


@query(
    """WITH d AS (SELECT id, min(unit_id) AS unit_id, min(evidence.char_start) AS a, max(evidence.char_end) AS b FROM mention GROUP BY id), h AS (SELECT unit_id, min(a) AS lo, max(b) AS hi FROM d GROUP BY unit_id), r AS (SELECT DISTINCT id, unit_id, evidence.char_start AS s, evidence.char_end AS e FROM relation WHERE evidence.char_start IS NOT NULL)
SELECT id, least(s, coalesce(lo, s)) AS hull_start, greatest(e, coalesce(hi, e)) AS hull_end, least(s, coalesce(lo, s)) < s OR greatest(e, coalesce(hi, e)) > e AS widened FROM r LEFT JOIN h USING (unit_id)"""
)
def evidence_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: evidence widened so that it holds the mentions of its unit, and whether that was needed."""
    m = table(spark, sf_dir, "mention").groupBy("id").agg(F.min("unit_id").alias("unit_id"), F.min("evidence.char_start").alias("a"), F.max("evidence.char_end").alias("b"))
    hull = m.groupBy("unit_id").agg(F.min("a").alias("lo"), F.max("b").alias("hi"))
    r = table(spark, sf_dir, "relation").select("id", "unit_id", F.col("evidence.char_start").alias("s"), F.col("evidence.char_end").alias("e")).where("s IS NOT NULL").distinct()
    low, high = F.least("s", F.coalesce("lo", "s")), F.greatest("e", F.coalesce("hi", "e"))
    return r.join(hull, "unit_id", "left").select("id", low.alias("hull_start"), high.alias("hull_end"), ((low < F.col("s")) | (high > F.col("e"))).alias("widened"))


@query(
    """WITH a AS (SELECT story_id, segment, response_raw_indices AS r, tr_centers_story_seconds AS c FROM alignment), v AS (SELECT 'length' AS rule FROM a WHERE len(r) <> len(c) UNION ALL SELECT 'repeated_row' FROM a WHERE len(list_distinct(r)) <> len(r) UNION ALL SELECT 'short' FROM a WHERE len(r) < 48
UNION ALL SELECT 'unknown_centre' FROM a WHERE len(list_filter(c, lambda x: x IS NULL OR isnan(x))) > 0 UNION ALL SELECT 'out_of_order' FROM a WHERE list_sort(r) <> r UNION ALL SELECT 'missing_row' FROM a WHERE list_max(r) - list_min(r) + 1 <> len(list_distinct(r)) UNION ALL SELECT 'delivered_again' FROM (SELECT story_id, segment FROM a GROUP BY ALL HAVING count(*) > 1)) SELECT rule, count(*) AS n FROM v GROUP BY rule"""
)
def release_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: what of the scan tables breaks the contract, by rule."""
    a = table(spark, sf_dir, "alignment").select("story_id", "segment", F.col("response_raw_indices").alias("r"), F.col("tr_centers_story_seconds").alias("c"))
    distinct = F.array_distinct("r")
    found = F.array(
        F.when(F.size("r") != F.size("c"), "length"), F.when(F.size(distinct) != F.size("r"), "repeated_row"), F.when(F.size("r") < 48, "short"),
        F.when(F.exists("c", lambda x: x.isNull() | F.isnan(x)), "unknown_centre"), F.when(F.array_sort("r") != F.col("r"), "out_of_order"),
        F.when(F.array_max("r") - F.array_min("r") + 1 != F.size(distinct), "missing_row"),
    )
    each = a.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))
    again = a.groupBy("story_id", "segment").count().where("count > 1").select(F.lit("delivered_again").alias("rule"))
    return each.unionAll(again).groupBy("rule").agg(F.count("*").alias("n"))


@query("WITH i AS (SELECT DISTINCT draft_id AS id, md5(coalesce(graph, '')) AS h, status FROM draft), f AS (SELECT h, min(id) AS first FROM i WHERE status = 'rejected' GROUP BY h) SELECT id, first AS reused FROM i LEFT JOIN f USING (h)")
def draft_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier work of equal inputs, by digest."""
    i = table(spark, sf_dir, "draft").select(F.col("draft_id").alias("id"), F.md5(F.coalesce("graph", F.lit(""))).alias("h"), "status").distinct()
    return planning.reused(i, i.where("status = 'rejected'"), ["h"]).select("id", "reused")


@query("SELECT story_id, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (ingested_utc) FROM relation) GROUP BY story_id")
def records_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct records of a kind from an opened data directory."""
    return Dataset(spark, sf_dir).records("relation").groupBy("story_id").agg(F.count("*").alias("n"))


@query()
def linear_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out answers of a multinomial readout; fitted, so against held-out accuracy in the tests."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    out = planning.linear_readout(e.where("vec_id % 5 > 0"), e.where("vec_id % 5 = 0"), "x", "label")
    return out.select("vec_id", "label", F.col("predicted").cast("int").alias("predicted"))


@query(_GRAPH + "SELECT DISTINCT ev.id AS event, c.kind FROM (SELECT id, unnest(contexts) AS c FROM ev WHERE polarity = 'negative') ev JOIN context c ON c.id = ev.c WHERE c.kind IN ('hypothetical', 'desired', 'questioned')")
def negative_modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative events that stand in a modal context too, where either may be redundant."""
    view = annotation.graph_view(spark, sf_dir)
    denied = view.events.where("polarity = 'negative'").select(F.col("id").alias("event"), F.explode("contexts").alias("context"))
    modal = view.contexts.where("kind IN ('hypothetical', 'desired', 'questioned')").select(F.col("id").alias("context"), "kind")
    return denied.join(modal, "context").select("event", "kind").distinct()


@query(
    "WITH c AS (SELECT user_id % 40 AS subject, CAST(ts AS DATE) AS day, event_type, round(avg(value), 4) AS v FROM events GROUP BY ALL) SELECT a.subject, strftime(a.day, '%Y-%m-%d') AS day, a.v, b.v AS comparator FROM c a LEFT JOIN c b ON b.subject = a.subject AND b.day = a.day AND b.event_type = 'click' WHERE a.event_type = 'view'"
)
def comparator_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each observation with the one of the other family under the same keys, of which there may be at most one."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("subject"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    cells = e.groupBy("subject", "day", "event_type").agg(F.round(F.avg("value"), 4).alias("v"))
    side = lambda name: cells.where(F.col("event_type") == name).drop("event_type")
    return relate.comparator(side("view"), ["subject", "day"], side("click"), "v")


@query(
    """WITH d AS (SELECT DISTINCT decision_id, unit_id, revision, status FROM decision), h AS (SELECT *, md5(concat_ws('|', unit_id, revision, decision_id, status)) AS digest FROM d), p AS (SELECT *, lag(digest) OVER (PARTITION BY unit_id ORDER BY revision, decision_id) AS before FROM h)
SELECT decision_id, unit_id FROM p WHERE (CASE WHEN md5('x' || decision_id) < '08' THEN md5(coalesce(before, '')) ELSE before END) IS DISTINCT FROM before"""
)
def broken_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions whose stored parent digest is not that of the decision before; about one in thirty is made to hold another."""
    d = table(spark, sf_dir, "decision").select("decision_id", "unit_id", "revision", "status").distinct()
    digest = F.md5(F.concat_ws("|", "unit_id", F.col("revision").cast("string"), F.col("decision_id").cast("string"), "status"))
    before = F.lag("digest").over(Window.partitionBy("unit_id").orderBy("revision", "decision_id"))
    stored = d.withColumn("digest", digest).withColumn("parent", before)
    spoilt = stored.withColumn("parent", F.when(F.md5(F.concat(F.lit("x"), F.col("decision_id").cast("string"))) < "08", F.md5(F.coalesce("parent", F.lit("")))).otherwise(F.col("parent")))
    return relate.broken_links(spoilt, "unit_id", ["revision", "decision_id"], "digest", "parent").select("decision_id", "unit_id")


@query(_GRAPH + ", e AS (SELECT DISTINCT id, predicate FROM ev) SELECT DISTINCT r.id, r.type, a.predicate AS source_predicate, b.predicate AS target_predicate FROM relation r LEFT JOIN e a ON a.id = r.source LEFT JOIN e b ON b.id = r.target")
def relation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with the predicates of both events that they link."""
    view = annotation.graph_view(spark, sf_dir)
    named = lambda end: view.events.select(F.col("id").alias(end), F.col("predicate").alias(f"{end}_predicate")).distinct()
    ends = view.relations.select("id", "type", "source", "target").distinct().join(named("source"), "source", "left").join(named("target"), "target", "left")
    return ends.select("id", "type", "source_predicate", "target_predicate").distinct()


@query(
    """WITH d AS (SELECT DISTINCT ON (decision_id) decision_id, operations FROM decision ORDER BY decision_id, ingested_utc), o AS (SELECT decision_id, i, operations[i] AS x FROM (SELECT *, unnest(range(1, len(operations) + 1)) AS i FROM d)), n AS (SELECT DISTINCT id, md5(id) AS new FROM relation)
SELECT decision_id, string_agg(coalesce(n.new, x.id, '-'), ',' ORDER BY i) AS ids FROM o LEFT JOIN n ON n.id = x.id GROUP BY decision_id"""
)
def renamed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of every decision with the ids of relations renamed, in their order."""
    d = table(spark, sf_dir, "decision").groupBy("decision_id").agg(F.min_by("operations", "ingested_utc").alias("operations"))
    names = table(spark, sf_dir, "relation").select(F.col("id").alias("old"), F.md5("id").alias("new")).distinct()
    made = relate.renamed(d, "decision_id", "operations", "id", names).where(F.size("operations") > 0)
    return made.select("decision_id", F.array_join(F.transform("operations", lambda x: F.coalesce(x["id"], F.lit("-"))), ",").alias("ids"))


@query(
    """WITH d AS (SELECT DISTINCT ON (decision_id) decision_id, unit_id, revision, operations FROM decision ORDER BY decision_id, ingested_utc), o AS (SELECT unit_id, revision, i, operations[i] AS x FROM (SELECT *, unnest(range(1, len(operations) + 1)) AS i FROM d)),
s AS (SELECT unit_id, x.id AS record_id, x.op AS op, x.field AS field, x.value AS value, x.before AS before, revision * 1000 + i AS seq FROM o WHERE x.id IS NOT NULL AND x.op IN ('add', 'set', 'remove')),
w AS (SELECT *, last_value(CASE WHEN op <> 'set' THEN op END IGNORE NULLS) OVER e AS life, last_value(CASE WHEN op <> 'set' THEN seq END IGNORE NULLS) OVER e AS born FROM s WINDOW e AS (PARTITION BY unit_id, record_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leaf AS (SELECT unit_id, record_id, seq, substr(t.fullkey, 3) AS field, CASE WHEN t.type = 'VARCHAR' THEN t.atom->>'$' ELSE CAST(t.atom AS VARCHAR) END AS value FROM (SELECT *, CAST(value AS JSON) AS j FROM s WHERE op = 'add') a, json_tree(a.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND t.fullkey <> '$.id'),
v AS (SELECT unit_id, record_id, field, seq, value, NULL AS before, NULL AS born FROM leaf UNION ALL SELECT unit_id, record_id, field, seq, value, before, born FROM w WHERE op = 'set' AND field IS NOT NULL AND life = 'add'),
p AS (SELECT *, lag(value) OVER k AS prior, lag(seq) OVER k AS prior_seq FROM v WINDOW k AS (PARTITION BY unit_id, record_id, field ORDER BY seq)),
r AS (SELECT CASE WHEN before IS NULL THEN 'unstated' WHEN before IS NOT DISTINCT FROM CASE WHEN prior_seq >= born THEN prior END THEN 'holds' ELSE 'differs' END AS verdict FROM p WHERE born IS NOT NULL UNION ALL SELECT 'no_record' FROM w WHERE op = 'set' AND field IS NOT NULL AND life IS DISTINCT FROM 'add') SELECT verdict, count(*) AS n FROM r GROUP BY 1"""
)
def before_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: whether changes of fields state rightly what was there before."""
    return changefeed.checked_changes(table(spark, sf_dir, "decision")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    _GRAPH
    + """, x AS (SELECT DISTINCT id AS event, unnest(contexts) AS context FROM ev), c AS (SELECT DISTINCT id, kind, holder, attribution, coalesce(support <> 'unresolved', true) AS resolved FROM context), h AS (SELECT id, min(concept) AS holder_concept FROM en GROUP BY id), p AS (SELECT id, min(predicate) AS attribution_predicate FROM ev GROUP BY id)
SELECT DISTINCT x.event, x.context, c.kind, h.holder_concept, p.attribution_predicate, c.resolved FROM x JOIN c ON c.id = x.context LEFT JOIN h ON h.id = c.holder LEFT JOIN p ON p.id = c.attribution"""
)
def scope_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the scopes of every event with whose they are and by what they are told."""
    return annotation.scope_bindings(annotation.graph_view(spark, sf_dir))


QUERIES, ORACLE = catalog.queries, catalog.oracle
