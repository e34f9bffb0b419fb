"""Queries of generated questions, feature groups and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import annotation, questions
from loomspan.plans.graphs import _GRAPH, _SAME
from loomspan.plans.registry import Catalog
from loomspan.session import kept

catalog = Catalog()
query = catalog.query

#: DuckDB: questions of all families but scopes (unit, family, variant, text, candidates, labels), and their judgement.
_ASKED = (
    _GRAPH
    + f""", {_SAME}, lit AS (SELECT DISTINCT unit_id, x->>'$.id' AS id FROM (SELECT unit_id, unnest(CASE json_type(j, '$.literals') WHEN 'ARRAY' THEN json_extract(j, '$.literals[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.literals')] ELSE [] END) AS x FROM g) WHERE json_type(x) <> 'NULL'),
ents AS (SELECT unit_id, list(DISTINCT id) AS items FROM en WHERE id IS NOT NULL GROUP BY 1), tgts AS (SELECT unit_id, list(DISTINCT id) AS items FROM (SELECT unit_id, id FROM en UNION SELECT unit_id, id FROM ev UNION SELECT unit_id, id FROM lit) WHERE id IS NOT NULL GROUP BY 1),
rels AS (SELECT list(DISTINCT type) AS items FROM relation WHERE type IS NOT NULL), ue AS (SELECT DISTINCT unit_id, id AS event FROM ev), ok AS (SELECT DISTINCT event, role, target FROM ar WHERE coalesce(support <> 'unresolved', true)),
pol AS (SELECT id AS event, CASE WHEN count(DISTINCT polarity) = 1 THEN nullif(min(polarity), 'unresolved') END AS p, min(polarity) AS lo FROM ev GROUP BY id),
m AS (SELECT DISTINCT id, unit_id, target, support, antecedent FROM mention),
q_concept AS (SELECT DISTINCT m.unit_id, 'concept_occurrence' AS family, '' AS variant, c.concept AS key, ['supported', 'contradicted'] AS items, ['supported'] AS labels FROM m JOIN (SELECT DISTINCT id, concept FROM en WHERE concept IS NOT NULL) c ON c.id = m.target),
q_reference AS (SELECT DISTINCT m.unit_id, 'reference', '', m.id, coalesce(ents.items, []), CASE WHEN m.target IS NULL THEN NULL ELSE coalesce((SELECT list(DISTINCT o.id) FROM k JOIN k o ON o.root = k.root WHERE k.id = m.target), [m.target]) END FROM m LEFT JOIN ents USING (unit_id) WHERE antecedent IS NOT NULL AND coalesce(support <> 'unresolved', true)),
roles AS (SELECT event, role, list(DISTINCT target) FILTER (WHERE target IS NOT NULL) AS labels FROM ok GROUP BY ALL), asked_roles AS (SELECT DISTINCT event, role FROM ar WHERE role IS NOT NULL),
q_role AS (SELECT u.unit_id, 'event_role', '', a.event || '/' || a.role, coalesce(tgts.items, []), r.labels FROM asked_roles a JOIN ue u USING (event) LEFT JOIN roles r ON r.event = a.event AND r.role = a.role LEFT JOIN tgts ON tgts.unit_id = u.unit_id),
q_polarity AS (SELECT u.unit_id, 'event_polarity', '', u.event, ['positive', 'negative'], CASE WHEN p IS NOT NULL THEN [p] END FROM ue u JOIN pol USING (event)),
b AS (SELECT u.unit_id, u.event, (SELECT min(polarity) FROM ev x WHERE x.id = u.event AND x.unit_id = u.unit_id) AS lo, list_sort(list(DISTINCT struct_pack(role := role, target := target))) AS b FROM ue u JOIN ar USING (event) WHERE role IS NOT NULL AND target IS NOT NULL GROUP BY ALL),
pairs AS (SELECT *, unnest(range(i + 1, len(b) + 1)) AS j FROM (SELECT *, unnest(range(1, len(b))) AS i FROM b)),
req AS (SELECT unit_id, event, b AS requested, unnest(['positive', 'negative']) AS polarity, 'polarity_contrast' AS variant FROM b UNION ALL SELECT unit_id, event, list_transform(b, lambda x, n: struct_pack(role := x.role, target := CASE WHEN n = i THEN b[j].target WHEN n = j THEN b[i].target ELSE x.target END)), lo, 'role_swap' FROM pairs WHERE b[i].role <> b[j].role AND b[i].target <> b[j].target AND lo IS NOT NULL),
act AS (SELECT event, list(struct_pack(role := role, target := target)) AS a FROM ok GROUP BY 1),
q_binding AS (SELECT r.unit_id, 'binding_verification', r.variant, r.event || CAST(r.requested AS VARCHAR) || r.polarity, ['supported', 'contradicted'], CASE WHEN a IS NOT NULL AND lo <> 'unresolved' AND len(list_filter(requested, lambda x: NOT list_contains(a, x))) = 0 THEN [CASE WHEN r.polarity = lo THEN 'supported' ELSE 'contradicted' END] END FROM req r LEFT JOIN act USING (event) LEFT JOIN (SELECT event, lo FROM pol) USING (event)),
rr AS (SELECT DISTINCT id, unit_id, type, source, target, list_sort(contexts) AS contexts FROM relation WHERE coalesce(support <> 'unresolved', true)), rt AS (SELECT source, target, contexts, list(DISTINCT type) FILTER (WHERE type IS NOT NULL) AS labels FROM rr GROUP BY ALL),
q_relation AS (SELECT DISTINCT rr.unit_id, 'event_relation', '', rr.source || '/' || rr.target || '/' || CAST(rr.contexts AS VARCHAR), (SELECT items FROM rels), rt.labels FROM rr JOIN rt ON rt.source = rr.source AND rt.target = rr.target AND rt.contexts = rr.contexts WHERE rr.source IS NOT NULL AND rr.target IS NOT NULL AND rr.contexts IS NOT NULL),
il AS (SELECT DISTINCT unit_id, least("left", "right") AS a, greatest("left", "right") AS b, relation FROM identity_link WHERE "left" IS NOT NULL AND "right" IS NOT NULL AND coalesce(support <> 'unresolved', true)), ir AS (SELECT a, b, CASE WHEN count(DISTINCT relation) = 1 THEN [min(relation)] END AS labels FROM il GROUP BY ALL),
q_identity AS (SELECT DISTINCT il.unit_id, 'identity_update', '', il.a || '/' || il.b, ['same', 'different', 'possible'], ir.labels FROM il JOIN ir USING (a, b)),
ck AS (SELECT DISTINCT id FROM context), ce AS (SELECT DISTINCT c.id, p FROM (SELECT id, unnest(parents) AS p FROM context) c JOIN ck ON ck.id = p), up AS (SELECT id, p FROM ce UNION SELECT up.id, ce.p FROM up JOIN ce ON ce.id = up.p), lpc AS (SELECT DISTINCT id FROM up WHERE id = p), badc AS (SELECT id FROM lpc UNION SELECT up.id FROM up JOIN lpc ON lpc.id = up.p),
anc AS (SELECT id, id AS a FROM ck WHERE id NOT IN (SELECT id FROM badc) UNION SELECT id, p FROM up WHERE id NOT IN (SELECT id FROM badc)), att AS (SELECT DISTINCT id, attribution FROM context WHERE attribution IS NOT NULL),
sp AS (SELECT DISTINCT x.event, att.attribution AS via FROM (SELECT DISTINCT id AS event, unnest(contexts) AS c FROM ev) x JOIN anc ON anc.id = x.c JOIN att ON att.id = anc.a WHERE att.attribution <> x.event),
steps AS (SELECT ok.event, 'argument_event' AS step, role AS by_, ok.target AS via FROM ok JOIN (SELECT DISTINCT event FROM ue) t ON t.event = ok.target UNION SELECT event, 'scope_parent', '', via FROM sp UNION SELECT source, 'event_relation', type, target FROM rr WHERE source IS NOT NULL AND type IS NOT NULL),
ch AS (SELECT s.event, s.step, s.by_, ok.role AS last, list(DISTINCT ok.target) AS labels FROM steps s JOIN ok ON ok.event = s.via WHERE ok.target IS NOT NULL GROUP BY ALL),
q_composed AS (SELECT u.unit_id, 'composed', ch.step, concat_ws('/', u.event, ch.step, coalesce(by_, '?'), coalesce(last, '?')), coalesce(tgts.items, []), ch.labels FROM ch JOIN ue u USING (event) LEFT JOIN tgts ON tgts.unit_id = u.unit_id),
asked AS (SELECT * FROM q_concept UNION ALL SELECT * FROM q_reference UNION ALL SELECT * FROM q_role UNION ALL SELECT * FROM q_polarity UNION ALL SELECT * FROM q_binding UNION ALL SELECT * FROM q_relation UNION ALL SELECT * FROM q_identity UNION ALL SELECT * FROM q_composed),
judged AS (SELECT *, len(items) AS n, coalesce(len(list_intersect(labels, items)), 0) AS h, CASE WHEN len(items) < 2 THEN 'no_alternative_candidates' WHEN labels IS NOT NULL AND len(list_intersect(labels, items)) < len(labels) THEN 'answer_is_no_candidate' WHEN labels IS NOT NULL AND len(labels) = len(items) THEN 'all_acceptable' END AS reason FROM asked)
"""
)


def _generated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return questions.generate(annotation.graph_view(spark, sf_dir))


@query(_ASKED + "SELECT family, variant, count(*) AS asked, count(*) FILTER (WHERE labels IS NOT NULL) AS labelled, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(h) AS BIGINT) AS acceptable FROM judged WHERE reason IS NULL GROUP BY ALL")
def question_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10, Q11: questions by family and variant, those with an answer, their candidates and how many of these are acceptable; scopes are in question_scopes."""
    asked = _generated(spark, sf_dir)[0].where("family <> 'event_scope'")
    return asked.groupBy("family", "variant").agg(
        F.count("*").alias("asked"), F.count_if(F.col("label_state") == "annotation_supported").alias("labelled"), F.sum("n_candidates").alias("candidates"), F.sum(F.size("acceptable")).alias("acceptable")
    )


@query(
    _ASKED
    + """, u AS (SELECT 'event_relation' AS family, 'unresolved_record' AS reason, count(DISTINCT id) AS n FROM relation WHERE support = 'unresolved' UNION ALL SELECT 'identity_update', 'unresolved_record', count(DISTINCT id) FROM identity_link WHERE support = 'unresolved')
SELECT family, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT * FROM u WHERE n > 0"""
)
def question_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: what was left out, by family and reason; scopes are in question_scopes."""
    return _generated(spark, sf_dir)[1].where("family <> 'event_scope'")


@query()
def question_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for the nested scope of events among those of their unit; nested digests have no SQL, so against a walk in the tests."""
    asked = _generated(spark, sf_dir)[0].where("family = 'event_scope'")
    return asked.select("query_id", "unit_id", "n_candidates", F.size("acceptable").alias("n_acceptable"), "label_state")


@query()
def scope_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every context with all that it stands in; against a walk in the tests."""
    return annotation.scope_profiles(annotation.graph_view(spark, sf_dir))


QUERIES, ORACLE = catalog.queries, catalog.oracle
