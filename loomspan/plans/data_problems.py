"""Queries of the data problems that belong to the core: p2, p3, p4 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import changefeed, hierarchy, nested, references
from loomspan.session import kept, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = changefeed.apply_changes(table(spark, sf_dir, "decision"))
    return state.select("unit_id", "record_id", "field", "revision")


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_found, with the present values."""
    return changefeed.apply_changes(table(spark, sf_dir, "decision"))


def p2_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_state, in two steps: the state after the third revision is the base into which the later changes are merged."""
    decisions = table(spark, sf_dir, "decision")
    base = changefeed.apply_changes(decisions.where("revision <= 3"))
    return changefeed.apply_changes(decisions.where("revision > 3"), base)


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, parents = references.story_references(*(table(spark, sf_dir, t) for t in ("draft", "mention", "relation", "identity_link")))
    gone = table(spark, sf_dir, "withdrawn_record").select(F.col("story_id").alias("scope"), F.col("record_id").alias("id"), F.col("withdrawn_utc").alias("at"))
    return references.orphans(refs, parents, gone)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return references.orphan_report(_orphans(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    draft = table(spark, sf_dir, "draft")
    return nested.node_table(draft, "graph", ["draft_id", "unit_id"], kinds=kinds)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir, ["entity", "trigger", "argument", "alternative"])
    parent = F.when(F.col("kind") == "entity", F.col("unit_id")).otherwise(F.col("owner_id"))
    return nodes.select("draft_id", "kind", parent.alias("parent_id"), "path").distinct()


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its interval label and its parent's."""
    return _nodes(spark, sf_dir).select("draft_id", "unit_id", "kind", "pre", "post", "level", "id", "parent_pre", "owner_id", "path").distinct()


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every draft with the arguments that lie in them by interval containment, and uncertainties with their alternatives at any depth."""
    nodes = kept(_nodes(spark, sf_dir).distinct())
    each = [nested.nodes_within(nodes, "draft_id", outer, inner).select("draft_id", F.lit(inner).alias("inner_kind"), "outer_id", "path") for outer, inner in (("event", "argument"), ("uncertainty", "alternative"))]
    return each[0].unionByName(each[1]).groupBy("draft_id", "inner_kind", "outer_id").agg(F.countDistinct("path").alias("n"))


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.expr(r"try_cast(regexp_extract(unit_id, '_u([0-9]+)$', 1) as bigint)")
    return hierarchy.links(table(spark, sf_dir, "context"), "id", "parents", "story_id", unit)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(_contexts(spark, sf_dir))


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.paths(_contexts(spark, sf_dir))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(_contexts(spark, sf_dir))


def p7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.subtree_sizes(kept(hierarchy.descendants(_contexts(spark, sf_dir))))


_CHANGES = """WITH d AS (SELECT DISTINCT ON (decision_id) decision_id, unit_id, revision, operations FROM decision ORDER BY decision_id, ingested_utc),
o AS (SELECT unit_id, revision, i, operations[i] AS x FROM (SELECT *, unnest(range(1, len(operations) + 1)) AS i FROM d)),
s AS (SELECT unit_id, x.id AS record_id, x.op AS op, x.field AS field, x.value AS value, revision, revision * 1000 + i AS seq FROM o WHERE x.id IS NOT NULL),
life AS (SELECT unit_id, record_id, arg_max(op, seq) AS op, max(seq) AS born FROM s WHERE op IN ('add', 'remove') GROUP BY ALL),
a AS (SELECT s.unit_id, s.record_id, s.revision, s.seq, CAST(s.value AS JSON) AS j FROM s JOIN life l ON l.unit_id = s.unit_id AND l.record_id = s.record_id AND l.op = 'add' AND l.born = s.seq),
leaf AS (SELECT a.unit_id, a.record_id, a.revision, a.seq, substr(t.fullkey, 3) AS field, CASE WHEN t.type = 'VARCHAR' THEN t.atom->>'$' ELSE CAST(t.atom AS VARCHAR) END AS value FROM a, json_tree(a.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY') AND t.fullkey <> '$.id'),
f AS (SELECT * FROM leaf UNION ALL SELECT s.unit_id, s.record_id, s.revision, s.seq, s.field, s.value FROM s JOIN life l ON l.unit_id = s.unit_id AND l.record_id = s.record_id AND l.op = 'add' AND s.seq > l.born WHERE s.op = 'set')
"""
_REFS = """WITH g AS (SELECT DISTINCT story_id, recorded_utc AS t, CAST(graph AS JSON) AS j FROM draft WHERE json_valid(graph) AND json_type(graph) = 'OBJECT'),
n AS (SELECT story_id, t, 'entities' AS c, unnest(CASE json_type(j, '$.entities') WHEN 'ARRAY' THEN json_extract(j, '$.entities[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.entities')] ELSE [] END) AS x FROM g
UNION ALL SELECT story_id, t, 'events' AS c, unnest(CASE json_type(j, '$.events') WHEN 'ARRAY' THEN json_extract(j, '$.events[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.events')] ELSE [] END) AS x FROM g
UNION ALL SELECT story_id, t, 'literals' AS c, unnest(CASE json_type(j, '$.literals') WHEN 'ARRAY' THEN json_extract(j, '$.literals[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.literals')] ELSE [] END) AS x FROM g),
known AS (SELECT story_id, x->>'$.id' AS id, min(t) AS since FROM n WHERE json_type(x) = 'OBJECT' GROUP BY ALL),
av AS (SELECT story_id, t, x->>'$.id' AS event, CASE json_type(x, '$.arguments') WHEN 'ARRAY' THEN json_extract(x, '$.arguments[*]') WHEN 'OBJECT' THEN [json_extract(x, '$.arguments')] ELSE [] END AS l FROM n WHERE c = 'events' AND json_type(x) = 'OBJECT'),
r AS (SELECT DISTINCT 'argument' AS ref_table, event AS record_id, CAST(i - 1 AS INTEGER) AS pos, story_id, l[i]->>'$.target' AS target, t FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM av) UNION SELECT 'mention', id, 0, story_id, target, recorded_utc FROM mention UNION SELECT 'relation', id, 0, story_id, source, recorded_utc FROM relation UNION SELECT 'identity_link', id, 0, story_id, "right", recorded_utc FROM identity_link),
w AS (SELECT story_id, record_id AS id, min(withdrawn_utc) AS gone FROM withdrawn_record GROUP BY ALL),
v AS (SELECT r.*, CASE WHEN k.id IS NULL THEN 'missing' WHEN k.since > r.t THEN 'later' WHEN w.gone <= r.t THEN 'removed' END AS reason FROM r LEFT JOIN known k ON k.story_id = r.story_id AND k.id = r.target LEFT JOIN w ON w.story_id = r.story_id AND w.id = r.target WHERE trim(r.target) <> ''),
o AS (SELECT DISTINCT ref_table, record_id, pos, reason, strftime(t, '%Y-%m') AS period FROM v WHERE reason IS NOT NULL)
"""
_NODES = """WITH RECURSIVE g AS (SELECT DISTINCT draft_id, unit_id, CAST(graph AS JSON) AS j FROM draft WHERE json_valid(graph) AND json_type(graph) = 'OBJECT'),
m AS (SELECT draft_id, unit_id, 'entities' AS c, CASE json_type(j, '$.entities') WHEN 'ARRAY' THEN json_extract(j, '$.entities[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.entities')] ELSE [] END AS l FROM g
UNION ALL SELECT draft_id, unit_id, 'events' AS c, CASE json_type(j, '$.events') WHEN 'ARRAY' THEN json_extract(j, '$.events[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.events')] ELSE [] END AS l FROM g
UNION ALL SELECT draft_id, unit_id, 'uncertainties' AS c, CASE json_type(j, '$.uncertainties') WHEN 'ARRAY' THEN json_extract(j, '$.uncertainties[*]') WHEN 'OBJECT' THEN [json_extract(j, '$.uncertainties')] ELSE [] END AS l FROM g),
n AS (SELECT draft_id, unit_id, c, i - 1 AS p, l[i] AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM m) WHERE json_type(l[i]) <> 'NULL'),
ar AS (SELECT draft_id, x->>'$.id' AS id, CASE json_type(x, '$.arguments') WHEN 'ARRAY' THEN json_extract(x, '$.arguments[*]') WHEN 'OBJECT' THEN [json_extract(x, '$.arguments')] ELSE [] END AS l FROM n WHERE c = 'events'),
alt AS (SELECT draft_id, x->>'$.id' AS id, '' AS path, x FROM n WHERE c = 'uncertainties' UNION ALL SELECT draft_id, id, CASE WHEN path = '' THEN '' ELSE path || '.' END || (i - 1), l[i] FROM (SELECT draft_id, id, path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT draft_id, id, path, CASE json_type(x, '$.alternatives') WHEN 'ARRAY' THEN json_extract(x, '$.alternatives[*]') WHEN 'OBJECT' THEN [json_extract(x, '$.alternatives')] ELSE [] END AS l FROM alt)) WHERE json_type(l[i]) <> 'NULL')
SELECT DISTINCT draft_id, kind, parent_id, path FROM (SELECT draft_id, 'entity' AS kind, unit_id AS parent_id, CAST(p AS VARCHAR) AS path FROM n WHERE c = 'entities' UNION ALL SELECT draft_id, 'trigger', x->>'$.id', '0' FROM n WHERE c = 'events' AND coalesce(json_type(x, '$.trigger'), 'NULL') <> 'NULL'
UNION ALL SELECT draft_id, 'argument', id, CAST(i - 1 AS VARCHAR) FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM ar) WHERE json_type(l[i]) <> 'NULL' UNION ALL SELECT draft_id, 'alternative', id, path FROM alt WHERE path <> '')"""
_TREE = """WITH RECURSIVE k AS (SELECT DISTINCT id FROM context), e AS (SELECT DISTINCT c.id, p FROM (SELECT id, unnest(parents) AS p FROM context) c JOIN k ON k.id = p),
up AS (SELECT id, p FROM e UNION SELECT up.id, e.p FROM up JOIN e ON e.id = up.p), loops AS (SELECT DISTINCT id FROM up WHERE id = p), bad AS (SELECT id FROM loops UNION SELECT up.id FROM up JOIN loops l ON l.id = up.p),
ok AS (SELECT id FROM k WHERE id NOT IN (SELECT id FROM bad)), walk AS (SELECT id, id AS node, 0 AS depth FROM ok UNION SELECT w.id, e.p, w.depth + 1 FROM walk w JOIN e ON e.id = w.node),
down AS (SELECT up.p AS id, up.id AS below FROM up), badb AS (SELECT id FROM loops UNION SELECT up.p FROM up JOIN loops l ON l.id = up.id), okb AS (SELECT id FROM k WHERE id NOT IN (SELECT id FROM badb)), walkb AS (SELECT id, id AS node, 0 AS depth FROM okb UNION SELECT w.id, e.id, w.depth + 1 FROM walkb w JOIN e ON e.p = w.node)
"""
ORACLE = {
    "p2_found": _CHANGES + "SELECT unit_id, record_id, field, arg_max(revision, seq) AS revision FROM f GROUP BY unit_id, record_id, field",
    "p2_state": _CHANGES + "SELECT unit_id, record_id, field, arg_max(value, seq) AS value, arg_max(revision, seq) AS revision FROM f GROUP BY unit_id, record_id, field",
    "p2_merged": _CHANGES + "SELECT unit_id, record_id, field, arg_max(value, seq) AS value, arg_max(revision, seq) AS revision FROM f GROUP BY unit_id, record_id, field",
    "p3_found": _REFS + "SELECT * FROM o",
    "p3_report": _REFS + "SELECT ref_table, period, reason, count(*) AS n_references, count(DISTINCT record_id) AS n_records FROM o GROUP BY ALL",
    "p4_found": _NODES,
    "p4_links": "WITH x AS (" + _NODES + ") SELECT draft_id, kind AS inner_kind, parent_id AS outer_id, count(*) AS n FROM x WHERE kind IN ('argument', 'alternative') GROUP BY ALL",
    "p7_found": _TREE + "SELECT id, node AS root, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE node NOT IN (SELECT id FROM e) GROUP BY ALL UNION ALL SELECT id, 'cycle', -1 FROM bad",
    "p7_descendants": _TREE + "SELECT id, node AS descendant, CAST(min(depth) AS INTEGER) AS distance FROM walkb GROUP BY ALL UNION ALL SELECT id, NULL, -1 FROM badb",
    "p7_sizes": _TREE + ", d AS (SELECT id, node, min(depth) AS depth FROM walkb GROUP BY ALL) SELECT id, count(*) - 1 AS n_descendants, CAST(max(depth) AS INTEGER) AS height FROM d GROUP BY id UNION ALL SELECT id, NULL, NULL FROM badb",
    "p7_paths": _TREE + ", t AS (SELECT id, id AS path, 0 AS depth FROM ok WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT e.id, t.path || '/' || e.id, t.depth + 1 FROM t JOIN e ON e.p = t.id JOIN ok ON ok.id = e.id) SELECT id, path, depth FROM t",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_state, p2_merged, p3_found, p3_report, p4_found, p4_nodes, p4_links, p7_found, p7_paths, p7_descendants, p7_sizes)}
