"""The annotation graph as tables, and its typed query language with three-valued answers.

A query asks for labels; its answer is the sorted array of the labels that the annotation supports, or null where none is
justified. Null never means no.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomspan.operators import hierarchy
from loomspan.operators.graph import equivalence_classes
from loomspan.operators.nested import is_object, node_table
from loomspan.session import kept, table


@dataclass(frozen=True)
class GraphView:
    """Distinct records of the annotation graph. All have ``story_id`` and ``unit_index``, from which they are available."""

    entities: DataFrame
    events: DataFrame
    arguments: DataFrame
    mentions: DataFrame
    relations: DataFrame
    identity_links: DataFrame
    contexts: DataFrame
    literals: DataFrame

    def at(self, unit_index: int) -> GraphView:
        """The graph as it is at the end of a unit: nothing later is seen."""
        return GraphView(*(f.where(F.col("unit_index") <= unit_index) for f in (self.entities, self.events, self.arguments, self.mentions, self.relations, self.identity_links, self.contexts, self.literals)))


def graph_view(spark: SparkSession, sf_dir: str) -> GraphView:
    """The graph view of a data directory; drafts are parsed once."""
    draft = table(spark, sf_dir, "draft").where("status = 'accepted'")
    attributes = ("label", "concept", "predicate", "polarity", "tense", "role", "mention", "support", "contexts")
    nodes = kept(node_table(draft, "graph", ["story_id", "unit_id", "unit_index"], kinds=["entity", "event", "argument", "literal"], attributes=attributes))
    unit = lambda df: df.withColumn("unit_index", F.expr(r"try_cast(regexp_extract(unit_id, '_u([0-9]+)$', 1) as int)"))
    each = lambda name, *columns: unit(table(spark, sf_dir, name)).select("id", "story_id", "unit_id", "unit_index", *columns).distinct()
    place = ["story_id", "unit_id", "unit_index"]
    return GraphView(
        nodes.where("kind = 'entity'").select(*place, "id", "label", "concept").distinct(),
        nodes.where("kind = 'event'").select(*place, "id", "predicate", "polarity", "tense", F.from_json("contexts", T.ArrayType(T.StringType())).alias("contexts")).distinct(),
        nodes.where("kind = 'argument'").select(*place, F.col("owner_id").alias("event"), "place", "role", "target", "mention", "support").distinct(),
        each("mention", "target", "form", "support", "antecedent", F.col("evidence.start_token").alias("start_token"), F.col("evidence.quote").alias("quote")),
        each("relation", "type", "source", "target", "contexts", "support"),
        each("identity_link", F.col("left").alias("left_id"), F.col("right").alias("right_id"), "relation", "support"),
        each("context", "kind", "holder", "attribution", "parents", "support"),
        nodes.where("kind = 'literal'").select(*place, "id").distinct(),
    )


def resolved(support: str = "support") -> Column:
    """Whether a record's support lets it justify an answer."""
    return F.coalesce(F.col(support) != "unresolved", F.lit(True))


def _answers(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Every query with its sorted distinct labels, null without any."""
    labels = found.where("label IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return queries.select("query_id").distinct().join(labels, "query_id", "left")


def q_concept(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, unit_id, concept``: supported if an entity of the concept is mentioned in the unit."""
    m = view.mentions.join(view.entities.select(F.col("id").alias("target"), "concept").distinct(), "target").select("unit_id", "concept").distinct()
    return _answers(queries, queries.join(m, ["unit_id", "concept"]).select("query_id", F.lit("supported").alias("label")))


def q_role(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, event, role``: targets of the resolved arguments with the role."""
    a = view.arguments.where(resolved()).select("event", "role", F.col("target").alias("label"))
    return _answers(queries, queries.join(a, ["event", "role"]).select("query_id", "label"))


def q_reference(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, mention``: all that is the same as what the mention names, itself included; null if it is unresolved."""
    links = view.identity_links.where(resolved())
    classes = equivalence_classes(links.where("relation = 'same'"), links.where("relation = 'different'"), "left_id", "right_id")
    members = classes.select("root", F.col("id").alias("member"))
    target = view.mentions.where(resolved() & F.col("target").isNotNull()).select(F.col("id").alias("mention"), "target").distinct()
    own = queries.join(target, "mention").join(classes.withColumnRenamed("id", "target"), "target", "left").join(members, "root", "left")
    return _answers(queries, own.select("query_id", F.coalesce("member", "target").alias("label")))


def q_polarity(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, event``: the polarity, unless unresolved or recorded differently."""
    p = view.events.groupBy(F.col("id").alias("event")).agg(F.collect_set("polarity").alias("p")).where(F.size("p") == 1)
    label = F.nullif(F.col("p")[0], F.lit("unresolved"))
    return _answers(queries, queries.join(p, "event").select("query_id", label.alias("label")))


def q_status(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, event``: digest of the kinds of the event's contexts; null where one of them is unresolved or not there."""
    each = view.events.select(F.col("id").alias("event"), F.explode_outer("contexts").alias("context")).distinct()
    c = view.contexts.groupBy(F.col("id").alias("context")).agg(F.min("kind").alias("kind"), F.min(resolved()).alias("ok"))
    profile = each.join(c, "context", "left").groupBy("event").agg(F.min(F.col("context").isNull() | F.coalesce("ok", F.lit(False))).alias("ok"), F.array_sort(F.collect_list("kind")).alias("kinds"))
    label = F.when(F.col("ok"), F.sha2(F.to_json("kinds"), 256))
    return _answers(queries, queries.join(profile, "event").select("query_id", label.alias("label")))


def _unit_number() -> Column:
    return F.expr(r"try_cast(regexp_extract(unit_id, '_u([0-9]+)$', 1) as bigint)")


def scope_bindings(view: GraphView) -> DataFrame:
    """Contexts of every event: ``event, context, kind, holder_concept, attribution_predicate, resolved``; a context that is not there gives no row."""
    each = view.events.select(F.col("id").alias("event"), F.explode("contexts").alias("context")).distinct()
    c = view.contexts.select(F.col("id").alias("context"), "kind", "holder", "attribution", resolved().alias("resolved")).distinct()
    concept = view.entities.groupBy(F.col("id").alias("holder")).agg(F.min("concept").alias("holder_concept"))
    predicate = view.events.groupBy(F.col("id").alias("attribution")).agg(F.min("predicate").alias("attribution_predicate"))
    joined = each.join(c, "context").join(concept, "holder", "left").join(predicate, "attribution", "left")
    return joined.select("event", "context", "kind", "holder_concept", "attribution_predicate", "resolved").distinct()


def scope_profiles(view: GraphView) -> DataFrame:
    """Digest of every context with all that it stands in: ``context, digest``; null on a loop.

    A context is its kind, the concept of its holder and the predicate of the event that it is attributed to; ids and places play no part, so profiles compare across stories.
    """
    c = view.contexts
    concept = view.entities.groupBy(F.col("id").alias("holder")).agg(F.min("concept").alias("_concept"))
    predicate = view.events.groupBy(F.col("id").alias("attribution")).agg(F.min("predicate").alias("_predicate"))
    own = c.select("id", "kind", "holder", "attribution").distinct().join(concept, "holder", "left").join(predicate, "attribution", "left")
    own = own.select("id", F.to_json(F.struct("kind", F.col("_concept").alias("holder"), F.col("_predicate").alias("attribution"))).alias("text"))
    nodes = hierarchy.links(c.withColumn("_at", _unit_number()), "id", "parents", "story_id", F.col("_at"))
    return hierarchy.nested_digests(nodes, own, "text").withColumnRenamed("id", "context")


def q_scope(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, event``: digest of the nested profiles of the event's contexts; null where one of them is unresolved, not there or on a loop."""
    each = view.events.select(F.col("id").alias("event"), F.explode_outer("contexts").alias("context")).distinct()
    ok = view.contexts.groupBy(F.col("id").alias("context")).agg(F.min(resolved()).alias("ok"))
    joined = each.join(scope_profiles(view), "context", "left").join(ok, "context", "left")
    profile = joined.groupBy("event").agg(F.min(F.col("context").isNull() | (F.coalesce("ok", F.lit(False)) & F.col("digest").isNotNull())).alias("ok"), F.array_sort(F.collect_set("digest")).alias("digests"))
    label = F.when(F.col("ok"), F.sha2(F.to_json("digests"), 256))
    return _answers(queries, queries.join(profile, "event").select("query_id", label.alias("label")))


def scope_parents(view: GraphView) -> DataFrame:
    """Events to which an event's contexts, or contexts around these, are attributed: ``event, parent``, distinct, without the event itself."""
    nodes = hierarchy.links(view.contexts.withColumn("_at", _unit_number()), "id", "parents", "story_id", F.col("_at"))
    around = hierarchy.ancestors(nodes).where("ancestor IS NOT NULL").select(F.col("id").alias("context"), "ancestor")
    source = view.contexts.where("attribution IS NOT NULL").select(F.col("id").alias("ancestor"), F.col("attribution").alias("parent")).distinct()
    within = view.events.select(F.col("id").alias("event"), F.explode("contexts").alias("context")).distinct()
    return within.join(around, "context").join(source, "ancestor").where("event <> parent").select("event", "parent").distinct()


def q_relation(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, source, target, contexts``: types of the resolved relations between both with equal contexts."""
    r = view.relations.where(resolved()).select("source", "target", F.array_sort("contexts").alias("contexts"), F.col("type").alias("label"))
    asked = queries.withColumn("contexts", F.array_sort("contexts"))
    return _answers(queries, asked.join(r, ["source", "target", "contexts"]).select("query_id", "label"))


def q_identity(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, left_id, right_id`` in any order: the one label of the resolved links; null where there are none or several."""
    pair = F.array_sort(F.array("left_id", "right_id")).alias("pair")
    links = view.identity_links.where(resolved()).select(pair, "relation").groupBy("pair").agg(F.collect_set("relation").alias("r")).where(F.size("r") == 1)
    return _answers(queries, queries.select("query_id", pair).join(links, "pair").select("query_id", F.col("r")[0].alias("label")))


def q_binding(view: GraphView, queries: DataFrame) -> DataFrame:
    """``query_id, event, requested (array of role, target), polarity``: supported or contradicted if all requested arguments are there."""
    actual = view.arguments.where(resolved()).groupBy("event").agg(F.collect_set(F.struct("role", "target")).alias("actual"))
    polarity = view.events.groupBy(F.col("id").alias("event")).agg(F.min("polarity").alias("is")).where("is <> 'unresolved'")
    met = queries.join(actual, "event").join(polarity, "event").where((F.size("requested") > 0) & (F.size(F.array_except("requested", "actual")) == 0))
    return _answers(queries, met.select("query_id", F.when(F.col("polarity") == F.col("is"), "supported").otherwise("contradicted").alias("label")))


def q_compose(view: GraphView, queries: DataFrame, steps: list[dict]) -> DataFrame:
    """``query_id, event``: what up to three steps reach from the event.

    Steps: ``{"op": "role" | "argument_event", "role": r}``, ``{"op": "event_relation", "relation": t, "direction": "out" | "in"}``, ``{"op": "scope_parent"}``.
    """
    if not 1 <= len(steps) <= 3:
        raise ValueError("one to three steps")
    current = queries.select("query_id", F.col("event").alias("node")).distinct()
    for step in steps:
        if step["op"] in ("role", "argument_event"):
            edges = view.arguments.where(resolved() & (F.col("role") == step["role"])).select(F.col("event").alias("node"), F.col("target").alias("next"))
            if step["op"] == "argument_event":
                edges = edges.join(view.events.select(F.col("id").alias("next")).distinct(), "next", "left_semi")
        elif step["op"] == "event_relation":
            ends = ("source", "target") if step["direction"] == "out" else ("target", "source")
            edges = view.relations.where(resolved() & (F.col("type") == step["relation"])).select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("next"))
        elif step["op"] == "scope_parent":
            edges = scope_parents(view).select(F.col("event").alias("node"), F.col("parent").alias("next"))
        else:
            raise ValueError(f"unknown step {step['op']}")
        current = current.join(edges.distinct(), "node").select("query_id", F.col("next").alias("node")).distinct()
    return _answers(queries, current.select("query_id", F.col("node").alias("label")))


_FIELDS = {
    "concept": {"unit_id": "string", "concept": "string"},
    "role": {"event": "string", "role": "string"},
    "reference": {"mention": "string"},
    "status": {"event": "string"},
    "scope": {"event": "string"},
    "polarity": {"event": "string"},
    "relation": {"source": "string", "target": "string", "contexts": "array<string>"},
    "identity": {"left_id": "string", "right_id": "string"},
    "binding": {"event": "string", "requested": "array<struct<role:string,target:string>>", "polarity": "string"},
    "compose": {"event": "string"},
}
_STEP_FIELDS = {"role": {"role"}, "argument_event": {"role"}, "event_relation": {"relation", "direction"}, "scope_parent": set()}


def validate_query(ast: dict) -> None:
    """Raise where a query is not of the closed language: unknown operator, missing or further members, bad steps."""
    op = ast.get("op")
    if op not in _FIELDS:
        raise ValueError(f"unknown operator {op!r}")
    members = set(_FIELDS[op]) | {"op"} | ({"steps"} if op == "compose" else set())
    if set(ast) != members:
        raise ValueError(f"{op} takes {sorted(members)}")
    for step in ast.get("steps", []):
        if set(step) != {"op"} | _STEP_FIELDS.get(step.get("op"), {None}):
            raise ValueError(f"bad step {step}")


def answer(spark: SparkSession, view: GraphView, asked: dict[str, dict]) -> DataFrame:
    """Answers to queries by id: ``query_id, labels``. Queries of one operator (and equal steps) are answered as one plan."""
    groups: dict[str, list[tuple[str, dict]]] = {}
    for query_id, ast in asked.items():
        validate_query(ast)
        groups.setdefault(json.dumps([ast["op"], ast.get("steps")]), []).append((query_id, ast))
    parts = []
    for key, members in groups.items():
        op, steps = json.loads(key)
        fields = _FIELDS[op]
        rows = [(q, *(a[f] for f in fields)) for q, a in members]
        queries = spark.createDataFrame(rows, "query_id string, " + ", ".join(f"{n} {t}" for n, t in fields.items()))
        function = globals()[f"q_{op}"]
        parts.append(function(view, queries, steps) if op == "compose" else function(view, queries))
    return reduce(DataFrame.unionByName, parts)


def violations(mention: DataFrame, context: DataFrame, relation: DataFrame, identity_link: DataFrame, decision: DataFrame, draft: DataFrame) -> DataFrame:
    """What breaks a rule: ``rule, id``, all rules over all tables, nothing stops at the first; ids of decisions and drafts as text.

    Each rule is one select; copies of a record count once.
    """
    m = kept(mention.select("id", "story_id", "target", "antecedent", "support", "evidence").distinct())
    c = kept(context.select("id", "parents").distinct())
    r = relation.select("id", "source", "target").distinct()
    d = kept(decision.select(F.col("decision_id").cast("string").alias("id"), "operations").distinct())
    graphs = draft.select(F.col("draft_id").cast("string").alias("id"), "graph").distinct()
    parents = c.select("id", F.explode("parents").alias("parent")).where("parent IS NOT NULL")
    known = F.filter("parents", lambda x: x.isNotNull())
    rules = {
        "duplicate_id": m.groupBy("id").count().where("count > 1"),
        "foreign_prefix": m.where(~F.startswith("id", F.concat("story_id", F.lit(":")))),
        "null_target_not_unresolved": m.where("target IS NULL AND support <> 'unresolved'"),
        "missing_antecedent": m.where("antecedent IS NOT NULL").join(m.select(F.col("id").alias("antecedent")), "antecedent", "left_anti"),
        "empty_span": m.where("evidence.start_token >= evidence.end_token"),
        "unanchored_evidence": m.where("evidence.verbatim IS NULL"),
        "blank_target": m.where("trim(target) = ''"),
        "changed_quote": m.where("evidence.quote <> evidence.verbatim"),
        "missing_parent": parents.join(c.select(F.col("id").alias("parent")), "parent", "left_anti").select("id").distinct(),
        "own_parent": c.where(F.array_contains("parents", F.col("id"))),
        "repeated_parent": c.where(F.size(F.array_distinct(known)) < F.size(known)),
        "open_relation": r.where("source IS NULL OR target IS NULL"),
        "relation_to_itself": r.where("source = target"),
        "link_to_itself": identity_link.select("id", F.col("left").alias("a"), F.col("right").alias("b")).distinct().where("a = b"),
        "no_operations": d.where(F.coalesce(F.size("operations"), F.lit(0)) <= 0),
        "operation_without_reason": d.select("id", F.explode("operations").alias("x")).where("coalesce(trim(x.reason), '') = ''").select("id").distinct(),
        "no_object": graphs.where(~F.coalesce(is_object("graph"), F.lit(False))),
    }
    return reduce(DataFrame.unionAll, [df.select(F.lit(name).alias("rule"), "id") for name, df in rules.items()])


def conflicts(answers: DataFrame, keys: list[str], gold: str) -> DataFrame:
    """Add ``label_state``: unresolved for all rows of a query whose gold differs between its copies, else annotation_supported."""
    per = answers.groupBy(*keys).agg(F.countDistinct(gold).alias("_n"))
    return answers.join(per, keys).withColumn("label_state", F.when(F.col("_n") > 1, "unresolved").otherwise("annotation_supported")).drop("_n")


def candidate_sets(candidates: DataFrame, group: str, descriptor: list[str], item: str) -> DataFrame:
    """Candidates that cannot be told apart share an index: ``group, descriptor..., index, items``; groups of fewer than two are left out."""
    merged = candidates.groupBy(group, *descriptor).agg(F.array_sort(F.collect_set(item)).alias("items"))
    digest = F.sha2(F.to_json(F.struct(*descriptor), {"ignoreNullFields": "false"}), 256)
    w = Window.partitionBy(group)
    placed = merged.withColumn("index", F.row_number().over(w.orderBy(digest)) - 1).withColumn("_n", F.count("*").over(w))
    return placed.where("_n > 1").drop("_n")
