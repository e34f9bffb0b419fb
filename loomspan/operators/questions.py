"""Questions generated from an annotation graph: what can be asked, among which candidates, and which of these are acceptable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators import annotation
from loomspan.operators.annotation import GraphView, resolved
from loomspan.operators.skew import skew_join
from loomspan.session import checkpointed

# What may be answered where the answer is no record.
ANSWERS = {"concept": ["supported", "contradicted"], "polarity": ["positive", "negative"], "binding": ["supported", "contradicted"], "identity": ["same", "different", "possible"]}
#: Families that are asked.
FAMILIES = ("concept_occurrence", "reference", "event_role", "event_scope", "event_polarity", "binding_verification", "event_relation", "composed", "identity_update")

_ASKED = ["query_id", "unit_id", "family", "variant", "ast", "catalog"]


def _asked(df: DataFrame, family: str, catalog: Column | str, ast: dict[str, Column | str], variant: Column | str = "") -> DataFrame:
    """Add the text of a question, its candidates' catalog and its id: the digest of unit, family and text, so equal questions of a unit are one."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    text = F.to_json(F.struct(*[column(value).alias(name) for name, value in ast.items()]))
    named = df.withColumn("family", F.lit(family)).withColumn("variant", column(variant)).withColumn("ast", text).withColumn("catalog", column(catalog))
    return named.withColumn("query_id", F.sha2(F.concat_ws("\u0000", "unit_id", "family", "ast"), 256)).dropDuplicates(["query_id"])


def _of_unit(kind: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col("unit_id"))


def candidates(view: GraphView, scopes: DataFrame, seed: int = 0) -> DataFrame:
    """Candidates of every catalog in a seeded order: ``catalog, item, place`` from 0.

    Fixed answers, relation types, and per unit its entities, all its records that an argument may name, and its events' scopes. A catalog is kept once,
    however many questions use it.
    """
    unit = lambda df, kind, item: df.where(F.col(item).isNotNull()).select(_of_unit(kind).alias("catalog"), F.col(item).alias("item"))
    fixed = view.relations.sparkSession.createDataFrame([(kind, item) for kind, items in ANSWERS.items() for item in items], "catalog string, item string")
    parts = [
        fixed,
        view.relations.where("type IS NOT NULL").select(F.lit("relation").alias("catalog"), F.col("type").alias("item")),
        unit(view.entities, "entity", "id"),
        *(unit(df, "target", "id") for df in (view.entities, view.events, view.literals)),
        unit(scopes, "scope", "digest"),
    ]
    items = reduce(DataFrame.unionByName, parts).distinct()
    return items.groupBy("catalog").agg(F.array_sort(F.collect_list(F.struct(F.sha2(F.concat_ws("\u0000", F.lit(str(seed)), "catalog", "item"), 256).alias("h"), "item"))).alias("_a")).select("catalog", F.posexplode("_a").alias("place", "s")).select("catalog", "s.item", "place")


def _bindings(view: GraphView) -> DataFrame:
    """Requests for all arguments of an event with either polarity, and for those with the fillers of two roles swapped."""
    events = view.events.groupBy("unit_id", F.col("id").alias("event")).agg(F.min("polarity").alias("is"))
    bound = view.arguments.where("role IS NOT NULL AND target IS NOT NULL").groupBy("event").agg(F.array_sort(F.collect_set(F.struct("role", "target"))).alias("b"))
    held = events.join(bound, "event")
    contrast = held.select("unit_id", "event", F.col("b").alias("requested"), F.explode(F.array(F.lit("positive"), F.lit("negative"))).alias("polarity"), F.lit("polarity_contrast").alias("variant"))
    places = held.select("unit_id", "event", "b", "is", F.explode(F.sequence(F.lit(0), F.size("b") - 1)).alias("i")).where(F.col("i") < F.size("b") - 1)
    pairs = places.select("unit_id", "event", "b", "is", "i", F.explode(F.sequence(F.col("i") + 1, F.size("b") - 1)).alias("j"))
    first, second = F.get("b", F.col("i")), F.get("b", F.col("j"))
    swap = lambda x, k: F.struct(x["role"].alias("role"), F.when(k == F.col("i"), second["target"]).when(k == F.col("j"), first["target"]).otherwise(x["target"]).alias("target"))
    swapped = pairs.where((first["role"] != second["role"]) & (first["target"] != second["target"])).select("unit_id", "event", F.transform("b", swap).alias("requested"), F.col("is").alias("polarity"), F.lit("role_swap").alias("variant"))
    return contrast.unionByName(swapped.where("polarity IS NOT NULL"))


def _composed(view: GraphView) -> DataFrame:
    """Questions of two steps with their answers: by an argument that is an event, by the event around, by a relation; then a role of what was reached."""
    a = view.arguments.where(resolved() & F.col("target").isNotNull()).select("event", "role", "target").distinct()
    events = view.events.select(F.col("id").alias("event"), "unit_id").distinct()
    end = a.select(F.col("event").alias("via"), F.col("role").alias("last"), F.col("target").alias("label"))
    first = [
        a.join(events.select(F.col("event").alias("target")), "target", "left_semi").select("event", F.lit("argument_event").alias("step"), F.col("role").alias("by"), F.col("target").alias("via")),
        annotation.scope_parents(view).select("event", F.lit("scope_parent").alias("step"), F.lit("").alias("by"), F.col("parent").alias("via")),
        view.relations.where(resolved() & F.col("source").isNotNull() & F.col("type").isNotNull()).select(F.col("source").alias("event"), F.lit("event_relation").alias("step"), F.col("type").alias("by"), F.col("target").alias("via")).distinct(),
    ]
    reached = skew_join(reduce(DataFrame.unionByName, first), end, ["via"]).groupBy("event", "step", "by", "last").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return events.join(reached, "event")


def generate(view: GraphView, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Questions with what is acceptable, and what was left out.

    Questions: ``query_id, unit_id, family, variant, ast, catalog, n_candidates, acceptable (sorted places in the catalog), label_state``; ``needs_adjudication`` with no acceptable one where the
    annotation justifies no answer. Left out: ``family, reason, n``: fewer than two candidates, an answer that is no candidate, all candidates acceptable, and records that are
    themselves unresolved. Each family is asked and answered as one plan over all units.
    """
    events = view.events.select("unit_id", F.col("id").alias("event")).distinct()
    named = view.entities.where("concept IS NOT NULL").select(F.col("id").alias("target"), "concept").distinct()
    mentions = view.mentions
    open_ = lambda df: F.coalesce(df["support"] == "unresolved", F.lit(False))
    scopes = checkpointed(annotation.q_scope(view, events.select("event", F.col("event").alias("query_id")).distinct()).select(F.col("query_id").alias("event"), F.col("labels")[0].alias("digest")))

    concept = _asked(mentions.join(named, "target").select("unit_id", "concept").distinct(), "concept_occurrence", "concept", {"op": "concept", "concept": F.col("concept")})
    reference = _asked(mentions.where("antecedent IS NOT NULL").where(~open_(mentions)).select("unit_id", F.col("id").alias("mention")).distinct(), "reference", _of_unit("entity"), {"op": "reference", "mention": F.col("mention")})
    role = _asked(view.arguments.select("event", "role").where("role IS NOT NULL").distinct().join(events, "event"), "event_role", _of_unit("target"), {"op": "role", "event": F.col("event"), "role": F.col("role")})
    scope = _asked(events, "event_scope", _of_unit("scope"), {"op": "scope", "event": F.col("event")})
    polarity = _asked(events, "event_polarity", "polarity", {"op": "polarity", "event": F.col("event")})
    binding = _asked(_bindings(view), "binding_verification", "binding", {"op": "binding", "event": F.col("event"), "requested": F.col("requested"), "polarity": F.col("polarity")}, F.col("variant"))
    links = view.relations.where("source IS NOT NULL AND target IS NOT NULL AND contexts IS NOT NULL")
    relation = _asked(links.where(~open_(links)).select("unit_id", "source", "target", F.array_sort("contexts").alias("contexts")).distinct(), "event_relation", "relation", {"op": "relation", "source": F.col("source"), "target": F.col("target"), "contexts": F.col("contexts")})
    same = view.identity_links.where("left_id IS NOT NULL AND right_id IS NOT NULL")
    identity = _asked(same.where(~open_(same)).select("unit_id", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct(), "identity_update", "identity", {"op": "identity", "left_id": F.col("left_id"), "right_id": F.col("right_id")})
    chain = _asked(_composed(view), "composed", _of_unit("target"), {"op": "compose", "event": F.col("event"), "step": F.col("step"), "by": F.col("by"), "role": F.col("last")}, F.col("step"))

    asked = checkpointed(reduce(DataFrame.unionByName, [df.select(_ASKED) for df in (concept, reference, role, scope, polarity, binding, relation, identity, chain)]))
    answers = [
        annotation.q_concept(view, concept), annotation.q_reference(view, reference), annotation.q_role(view, role), annotation.q_polarity(view, polarity),
        annotation.q_binding(view, binding), annotation.q_relation(view, relation), annotation.q_identity(view, identity),
        scope.join(scopes, "event").select("query_id", F.when(F.col("digest").isNotNull(), F.array("digest")).alias("labels")), chain.select("query_id", "labels"),
    ]
    answered = checkpointed(reduce(DataFrame.unionByName, [df.select("query_id", "labels") for df in answers]))
    listed = checkpointed(candidates(view, scopes.join(events, "event"), seed))
    sizes = listed.groupBy("catalog").agg(F.count("*").alias("n_candidates"))
    whole = skew_join(asked.join(answered, "query_id"), sizes, ["catalog"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    places = skew_join(whole.select("query_id", "catalog", F.explode("labels").alias("item")), listed, ["catalog", "item"]).groupBy("query_id").agg(F.array_sort(F.collect_list("place")).alias("acceptable"))
    judged = whole.join(places, "query_id", "left").withColumn("acceptable", F.coalesce("acceptable", F.array().cast("array<int>")))
    reason = (
        F.when(F.col("n_candidates") < 2, "no_alternative_candidates")
        .when(F.col("labels").isNotNull() & (F.size("acceptable") < F.size("labels")), "answer_is_no_candidate")
        .when(F.size("acceptable") == F.col("n_candidates"), "all_acceptable")
    )
    judged = checkpointed(judged.withColumn("reason", reason))
    state = F.when(F.col("labels").isNull(), "needs_adjudication").otherwise("annotation_supported")
    questions = judged.where("reason IS NULL").select(*_ASKED, "n_candidates", "acceptable", state.alias("label_state"))
    unresolved = [df.where(open_(df)).select("id").distinct().agg(F.lit(family).alias("family"), F.lit("unresolved_record").alias("reason"), F.count("*").alias("n")) for family, df in (("event_relation", view.relations), ("identity_update", view.identity_links))]
    left_out = judged.where("reason IS NOT NULL").groupBy("family", "reason").agg(F.count("*").alias("n"))
    return questions, reduce(DataFrame.unionByName, [left_out, *unresolved]).where("n > 0")
