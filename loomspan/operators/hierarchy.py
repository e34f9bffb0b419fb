"""Turn parent-child links into roots, depths, paths and descendants, and find what hangs on loops."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.skew import skew_join
from loomspan.session import checkpointed, kept

#: Positions along a scope that one local group spans.
CHUNK_SPAN = 1000
#: Rows that are worked on together: whole groups until they have so many, and never more than four times as many, so a task's
#: memory does not follow the data. A group that is cut only costs a further round.
BUNDLE = 50_000

_OUT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("steps", T.IntegerType()),
    ]
)


def links(df: DataFrame, key: str, parents: str, scope: str, position: Column | None = None) -> DataFrame:
    """Nodes with their known parents: ``id, scope, chunk, parents``, one row per id.

    ``position`` orders the rows of a scope; near positions are worked on together, and rows without one are spread by hash. Where no order is
    known (None) nodes are grouped by the top of their chain of first parents and by their distance from it instead.
    Null ids give no node, null and unknown parents no link, repeated ones one.
    """
    near = F.lit(None).cast("long") if position is None else position.cast("long")
    spread = -1 - F.pmod(F.xxhash64(F.col(key)), F.lit(64))
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.col(scope).alias("scope"), F.coalesce(F.floor(near / CHUNK_SPAN), spread).cast("long").alias("chunk"), F.col(parents).alias("parents")
    )
    rows = kept(rows)
    nodes = rows.groupBy("id").agg(F.min("scope").alias("scope"), F.min("chunk").alias("chunk"))
    named = rows.select("id", F.explode("parents").alias("parent")).where(F.col("parent").isNotNull()).distinct()
    known = skew_join(named, nodes.select(F.col("id").alias("parent")), ["parent"], "left_semi")
    held = known.groupBy("id").agg(F.collect_list("parent").alias("parents"))
    linked = nodes.join(held, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    return linked if position is not None else _grouped_by_chain(linked)


def _grouped_by_chain(nodes: DataFrame) -> DataFrame:
    """Give nodes the top of their chain of first parents as scope, and the stretch of that chain in which they lie as chunk.

    Chains are followed by doubling, so rounds follow the logarithm of the depth; what never reaches a top is on a loop of first parents or below one.
    A group of more than BUNDLE rows is split by hash.
    """
    nodes = checkpointed(nodes)
    first = F.array_min("parents")
    at = checkpointed(nodes.select("id", F.coalesce(first, "id").alias("up"), first.isNotNull().cast("long").alias("hops"), first.isNull().alias("done")))
    left = at.where("NOT done").count()
    while left:
        further = at.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = skew_join(at.where("NOT done"), further, ["up"]).select("id", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        at = checkpointed(at.where("done").unionByName(moved))
        before, left = left, at.where("NOT done").count()
        if left == before:
            break
    placed = at.select("id", F.col("up").alias("scope"), F.when(F.col("done"), F.floor(F.col("hops") / CHUNK_SPAN)).otherwise(-1).alias("band"))
    crowded = placed.groupBy("scope", "band").count().where(F.col("count") > BUNDLE).withColumnRenamed("count", "_n")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("_n", F.lit(1)) / BUNDLE))
    chunk = placed.join(crowded, ["scope", "band"], "left").select("id", "scope", (F.col("band") * 1_000_003 + part).cast("long").alias("chunk"))
    return nodes.select("id", "parents").join(chunk, "id").select("id", "scope", "chunk", "parents")


def peel(n: int, node: np.ndarray, waits_for: np.ndarray) -> np.ndarray:
    """Round in which each node is peeled, -1 for residual ones; a node goes once all it waits for have gone."""
    level = np.full(n, -1, np.int64)
    open_links = np.bincount(node, minlength=n)
    order = np.argsort(waits_for, kind="stable")
    waiting, starts = node[order], np.r_[0, np.cumsum(np.bincount(waits_for, minlength=n))]
    front, step = np.flatnonzero(open_links == 0), 0
    while len(front):
        level[front] = step
        told = waiting[_ranges(starts[front], starts[front + 1])]
        np.subtract.at(open_links, told, 1)
        told = np.unique(told)
        front, step = told[open_links[told] == 0], step + 1
    return level


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All indices of the given ranges, one after the other."""
    size = stop - start
    if not size.sum():
        return np.zeros(0, np.int64)
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class _Values:
    """Lists of (label, steps) of the nodes that are done, in one growing pair of arrays."""

    def __init__(self, n: int) -> None:
        self.label, self.steps, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.start, self.stop = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(self, owner: np.ndarray, label: np.ndarray, steps: np.ndarray) -> None:
        """Append values that are sorted by owner."""
        while self.used + len(label) > len(self.label):
            self.label, self.steps = np.r_[self.label, np.zeros_like(self.label)], np.r_[self.steps, np.zeros_like(self.steps)]
        at = slice(self.used, self.used + len(label))
        self.label[at], self.steps[at] = label, steps
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        self.start[owner[first]] = self.used + first
        self.stop[owner[first]] = self.used + np.r_[first[1:], len(owner)] if len(owner) else 0
        self.used += len(label)


def sweep(names: list[str], node: np.ndarray, source: np.ndarray, blocked: np.ndarray, given: tuple, mode: str, own_text: list | None = None) -> tuple[np.ndarray, _Values, list[str]]:
    """Work through one local graph and return which nodes are done, their values and the labels.

    ``node`` takes values from ``source`` over each link. ``blocked`` nodes also wait for something elsewhere;
    ``given`` holds values (node, label text, steps) that arrived from elsewhere, steps already counted. The order is
    that of leaf peeling: for ``peeled`` (nothing is sent, only who can be peeled is told) as it is, for ``roots``, ``above`` and ``paths``
    reversed. In reverse, the residual of the leaf peeling (loops and all that is above one) is peeled from its other
    end first, so that what is only above a loop still gets its values.
    """
    n = len(names)
    if mode == "peeled":
        rank = peel(n, node, source)
    else:
        leaf = peel(n, source, node)
        inner = (leaf[node] < 0) & (leaf[source] < 0)
        top = peel(n, node[inner], source[inner])
        rank = np.where(leaf >= 0, n + leaf.max(initial=0) - leaf, np.where(top >= 0, top, -1))
    labels, codes = list(names), {name: i for i, name in enumerate(names)}
    if mode == "longest":
        labels, codes = [""], {"": 0}
    given_node = np.asarray(given[0], np.int64)
    given_label = np.empty(len(given_node), np.int64)
    for i, text in enumerate(given[1]):
        if text not in codes:
            codes[text] = len(labels)
            labels.append(text)
        given_label[i] = codes[text]
    given_steps = np.asarray(given[2], np.int64)
    given_order = np.argsort(given_node, kind="stable")
    given_node, given_label, given_steps = given_node[given_order], given_label[given_order], given_steps[given_order]
    given_at = np.searchsorted(given_node, np.arange(n + 1))
    order = np.argsort(node, kind="stable")
    sources, at = source[order], np.r_[0, np.cumsum(np.bincount(node, minlength=n))]
    done, values = np.zeros(n, bool), _Values(n)
    by_rank = np.argsort(rank, kind="stable")
    by_rank = by_rank[rank[by_rank] >= 0]
    cuts = np.flatnonzero(np.r_[True, np.diff(rank[by_rank]) != 0]) if len(by_rank) else np.zeros(0, np.int64)
    for group in np.split(by_rank, cuts[1:]) if len(by_rank) else []:
        waits = blocked[group].copy()
        links_at = _ranges(at[group], at[group + 1])
        owner = np.repeat(group, at[group + 1] - at[group])
        open_owner = owner[~done[sources[links_at]]]
        waits |= np.isin(group, open_owner)
        ready = np.sort(group[~waits])
        done[ready] = True
        take = np.isin(owner, ready) if mode != "peeled" else np.zeros(len(owner), bool)
        owner, froms = owner[take], sources[links_at][take]
        picked = _ranges(values.start[froms], values.stop[froms])
        size = values.stop[froms] - values.start[froms]
        to, label, steps = np.repeat(owner, size), values.label[picked], values.steps[picked] + 1
        more = _ranges(given_at[ready], given_at[ready + 1])
        to, label, steps = np.r_[to, given_node[more]], np.r_[label, given_label[more]], np.r_[steps, given_steps[more]]
        if mode == "paths" and len(to):
            first = len(labels)
            labels.extend(f"{labels[k]}/{names[i]}" for i, k in zip(to, label, strict=True))
            label = np.arange(first, len(labels))
        if mode == "digest":
            above: dict[int, set[str]] = {int(i): set() for i in ready}
            for i, k in zip(to.tolist(), label.tolist(), strict=True):
                above[i].add(labels[k])
            first = len(labels)
            labels.extend(hashlib.sha256(json.dumps([own_text[i], sorted(above[i])], ensure_ascii=False).encode()).hexdigest() for i in above)
            to, label, steps = ready, np.arange(first, len(labels)), np.zeros(len(ready), np.int64)
        if mode == "longest":
            far = np.zeros(n, np.int64)
            np.maximum.at(far, to, steps)
            to, label, steps = ready, np.zeros(len(ready), np.int64), far[ready]
        own = ready if mode in ("peeled", "above") else np.setdiff1d(ready, to)
        to, label, steps = np.r_[to, own], np.r_[label, own], np.r_[steps, np.zeros(len(own), np.int64)]
        place = np.lexsort((steps, label, to))
        to, label, steps = to[place], label[place], steps[place]
        keep = np.r_[True, (to[1:] != to[:-1]) | (label[1:] != label[:-1])] if len(to) else np.zeros(0, bool)
        values.put(to[keep], label[keep], steps[keep])
    return done, values, labels


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by scope and chunk, as tables of whole groups of about BUNDLE rows; a larger group is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BUNDLE:
            continue
        table = pa.Table.from_batches(held)
        same = pc.and_(pc.equal(pc.fill_null(table["scope"], ""), table["scope"][rows - 1].as_py() or ""), pc.equal(table["chunk"], table["chunk"][rows - 1]))
        cut = int(np.flatnonzero(~np.asarray(same.combine_chunks()))[-1]) + 1 if not pc.all(same).as_py() else 0
        if not cut and rows >= 4 * BUNDLE:
            cut = rows
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _local(rows: DataFrame, mode: str) -> DataFrame:
    """Sweep bundles of groups as local graphs, in a sorted stream. A node that cannot be finished yet gives one row with null label."""

    def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table["id"].to_pylist()
        place = {name: i for i, name in enumerate(names)}
        froms = table["froms"].combine_chunks()
        owner = np.asarray(pc.list_parent_indices(froms), np.int64)
        source = np.array([place.get(name, -1) for name in pc.list_flatten(froms).to_pylist()], np.int64)
        blocked = np.zeros(len(names), bool)
        blocked[owner[source < 0]] = True
        arrived = table["given"].combine_chunks()
        values_in = pc.list_flatten(arrived)
        given = (np.asarray(pc.list_parent_indices(arrived), np.int64), values_in.field("label").to_pylist(), np.asarray(values_in.field("steps"), np.int64))
        texts = table["own"].to_pylist() if mode == "digest" else None
        done, values, labels = sweep(names, owner[source >= 0], source[source >= 0], blocked, given, mode, texts)
        ready = np.flatnonzero(done)
        picked = _ranges(values.start[ready], values.stop[ready])
        to = np.repeat(ready, values.stop[ready] - values.start[ready])
        rest = np.flatnonzero(~done)
        ids = pa.array(names, pa.string()).take(pa.array(np.r_[to, rest]))
        unknown = np.r_[np.zeros(len(picked), bool), np.ones(len(rest), bool)]
        label = pa.array(labels, pa.string()).take(pa.array(np.r_[values.label[picked], np.full(len(rest), -1)], mask=unknown))
        steps = pa.array(np.r_[values.steps[picked], np.zeros(len(rest), np.int64)].astype(np.int32), mask=unknown)
        yield from pa.Table.from_arrays([ids, label, steps], names=_OUT.names).to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _bundles(batches):
            yield from worked(table)

    held = ["id", "scope", "chunk", "froms", "given", *(["own"] if mode == "digest" else [])]
    spread = rows.select(*held).repartition("scope", "chunk").sortWithinPartitions("scope", "chunk")
    return spread.mapInArrow(run, _OUT)


def spread_values(nodes: DataFrame, mode: str) -> DataFrame:
    """Values of all nodes: ``id, label, steps``; one row with null label for a node that can never be finished.

    ``nodes``: ``id, scope, chunk, froms``, where ``froms`` names the nodes that a node takes values from, none unknown. Modes:
    ``roots`` (label a root, steps the fewest links to it), ``paths`` (label a path from a root), ``above`` (label the node
    itself or one above it), ``peeled`` (label the node itself), ``longest`` (no label, steps the most links from a root), ``digest`` (label the digest of the node's text in ``own`` and of its sources' digests, as a set).

    Every round works through each local group as far as it comes, whole hierarchies at a time, and hands values over
    group borders to the next round; rounds follow border crossings, not depth. The first that finishes nothing leaves
    the loops and what waits for them.
    """
    empty = F.array().cast("array<struct<label:string,steps:int>>")
    left = nodes.withColumn("given", empty)
    finished: DataFrame | None = None
    before = -1
    while True:
        swept = checkpointed(_local(left, mode))
        now = swept.where(F.col("label").isNotNull())
        finished = now if finished is None else finished.unionByName(now)
        rest = swept.where(F.col("label").isNull()).select("id")
        count = rest.count()
        if count == 0:
            return finished
        if count == before:
            return finished.unionByName(rest.select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("steps")))
        before = count
        open_nodes = left.join(rest, "id", "left_semi")
        sources = open_nodes.select("id", F.explode("froms").alias("source"))
        handed = (
            skew_join(sources, now.select(F.col("id").alias("source"), "label", "steps"), ["source"])
            .groupBy("id", "label").agg(((F.max("steps") if mode == "longest" else F.min("steps")) + 1).alias("steps"))
            .groupBy("id").agg(F.collect_list(F.struct("label", "steps")).alias("new"))
        )
        pending = skew_join(sources, rest.select(F.col("id").alias("source")), ["source"], "left_semi").groupBy("id").agg(F.collect_list("source").alias("pending"))
        left = (
            open_nodes.join(handed, "id", "left").join(pending, "id", "left")
            .select("id", "scope", "chunk", *(["own"] if mode == "digest" else []), F.coalesce("pending", F.array().cast("array<string>")).alias("froms"), F.concat("given", F.coalesce("new", empty)).alias("given"))
        )
        left = checkpointed(left)


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Roots above every node and the fewest links to each: ``id, root, depth``.

    ``nodes`` as ``links`` gives them. A node on a loop, or with one anywhere above it, has instead one row with root
    ``cycle`` and depth -1, also where other roots are above it. A node without known parents is its own root at depth 0.
    """
    found = spread_values(nodes.withColumnRenamed("parents", "froms"), "roots")
    return found.select("id", F.coalesce("label", F.lit("cycle")).alias("root"), F.coalesce("steps", F.lit(-1)).alias("depth"))


def paths(nodes: DataFrame) -> DataFrame:
    """Every path from a root down to every node: ``id, path, depth``, ids joined by ``/``; nothing for what ``hierarchy`` calls a cycle.

    Where nodes have several parents, paths can be exponentially many; ``ancestors`` has the same nodes once each.
    """
    found = spread_values(nodes.withColumnRenamed("parents", "froms"), "paths")
    return found.where(F.col("label").isNotNull()).select("id", F.col("label").alias("path"), F.col("steps").alias("depth"))


def _without_loops_below(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes on or above a loop (``id``), and the others with the parents among them.

    Leaf peeling leaves exactly the former. First what ``hierarchy`` cannot finish is taken (loops and all below); only that small rest is
    peeled from its leaves, and what is left of it, with all above, is on or above a loop.
    """
    nodes = checkpointed(nodes)
    lists = checkpointed(spread_values(nodes.withColumnRenamed("parents", "froms"), "above"))
    stuck = lists.where("label IS NULL").select("id")
    inner = nodes.join(stuck, "id", "left_semi")
    pairs = inner.select("id", F.explode("parents").alias("parent"))
    within = pairs.join(stuck.select(F.col("id").alias("parent")), "parent", "left_semi")
    children = within.groupBy(F.col("parent").alias("id")).agg(F.collect_list(within["id"]).alias("froms"))
    upward = inner.select("id", "scope", "chunk").join(children, "id", "left").withColumn("froms", F.coalesce("froms", F.array().cast("array<string>")))
    core = checkpointed(spread_values(upward, "peeled").where("label IS NULL").select("id"))
    over = pairs.join(core, "id", "left_semi").select(F.col("parent").alias("id"))
    higher = lists.where("label IS NOT NULL").join(over.distinct(), "id", "left_semi").select(F.col("label").alias("id"))
    looped = checkpointed(core.union(higher).distinct())
    fine = nodes.join(looped, "id", "left_anti")
    known = fine.select("id", F.explode("parents").alias("parent")).join(looped.select(F.col("id").alias("parent")), "parent", "left_anti").groupBy("id").agg(F.collect_list("parent").alias("parents"))
    return looped, fine.drop("parents").join(known, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def ancestors(nodes: DataFrame) -> DataFrame:
    """All nodes above every node: ``id, ancestor, distance`` (the fewest links), each node with itself at 0; null and -1 on or below a loop."""
    found = spread_values(nodes.withColumnRenamed("parents", "froms"), "above")
    return found.select("id", F.col("label").alias("ancestor"), F.coalesce("steps", F.lit(-1)).alias("distance"))


def longest_depths(nodes: DataFrame) -> DataFrame:
    """The most links from a root down to every node: ``id, depth``; null on or below a loop."""
    found = spread_values(nodes.withColumnRenamed("parents", "froms"), "longest")
    return found.select("id", F.col("steps").alias("depth"))


def nested_digests(nodes: DataFrame, own: DataFrame, text: str) -> DataFrame:
    """Digest of every node with all that is above it, nested: ``id, digest``; null on or below a loop.

    A digest is that of the node's own ``text`` (by ``id``, null where it has none) and the set of its parents' digests, so two nodes are alike exactly if all above
    them is, whatever their ids. Only digests cross the borders of groups, never nested values.
    """
    named = nodes.join(own.groupBy("id").agg(F.min(text).alias("own")), "id", "left")
    found = spread_values(named.withColumnRenamed("parents", "froms"), "digest")
    return found.select("id", F.col("label").alias("digest"))


def descendants(nodes: DataFrame) -> DataFrame:
    """All nodes below every node: ``id, descendant, distance`` (the fewest links), each node with itself at 0.

    A node on a loop, or with one anywhere below it, has one row with a null descendant and distance -1. Every node carries the nodes above it, as
    many as it is deep, and each of these tells one row; so no task and no row holds all that is below a root.
    """
    looped, fine = _without_loops_below(nodes)
    found = ancestors(fine).select(F.col("ancestor").alias("id"), F.col("id").alias("descendant"), "distance")
    return found.unionByName(looped.select("id", F.lit(None).cast("string").alias("descendant"), F.lit(-1).alias("distance")))


def subtree_sizes(below: DataFrame) -> DataFrame:
    """Number of nodes below and greatest distance, from ``descendants``; null where a loop is below."""
    whole = F.max("distance") >= 0
    return below.groupBy("id").agg(F.when(whole, F.count("*") - 1).alias("n_descendants"), F.when(whole, F.max("distance")).alias("height"))
