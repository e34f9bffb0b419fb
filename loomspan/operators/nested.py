"""Flatten deeply nested JSON documents into related flat tables by interval labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.functions.jsons import parsed, written


@dataclass(frozen=True)
class Kind:
    """A node type: the name it gets, the members in which its children lie, and how it lies in its own member.

    ``single``: any non-null value is one node, arrays too. ``within``: the member of a node of this kind that
    holds further nodes of the same kind.
    """

    name: str
    children: dict[str, Kind] = field(default_factory=dict)
    single: bool = False
    within: str | None = None


#: Members of a draft graph and what they hold.
GRAPH = {
    "entities": Kind("entity"),
    "events": Kind("event", {"trigger": Kind("trigger", single=True), "arguments": Kind("argument")}),
    "literals": Kind("literal"),
    "uncertainties": Kind("uncertainty", {"alternatives": Kind("alternative", within="alternatives")}),
}

_ADDED = [
    T.StructField("kind", T.StringType()),
    T.StructField("pre", T.IntegerType()),
    T.StructField("post", T.IntegerType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("parent_pre", T.IntegerType()),
    T.StructField("owner_id", T.StringType()),
    T.StructField("place", T.IntegerType()),
    T.StructField("path", T.StringType()),
]


def parse_object(text: str | None) -> dict | None:
    """The object that the text is, however deep, or None where it is anything but one complete JSON object."""
    if not text or not text.lstrip(" \t\r\n").startswith("{"):
        return None
    try:
        found = parsed(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


@F.pandas_udf(T.BooleanType())
def is_object(texts: pd.Series) -> pd.Series:
    """Whether a text is one complete JSON object, of any depth; false for null."""
    return texts.map(lambda text: parse_object(text) is not None).astype(bool)


def _members(value: object, kind: Kind) -> list[tuple[int, object]]:
    """Place and value of the nodes that a member holds: null elements take a place and give no node."""
    if value is None:
        return []
    if kind.single:
        return [(0, value)]
    if isinstance(value, dict):
        return [(0, value)]
    return [(i, x) for i, x in enumerate(value) if x is not None] if isinstance(value, list) else []


def _text(node: object, key: str) -> str | None:
    value = node.get(key) if isinstance(node, dict) else None
    return value if value is None or isinstance(value, str) else written(value, ", ", ": ")


class _Nodes:
    """Columns of the nodes of one Arrow batch; labels run on over its documents, so intervals never meet."""

    def __init__(self, attributes: tuple[str, ...] = ()) -> None:
        self.attributes = {name: [] for name in attributes}
        self.row: list[int] = []
        self.kind: list[str] = []
        self.pre: list[int] = []
        self.post: list[int] = []
        self.level: list[int] = []
        self.id: list[str | None] = []
        self.target: list[str | None] = []
        self.place: list[int] = []
        self.label = 0

    def walk(self, row: int, root: dict, spec: dict[str, Kind]) -> None:
        """Depth-first traversal with its own stack: ``pre`` on the way down, ``post`` on the way up."""
        stack: list[tuple] = []
        for member, kind in reversed(spec.items()):
            stack.extend((kind, place, node, 0) for place, node in reversed(_members(root.get(member), kind)))
        while stack:
            kind, place, node, level = stack.pop()
            if kind is None:
                self.post[place] = self.label
                self.label += 1
                continue
            at = len(self.row)
            self.row.append(row)
            self.kind.append(kind.name)
            self.pre.append(self.label)
            self.post.append(-1)
            self.level.append(level)
            self.id.append(_text(node, "id"))
            self.target.append(_text(node, "target"))
            self.place.append(place)
            for name, values in self.attributes.items():
                values.append(_text(node, name))
            self.label += 1
            stack.append((None, at, None, level))
            if isinstance(node, dict):
                inner = {**kind.children, **({kind.within: kind} if kind.within else {})}
                for member, below in reversed(inner.items()):
                    stack.extend((below, p, n, level + 1) for p, n in reversed(_members(node.get(member), below)))


def _by_level(level: np.ndarray) -> list[np.ndarray]:
    """Indices of the nodes of each level from 0 on, in their order."""
    return np.split(np.argsort(level, kind="stable"), np.cumsum(np.bincount(level))[:-1]) if len(level) else []


def enclosing(pre: np.ndarray, post: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Index of the node one level up whose interval holds each node's, -1 for roots.

    Intervals of one level never overlap, so the candidate is the last that begins before; it is taken if it also
    ends after.
    """
    parent = np.full(len(pre), -1, np.int64)
    for above, here in pairwise(_by_level(level)):
        candidate = above[np.searchsorted(pre[above], pre[here]) - 1]
        holds = (pre[candidate] < pre[here]) & (post[candidate] > post[here])
        parent[here[holds]] = candidate[holds]
    return parent


def _linked(nodes: _Nodes) -> dict[str, pa.Array]:
    """Parent, owner and path of the nodes, level by level over the interval links.

    A node inside another of its kind continues that one's path and has its owner; else its path is its place
    and its owner the node around it.
    """
    pre, post, level, place = (np.array(x, np.int64) for x in (nodes.pre, nodes.post, nodes.level, nodes.place))
    kind, ids = np.array(nodes.kind, object), np.array(nodes.id, object)
    parent = enclosing(pre, post, level)
    path, owner = place.astype(str).astype(object), np.full(len(pre), None, object)
    for nodes_here in _by_level(level)[1:]:
        here = nodes_here[parent[nodes_here] >= 0]
        above = parent[here]
        same = kind[here] == kind[above]
        owner[here] = np.where(same, owner[above], ids[above])
        path[here[same]] = path[above[same]] + "." + path[here[same]]
    first = np.zeros(len(pre), np.int64)
    if len(pre):
        rows = np.array(nodes.row)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        first = pre[np.repeat(starts, np.diff(np.r_[starts, len(rows)]))]
    above_pre = np.where(parent >= 0, pre[parent] - first, -1)
    return {
        "kind": pa.array(nodes.kind, pa.string()),
        "pre": pa.array((pre - first).astype(np.int32)),
        "post": pa.array((post - first).astype(np.int32)),
        "level": pa.array(level.astype(np.int32)),
        "id": pa.array(nodes.id, pa.string()),
        "target": pa.array(nodes.target, pa.string()),
        "parent_pre": pa.array(above_pre.astype(np.int32), mask=parent < 0),
        "owner_id": pa.array(owner.tolist(), pa.string()),
        "place": pa.array(place.astype(np.int32)),
        "path": pa.array(path.tolist(), pa.string()),
    }


def node_table(df: DataFrame, column: str, keep: list[str], spec: dict[str, Kind] = GRAPH, kinds: list[str] | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """One row per node of the JSON documents in ``column``, with the ``keep`` columns of its row.

    Added columns: ``kind``; ``pre`` and ``post``, the interval label within the document (a node is below
    another exactly if its interval lies inside); ``level``; the node's own ``id`` and ``target``; ``parent_pre``, the
    label of the node around it; ``owner_id``, the id of the nearest node around it of another kind; ``place`` in its
    array; ``path``, the places from the outermost node of its kind inward. Labels and links are made inside the Arrow batch
    that holds the document, so nothing is shuffled. ``kinds`` restricts what is emitted; ``attributes`` names further members of a node to emit, as text or JSON.

    Defined cases: null, empty or broken text and JSON that is not one object give no rows; a single object in place of an
    array is an array of one; null elements take a place and give no row; other values in place of an array give
    nothing; a missing ``id`` is null; an empty table gives an empty table. ``keep`` columns must not be named like the
    added ones.
    """
    if clash := ({f.name for f in _ADDED} | set(attributes)) & set(keep):
        raise ValueError(f"rename before: {sorted(clash)}")
    schema = T.StructType([df.schema[c] for c in keep] + _ADDED + [T.StructField(a, T.StringType()) for a in attributes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = _Nodes(attributes)
            texts = batch.column(batch.schema.get_field_index(column))
            for row in range(len(texts)):
                if (root := parse_object(texts[row].as_py())) is not None:
                    nodes.walk(row, root, spec)
            added = _linked(nodes) | {name: pa.array(values, pa.string()) for name, values in nodes.attributes.items()}
            table = pa.RecordBatch.from_arrays(list(added.values()), list(added))
            rows = pa.array(nodes.row, pa.int64())
            if kinds is not None:
                wanted = pc.is_in(added["kind"], pa.array(kinds))
                table, rows = table.filter(wanted), rows.filter(wanted)
            left = batch.select(keep).take(rows)
            yield pa.RecordBatch.from_arrays([*left.columns, *table.columns], names=[f.name for f in schema.fields])

    return df.select(*keep, column).mapInArrow(run, schema)


def nodes_within(nodes: DataFrame, key: str, outer: str, inner: str) -> DataFrame:
    """Pairs of an ``outer`` and an ``inner`` node of the same document by interval containment.

    For any pair of kinds, next to each other or not. The join is on the document key with the containment as
    residual; documents are bounded by their own size.
    """
    a = nodes.where(nodes["kind"] == outer).selectExpr(f"{key} as k", "id as outer_id", "pre as outer_pre", "post as outer_post")
    b = nodes.where(nodes["kind"] == inner).selectExpr(key, "id as inner_id", "pre as inner_pre", "post as inner_post", "path")
    return b.join(a, (b[key] == a["k"]) & (a["outer_pre"] < b["inner_pre"]) & (a["outer_post"] > b["inner_post"])).drop("k")
