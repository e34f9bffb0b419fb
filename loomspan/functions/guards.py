"""Checks on schemas, options and cardinalities that stop a wrong plan before it runs."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def public_projection(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns in their order; any other column raises rather than being dropped."""
    if extra := sorted(set(df.columns) - set(allowed)):
        raise ValueError(f"not public: {extra}")
    return df.select(*allowed)


def without_keys(value: object, forbidden: set[str], path: str = "") -> None:
    """Raise if a member of a forbidden name is anywhere in a JSON value."""
    if isinstance(value, dict):
        for key, inner in value.items():
            if key in forbidden:
                raise ValueError(f"forbidden member {path}{key}")
            without_keys(inner, forbidden, f"{path}{key}.")
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            without_keys(inner, forbidden, f"{path}{i}.")


def abstracted(value: object, descriptors: dict[str, object], dropped: frozenset[str] = frozenset({"id"})) -> object:
    """A JSON value with known ids replaced by what they describe and identity members left out, at any depth."""
    if isinstance(value, dict):
        return {k: abstracted(v, descriptors, dropped) for k, v in value.items() if k not in dropped}
    if isinstance(value, list):
        return [abstracted(v, descriptors, dropped) for v in value]
    return descriptors.get(value, value) if isinstance(value, str) else value


def exactly_one(df: DataFrame) -> DataFrame:
    """The frame if it holds one row, else an error."""
    if (n := len(df.limit(2).collect())) != 1:
        raise ValueError("no row" if n == 0 else "more than one row")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join of two tables that must hold the same keys, each once; missing, further or repeated keys raise."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("_a")), right.groupBy(*keys).agg(F.count("*").alias("_b"))
    wrong = a.join(b, keys, "full").where("_a IS DISTINCT FROM 1 OR _b IS DISTINCT FROM 1").limit(5).collect()
    if wrong:
        raise ValueError(f"not one to one: {[tuple(r[k] for k in keys) for r in wrong]}")
    return left.join(right, keys)


def declared_groups(known: set[str], comparison: str | None = None, profiles: dict[str, list[str]] | None = None, explicit: list[str] | None = None) -> list[str]:
    """Groups that a contrast requires, by a named comparison or spelled out, sorted; both, neither, unknown or repeated ones raise."""
    if bool(comparison) == bool(explicit):
        raise ValueError("declare either a comparison or groups")
    groups = list((profiles or {}).get(comparison, [])) if comparison else list(explicit)
    if not groups or len(set(groups)) != len(groups) or set(groups) - known:
        raise ValueError("invalid groups")
    return sorted(groups)


def numeric_slots(value: object, path: str = "value", slots: int = 8) -> list[float]:
    """The numbers of a JSON value as signed log1p, each added to the slot of its path, so all values of one field share a slot.

    Members are joined by dots and array places written in brackets. Booleans and what is not finite count for nothing.
    """
    out = [0.0] * slots
    todo = [(path, value)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, dict):
            todo.extend((f"{at}.{k}", v) for k, v in node.items())
        elif isinstance(node, list):
            todo.extend((f"{at}[{i}]", v) for i, v in enumerate(node))
        elif isinstance(node, (int, float)) and not isinstance(node, bool) and math.isfinite(node):
            out[int(hashlib.sha256(at.encode()).hexdigest(), 16) % slots] += math.copysign(math.log1p(abs(node)), node)
    return out


def walltime_seconds(text: str) -> int:
    """Seconds of D-HH:MM:SS, HH:MM:SS or MM:SS."""
    days, _, rest = text.rpartition("-")
    parts = [int(p) for p in rest.split(":")]
    if not 2 <= len(parts) <= 3 or min(parts) < 0:
        raise ValueError(f"no walltime: {text}")
    seconds = 0
    for p in parts:
        seconds = seconds * 60 + p
    return seconds + 86400 * int(days or 0)
