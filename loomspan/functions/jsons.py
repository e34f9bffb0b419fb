"""JSON values: canonical digests, paths, edits, sketches."""

from __future__ import annotations

import copy
import json
import math
import re
from json.decoder import scanstring

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parsed(text: str) -> object:
    """The value of a JSON text of any depth; ValueError where it is none, as with NaN, which JSON does not have."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _parsed_deep(text)


def _after_blank(text: str, at: int) -> int:
    return _BLANK.match(text, at).end()


def _key(text: str, at: int) -> tuple[str, int]:
    """A member's name that begins at a place, and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = scanstring(text, at + 1)
    at = _after_blank(text, at)
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return name, _after_blank(text, at + 1)


def _leaf(text: str, at: int) -> tuple[object, int]:
    """A value without members that begins at a place, and its end."""
    if text[at : at + 1] == '"':
        return scanstring(text, at + 1)
    for word, value in _WORDS.items():
        if text.startswith(word, at):
            return value, at + len(word)
    number = _NUMBER.match(text, at)
    if number is None:
        raise ValueError(f"no value at {at}")
    return (float if number.group(1) or number.group(2) else int)(number.group()), number.end()


def _parsed_deep(text: str) -> object:
    """As ``parsed``, with a stack of the open objects and arrays in place of the interpreter's."""
    opened: list[tuple[object, str]] = []
    names: list[str] = []
    at = _after_blank(text, 0)
    while True:
        first = text[at : at + 1]
        if first in ("{", "["):
            node, end = ({}, "}") if first == "{" else ([], "]")
            at = _after_blank(text, at + 1)
            if text[at : at + 1] != end:
                opened.append((node, end))
                if end == "}":
                    name, at = _key(text, at)
                    names.append(name)
                continue
            value, at = node, at + 1
        else:
            value, at = _leaf(text, at)
        while True:
            at = _after_blank(text, at)
            if not opened:
                if at != len(text):
                    raise ValueError(f"more text at {at}")
                return value
            node, end = opened[-1]
            if end == "}":
                node[names.pop()] = value
            else:
                node.append(value)
            mark, at = text[at : at + 1], at + 1
            if mark == ",":
                at = _after_blank(text, at)
                if end == "}":
                    name, at = _key(text, at)
                    names.append(name)
                break
            if mark != end:
                raise ValueError(f"no {end} at {at - 1}")
            value = opened.pop()[0]


def written(value: object, comma: str = ",", colon: str = ":", by_name: bool = False) -> str:
    """JSON text of a value of any depth; NaN and infinities, which JSON does not have, are null. ``by_name`` sorts members."""
    parts: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        is_text, node = todo.pop()
        if is_text:
            parts.append(node)
        elif isinstance(node, dict):
            members = sorted(node.items()) if by_name else list(node.items())
            todo.append((True, "}"))
            for i in range(len(members) - 1, -1, -1):
                todo.append((False, members[i][1]))
                todo.append((True, (comma if i else "") + json.dumps(members[i][0], ensure_ascii=False) + colon))
            parts.append("{")
        elif isinstance(node, (list, tuple)):
            todo.append((True, "]"))
            for i in range(len(node) - 1, -1, -1):
                todo.append((False, node[i]))
                if i:
                    todo.append((True, comma))
            parts.append("[")
        else:
            parts.append("null" if isinstance(node, float) and not math.isfinite(node) else json.dumps(node, ensure_ascii=False))
    return "".join(parts)


def canonical_hash(text: str) -> Column:
    """SHA-256 of a JSON text with sorted keys and no spaces; null for null and for text that is not JSON.

    Numbers with a fraction are written as Spark writes them, so digests of such values are internal keys.
    """
    return F.sha2(F.to_json(F.try_parse_json(text)), 256)


def nan_to_null(column: Column) -> Column:
    """NaN and infinities as null, as reports need them."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def same_number(a: Column, b: Column, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    """Whether two numbers are close: |a - b| <= absolute + relative * |b|."""
    return F.abs(a - b) <= F.lit(absolute) + F.lit(relative) * F.abs(b)


def at_path(value: object, path: str) -> object:
    """Member at a dotted path, None where it is not there; numbers index arrays."""
    for part in path.split("."):
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


def _place(part: str, size: int, path: str) -> int:
    """Index that a part of a pointer names, below ``size``."""
    if not re.fullmatch("0|[1-9][0-9]*", part) or int(part) >= size:
        raise KeyError(path)
    return int(part)


def edited(value: object, edits: list[dict]) -> object:
    """A copy with edits at JSON pointers: ``{"op": "add" | "replace" | "remove", "path": "/a/0", "value": ...}``.

    ``replace`` and ``remove`` of what is not there raise KeyError, and so does a place that is no number from 0 or lies behind the end;
    ``add`` to an array inserts, ``-`` appends.
    """
    out = copy.deepcopy(value)
    for edit in edits:
        parts = [p.replace("~1", "/").replace("~0", "~") for p in edit["path"].split("/")[1:]]
        if not parts:
            out = copy.deepcopy(edit["value"])
            continue
        at = out
        for part in parts[:-1]:
            at = at[_place(part, len(at), edit["path"])] if isinstance(at, list) else at[part]
        last = parts[-1]
        if isinstance(at, list):
            adds = edit["op"] == "add"
            index = len(at) if adds and last == "-" else _place(last, len(at) + adds, edit["path"])
            if adds:
                at.insert(index, edit["value"])
            elif edit["op"] == "replace":
                at[index] = edit["value"]
            else:
                del at[index]
        elif edit["op"] == "add":
            at[last] = edit["value"]
        elif last not in at:
            raise KeyError(edit["path"])
        elif edit["op"] == "replace":
            at[last] = edit["value"]
        else:
            del at[last]
    return out


def patched(record: dict | None, change: dict) -> dict | None:
    """A record after an add, set or remove that states what was there before.

    A wrong ``before`` raises ValueError, and so do adding what is there and changing what is not, record or field.
    """
    if change["op"] == "add":
        if record is not None:
            raise ValueError("record exists")
        return copy.deepcopy(change["value"])
    if record is None:
        raise ValueError("record does not exist")
    if change["op"] == "remove":
        if record != change.get("before"):
            raise ValueError("before does not hold")
        return None
    out = copy.deepcopy(record)
    *outer, last = change["field"].split(".")
    try:
        at = out
        for part in outer:
            at = at[_place(part, len(at), change["field"])] if isinstance(at, list) else at[part]
        last = _place(last, len(at), change["field"]) if isinstance(at, list) else last
        was = at[last]
    except (KeyError, TypeError) as error:
        raise ValueError(f"no field {change['field']}") from error
    if was != change.get("before"):
        raise ValueError("before does not hold")
    at[last] = copy.deepcopy(change["value"])
    return out


def ids_in(value: object) -> list[str]:
    """All texts below members named ``id``, at any depth, sorted and distinct."""
    found, stack = set(), [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if isinstance(node.get("id"), str):
                found.add(node["id"])
            stack.extend(node.values())
        elif isinstance(node, list):
            stack.extend(node)
    return sorted(found)


def sketch(value: object) -> object:
    """Shape of a JSON value: type names, and for an array the sketch of its first element."""
    if isinstance(value, dict):
        return {k: sketch(v) for k, v in value.items()}
    if isinstance(value, list):
        return [sketch(value[0])] if value else []
    return type(value).__name__


def atoms(value: object, prefix: str = "") -> list[str]:
    """``path=value`` for every leaf of a JSON value, sorted; array members count as a set."""
    if isinstance(value, dict):
        return sorted(a for k, v in value.items() for a in atoms(v, f"{prefix}{k}."))
    if isinstance(value, list):
        return sorted({a for v in value for a in atoms(v, prefix)})
    return [f"{prefix.rstrip('.')}={json.dumps(value, ensure_ascii=False)}"]
