"""Scans of files: JSON, tensors, matrices, timing tiers, archives, listings."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files of one JSON object each, by a stated schema; a file that does not fit fails the read."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a line, blank lines skipped, also compressed; a line that does not fit fails the read."""
    lines = spark.read.text(path).where(F.regexp_like("value", F.lit(r"\S")))
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"}).alias("r")).select("r.*")


def response(spark: SparkSession, path: str, subject: str, story: str, blocks: list[int] | None = None, trim: tuple[int, int] = (0, 0)) -> DataFrame:
    """Slice of a tensor table partitioned by subject, story and block: ``repeat, t, block, values``.

    Subject, story and block prune directories; ``trim`` drops rows at both ends of the series, whose length is that of the
    whole story.
    """
    whole = spark.read.parquet(path).where((F.col("subject") == subject) & (F.col("story") == story))
    part = whole if blocks is None else whole.where(F.col("block").isin(blocks))
    if trim != (0, 0):
        last = part.agg(F.max("t").alias("_last"))
        part = part.crossJoin(last).where((F.col("t") >= trim[0]) & (F.col("t") <= F.col("_last") - trim[1])).drop("_last")
    return part.select("repeat", "t", "block", "values")


def write_tensor(df: DataFrame, path: str) -> None:
    """Write a tensor table by subject, story and block; only the blocks that are in the frame are replaced, so a stopped write resumes."""
    df.repartition("subject", "story", "block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("subject", "story", "block").parquet(path)


def blocked(vector: Column, size: int) -> Column:
    """Array of (block, values) structs of at most ``size`` values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / size).cast("int")), lambda b: F.struct(b.alias("block"), F.slice(vector, b * size + 1, F.lit(size)).alias("values")))


def csr_to_coo(df: DataFrame, key: str, data: str, indices: str, indptr: str) -> DataFrame:
    """Compressed rows as coordinates: ``key, i, j, v``."""
    rows = df.select(key, data, indices, F.posexplode(F.arrays_zip(F.slice(indptr, F.lit(1), F.size(indptr) - 1).alias("a"), F.slice(indptr, F.lit(2), F.size(indptr) - 1).alias("b"))).alias("i", "r"))
    size = F.col("r.b") - F.col("r.a")
    parts = F.arrays_zip(F.slice(indices, F.col("r.a") + 1, size).alias("j"), F.slice(data, F.col("r.a") + 1, size).alias("v"))
    return rows.where(size > 0).select(key, "i", F.explode(parts).alias("z")).select(key, "i", "z.j", "z.v")


def named_like(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose name begins with a prefix, with the rest as ``<column>_rest``."""
    return df.where(F.startswith(column, F.lit(prefix))).withColumn(f"{column}_rest", F.substring(column, len(prefix) + 1, 2**31 - 1))


def parse_textgrid(text: str) -> list[tuple[str, int, float, float, str]]:
    """Intervals of a TextGrid, long or short form: (tier, index, start, end, label). Quotes are doubled inside labels."""
    tokens = re.findall(r'"(?:[^"]|"")*"|<exists>|(?<![\w\[])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w\]])', text)
    at, out = 0, []

    def take(kind: str) -> str:
        nonlocal at
        while at < len(tokens):
            token = tokens[at]
            at += 1
            if (token[0] == '"') == (kind == "text") and token != "<exists>":
                return token[1:-1].replace('""', '"') if kind == "text" else token
        raise ValueError("TextGrid ends too early")

    if take("text") != "ooTextFile" or take("text") != "TextGrid":
        raise ValueError("not a TextGrid")
    take("number"), take("number")
    for _ in range(int(float(take("number")))):
        kind, name = take("text"), take("text")
        take("number"), take("number")
        for index in range(int(float(take("number")))):
            if kind == "IntervalTier":
                start, end = float(take("number")), float(take("number"))
                out.append((name, index, start, end, take("text")))
            else:
                start = float(take("number"))
                out.append((name, index, start, start, take("text")))
    return out


def _files(spark: SparkSession, path: str, run, schema: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of TextGrid files with diagnostics: ``path, tier, idx, start, end, label, reversed, overlap`` (seconds into the one before)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                raw = bytes(content)
                text = raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
                rows, last = [], {}
                for tier, index, start, end, label in parse_textgrid(text):
                    rows.append((name, tier, index, start, end, label, end < start, max(0.0, last.get(tier, start) - start)))
                    last[tier] = end
                yield pd.DataFrame(rows, columns=["path", "tier", "idx", "start", "end", "label", "reversed", "overlap"])

    return _files(spark, path, run, "path string, tier string, idx int, start double, end double, label string, reversed boolean, overlap double")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of NPY and NPZ files: ``path, name, shape, row, values``, one row per first index; object arrays are refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                loaded = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                arrays = {k: loaded[k] for k in loaded.files} if hasattr(loaded, "files") else {"": loaded}
                for key, array in arrays.items():
                    flat = np.atleast_1d(array).astype(float)
                    yield pd.DataFrame([(name, key, list(map(int, array.shape)), i, flat[i].ravel()) for i in range(len(flat))], columns=["path", "name", "shape", "row", "values"])

    return _files(spark, path, run, "path string, name string, shape array<int>, row int, values array<double>")


def read_zip_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of ZIP files: ``path, member, size, content``; names that leave the archive are refused."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as archive:
                    for info in archive.infolist():
                        if info.filename.startswith("/") or ".." in info.filename.split("/"):
                            raise ValueError(f"unsafe member {info.filename}")
                        if not info.is_dir():
                            yield pd.DataFrame([(name, info.filename, info.file_size, archive.read(info))], columns=["path", "member", "size", "content"])

    return _files(spark, path, run, "path string, member string, size bigint, content binary")


def missing_members(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Members that are too many or too few against an exact inventory: ``member, problem``."""
    both = members.select("member", F.lit(1).alias("a")).join(expected.select("member", F.lit(1).alias("b")), "member", "full")
    return both.select("member", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").alias("problem")).where("problem IS NOT NULL")


def read_annot(spark: SparkSession, path: str) -> DataFrame:
    """Vertex labels of surface annotation files (big-endian pairs of vertex and colour, then a colour table): ``path, vertex, code, name``."""

    def parse(raw: bytes) -> list[tuple[int, int, str | None]]:
        n = struct.unpack(">i", raw[:4])[0]
        pairs = np.frombuffer(raw, ">i4", 2 * n, 4).reshape(n, 2)
        at, names = 4 + 8 * n, {}

        def number() -> int:
            nonlocal at
            at += 4
            return struct.unpack(">i", raw[at - 4 : at])[0]

        def string() -> str:
            nonlocal at
            size = number()
            at += size
            return raw[at - size : at].rstrip(b"\x00").decode()

        if at < len(raw) and number() > 0:
            count = number()
            if count < 0:
                number(), string()
                count = number()
            else:
                string()
                count = -count
            for _ in range(abs(count)):
                if count > 0:
                    number()
                name = string()
                r, g, b, _alpha = (number() for _ in range(4))
                names[r + (g << 8) + (b << 16)] = name
        return [(int(v), int(c), names.get(int(c))) for v, c in pairs]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(name, *row) for row in parse(bytes(content))], columns=["path", "vertex", "code", "name"])

    return _files(spark, path, run, "path string, vertex int, code int, name string")


def write_traces(df: DataFrame, path: str) -> None:
    """Write traces (``source, repeat, kind, idx, values``) by source; only the sources in the frame are replaced, so an export that was stopped goes on where it was."""
    df.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_traces(spark: SparkSession, path: str, source: int | str | None = None) -> DataFrame:
    """Traces of all sources or of one, which prunes the folders: ``source, repeat, kind, idx, values``, one row an array, so that no source is held in one row."""
    rows = spark.read.parquet(path)
    return (rows if source is None else rows.where(F.col("source") == source)).select("source", "repeat", "kind", "idx", "values")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Files below a directory: ``folder, name, size``; folders relative to it. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    whole = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    inside = F.substring_index(whole, path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return found.select(F.regexp_extract(inside, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(inside, r"([^/]*)$", 1).alias("name"), "size")


def states(spark: SparkSession, path: str, layer: int, story: int, delays: list[int]) -> DataFrame:
    """Vectors of a layer and story (``t, values``, folders by layer and story) as they were so many rows before: ``t, delay, values``; rows before the first give none."""
    rows = spark.read.parquet(path).where((F.col("layer") == layer) & (F.col("story") == story)).select("t", "values")
    moved = rows.select(F.explode(F.array(*map(F.lit, delays))).alias("delay"), "t", "values").select((F.col("t") + F.col("delay")).alias("t"), "delay", "values")
    return moved.join(rows.select("t"), "t", "left_semi")


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v and not v.startswith(("?", "#", "/", "..")) and "://" not in v]


def parse_listing(page: str) -> tuple[list[tuple[str, int]], str | None]:
    """Entries (key, size) of one saved page of an object listing (XML) or directory index (HTML), and the next token."""
    if page.lstrip()[:5].lower() in ("<html", "<!doc"):
        links = _Links()
        links.feed(page)
        return [(link, -1) for link in links.found], None
    root = ElementTree.fromstring(page)
    space = root.tag.partition("}")[0] + "}" if root.tag[0] == "{" else ""
    entries = [(c.findtext(f"{space}Key"), int(c.findtext(f"{space}Size"))) for c in root.iter(f"{space}Contents")]
    return entries, root.findtext(f"{space}NextContinuationToken")


def listing(pages: dict[str | None, str]) -> list[tuple[str, int]]:
    """Entries of all saved pages by token, followed from None; a token that comes again raises."""
    token, seen, out = None, set(), []
    while True:
        if token in seen:
            raise ValueError(f"token comes again: {token}")
        seen.add(token)
        entries, token = parse_listing(pages[token])
        out += entries
        if token is None:
            return out


# First bytes of the formats that are told apart.
SIGNATURES = {"hdf5": b"\x89HDF\r\n\x1a\n", "gzip": b"\x1f\x8b", "zip": b"PK\x03\x04", "parquet": b"PAR1", "numpy": b"\x93NUMPY"}


def content_kind(content: Column) -> Column:
    """Format of a file by its first bytes: one of SIGNATURES, else html, xml, json or other."""
    out = F.lit(None).cast("string")
    for kind, magic in SIGNATURES.items():
        out = F.coalesce(out, F.when(F.startswith(content, F.lit(magic)), kind))
    head = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 64), "ISO-8859-1"), r"^\s+", ""))
    text = F.when(head.startswith("<!doctype html") | head.startswith("<html"), "html").when(head.startswith("<"), "xml").when(head.startswith("{") | head.startswith("["), "json").otherwise("other")
    return F.coalesce(out, text)

