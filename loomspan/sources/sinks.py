"""Sinks that publish once, whole and checked."""

from __future__ import annotations

import hashlib
import html
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.jsons import written


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, jvm.org.apache.hadoop.fs.Path


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """Content of a small file on any file system that Spark reaches, None where there is none."""
    fs, where, _ = _hadoop(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file under another name and rename it over the old one in one step, so readers always find one of both, whole."""
    fs, where, make = _hadoop(spark, path)
    staged = make(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(staged, True)
    stream.write(bytearray(content))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(where), options)


def canonical(value: object) -> bytes:
    """JSON with sorted keys and no spaces; NaN and infinities are null."""
    return written(value, by_name=True).encode()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Publish a report of one JSON value."""
    write_bytes(spark, path, canonical(value))


def write_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """Publish what may never change: False if the same is there, an error if something else is."""
    there = read_bytes(spark, path)
    if there is None:
        write_bytes(spark, path, content)
        return True
    if there != content:
        raise FileExistsError(f"{path} holds something else")
    return False


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON object a line, members sorted by name, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").option("compression", compression).option("ignoreNullFields", "false").json(path)


def frame_hash(df: DataFrame) -> str:
    """Digest of a frame's rows, whatever their order: built from counts of row digests that meet as sums, never as rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)]).first()
    return hashlib.sha256(canonical([str(x) for x in sums])).hexdigest()


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], identity: dict) -> str:
    """Write tables to a staging directory, name it by the digest of identity and contents, and point ``latest`` to it.

    A build of the same digest that is there already is kept. Returns the digest.
    """
    fs, _, make = _hadoop(spark, root)
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    hashes = {}
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{staging}/{name}")
        hashes[name] = frame_hash(spark.read.parquet(f"{staging}/{name}"))
    receipt = {"identity": identity, "artifacts": hashes}
    digest = hashlib.sha256(canonical(receipt)).hexdigest()
    write_json(spark, f"{staging}/receipt.json", receipt)
    if fs.exists(make(f"{root}/{digest}")):
        fs.delete(make(staging), True)
    elif not fs.rename(make(staging), make(f"{root}/{digest}")):
        raise OSError(f"cannot publish {digest}")
    write_bytes(spark, f"{root}/latest", digest.encode())
    return digest


def latest(spark: SparkSession, root: str) -> str:
    """Directory of the newest build."""
    pointer = read_bytes(spark, f"{root}/latest")
    if pointer is None:
        raise FileNotFoundError(root)
    return f"{root}/{pointer.decode()}"


def verify(spark: SparkSession, directory: str) -> list[str]:
    """Artifacts of a build whose content is not that of its receipt."""
    receipt = json.loads(read_bytes(spark, f"{directory}/receipt.json"))
    return [name for name, digest in receipt["artifacts"].items() if frame_hash(spark.read.parquet(f"{directory}/{name}")) != digest]


def checked(df: DataFrame, expected: str) -> DataFrame:
    """The frame, if its digest is the expected one."""
    if frame_hash(df) != expected:
        raise ValueError("content does not have the expected digest")
    return df


def append_log(df: DataFrame, path: str) -> None:
    """Append events to a log table."""
    df.write.mode("append").parquet(path)


def html_report(title: str, df: DataFrame, most: int = 1000) -> str:
    """A page with a report's rows; a report of more than ``most`` rows raises rather than being cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "".join(cell("th", c) for c in df.columns)
    body = "".join("<tr>" + "".join(cell("td", x) for x in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
