"""Session defaults, table access and durable lineage cuts."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

#: Settings for sessions that this package makes itself; a session handed in is used as it is.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", app: str = "loomspan", **extra: str) -> SparkSession:
    """A session with the package's defaults; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, once an application, unless their path has it already."""
    root = str(Path(__file__).resolve().parent.parent)
    context = spark.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *([os.getcwd()] if context.master.startswith("local[") else [])]
    if context.applicationId in _shipped or root in map(os.path.realpath, filter(None, known)):
        return
    _shipped.add(context.applicationId)
    context.addPyFile(shutil.make_archive(tempfile.mkdtemp() + "/loomspan", "zip", root, "loomspan"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a directory of part files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables: that of ``spark.checkpoint.dir``.

    Where nothing is set a temporary one is made, but only if driver and executors are one process; on a cluster that raises.
    """
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _temporary:
        _temporary[context.applicationId] = tempfile.mkdtemp(prefix="loomspan-")
    return _temporary[context.applicationId]


_temporary: dict[str, str] = {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder, so that a lost executor costs no earlier round.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go when the frame does.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


_held: list[DataFrame] = []


def kept(df: DataFrame) -> DataFrame:
    """Cache for reuse within one query; partitions that do not fit go to disk and are recomputed if lost. ``release`` gives it back."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(held)
    return held


def release() -> int:
    """Give back all that ``kept`` holds, once a query's result is written; returns how many frames that were."""
    count = 0
    while _held:
        _held.pop().unpersist()
        count += 1
    return count
