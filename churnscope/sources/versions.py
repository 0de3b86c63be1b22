"""Versioned folders: a store's content is written as a new version, then announced.

Readers take the last announced version, so a write that fails half-way leaves
the former one in place, and a table may be derived from the version it
replaces.  Versions are numbered by what was announced before, not by clocks.
Old versions stay for running readers until :func:`vacuum` removes them.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_DIGITS = 20


def folder_name(part: str) -> str:
    """A folder name that no other text gets (percent-encoded)."""
    if part in ("", ".", ".."):
        raise ValueError(f"not a name for a stored object: {part!r}")
    return quote(part, safe="@")


def new_version(spark: SparkSession, path: str) -> str:
    """Folder for a new version of what is stored under ``path``: one number
    above the current one.  Two writers may get one number; of their versions
    the one with the greater name is the later one, for every reader."""
    last = current(spark, path)
    number = int(os.path.basename(last)[1:_DIGITS + 1]) + 1 if last else 1
    return os.path.join(path, f"v{number:0{_DIGITS}d}-{uuid.uuid4().hex}")


def announce(spark: SparkSession, path: str, version: str) -> None:
    """Make a completely written version the current one."""
    row = spark.createDataFrame([(os.path.basename(version),)], "version string")
    row.coalesce(1).write.mode("append").parquet(os.path.join(path, "versions"))


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the announced versions, oldest first (one short row each)."""
    try:
        rows = spark.read.schema("version string").parquet(os.path.join(path, "versions"))
        return sorted(r.version for r in rows.distinct().collect())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the last announced version; None where there is none."""
    try:
        last = spark.read.schema("version string").parquet(os.path.join(path, "versions")).agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return last and os.path.join(path, last)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the ``keep`` last announced versions, and what was
    written but never announced below them; returns the removed folders' names.

    A version being written now has a number above the current one and stays.
    """
    if keep < 1:
        raise ValueError("the current version must stay")
    known = versions(spark, path)
    if not known:
        return []
    kept = set(known[-keep:])
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("v") and name != "versions" and name not in kept and name < known[-1]:
            files.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
