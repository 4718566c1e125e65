"""Versioned folders: readers never see half of a replacement.

A new version is written to a folder of its own; creating its numbered marker, one file that must not exist
yet, publishes it. A write that fails leaves no marker, so the version before stays current. Two writers that
finish together get successive numbers. Works on any file system Spark writes to (no rename is needed).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_MARKERS = "_versions"


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _read(spark: SparkSession, path) -> str:
    fs, _ = _fs(spark, path.toString())
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Published versions: number -> folder."""
    fs, folder = _fs(spark, f"{root}/{_MARKERS}")
    if not fs.exists(folder):
        return {}
    return {int(s.getPath().getName()): f"{root}/{_read(spark, s.getPath())}" for s in fs.listStatus(folder) if s.getPath().getName().isdigit()}


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest published version, or None."""
    known = versions(spark, root)
    return known[max(known)] if known else None


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write(folder)`` fill a new folder, then make it the current version. Returns the folder."""
    root = root.rstrip("/")
    name = f"v-{uuid.uuid4().hex}"
    write(f"{root}/{name}")
    number = max(versions(spark, root), default=0) + 1
    while True:
        fs, marker = _fs(spark, f"{root}/{_MARKERS}/{number}")
        try:
            stream = fs.create(marker, False)
        except Py4JJavaError:
            if not fs.exists(marker):
                raise
            number += 1  # another writer published this number
            continue
        stream.write(bytearray(name.encode()))
        stream.close()
        return f"{root}/{name}"


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` published versions."""
    known = versions(spark, root)
    for number in sorted(known)[:-keep] if keep else sorted(known):
        for path in (f"{root}/{_MARKERS}/{number}", known[number]):
            fs, jpath = _fs(spark, path)
            fs.delete(jpath, True)
