"""Which files lie in a folder, apart from reading them."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _statuses(fs, path) -> list:
    """What lies in a folder; nothing if it can't be listed (no rights, or gone meanwhile)."""
    try:
        return list(fs.listStatus(path))
    except Py4JJavaError:
        return []


def _below(fs, status, depth: int) -> Iterator[str]:
    if status.isFile():
        yield status.getPath().toString()
    elif depth:
        for child in sorted(_statuses(fs, status.getPath()), key=lambda s: s.getPath().toString()):
            yield from _below(fs, child, depth - 1)


def list_files(spark: SparkSession, folder: str, max_depth: int) -> list[str]:
    """Paths of all files down to max_depth levels of a folder (itself level 1), of a file, or of what a pattern names.

    Folders that can't be listed are skipped with all below, and deeper ones aren't listed. One call a
    folder; like Spark's own listing, the paths are held by the driver, contents are not touched.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    if found is None or not len(found):  # a name may hold what would be a pattern
        found = [fs.getFileStatus(path)] if fs.exists(path) else None
    if found is None:
        raise FileNotFoundError(folder)
    return [file for status in found for file in _below(fs, status, max_depth)]
