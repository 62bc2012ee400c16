"""Replacing a stored table: the new one is complete before the old one goes, and a stop in between is mended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def _names(path: str) -> tuple[str, str]:
    """Where the new table is written and where the old one waits. Spark lists no folder that begins with ``_``."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/_new-{name}", f"{folder}/_old-{name}"


class _Folders:
    """The calls of the path's file system that a swap needs; a call that does nothing is an error."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(path).getFileSystem(context._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def move(self, source: str, target: str) -> None:
        if not self._system.rename(self._path(source), self._path(target)):
            raise OSError(f"{source} could not be moved to {target}")

    def remove(self, path: str) -> None:
        if not self._system.delete(self._path(path), True):
            raise OSError(f"{path} could not be removed")


def replace_table(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` store a table in a folder beside ``path``, then put it in the place of ``path``.

    ``write`` may read ``path``, which stays as it is until the new table is complete. A job that is lost
    before that changes nothing; one that is lost between the two moves is mended by ``recover``, which
    this calls first and readers of ``path`` may call.
    """
    recover(spark, path)
    staged, _ = _names(path)
    write(staged)
    swap(spark, path)


def swap(spark: SparkSession, path: str) -> None:
    folders = _Folders(spark, path)
    staged, old = _names(path)
    if folders.exists(path):
        folders.move(path, old)
    folders.move(staged, path)
    if folders.exists(old):
        folders.remove(old)


def recover(spark: SparkSession, path: str) -> None:
    """Finish a swap that stopped: ``path`` is the new table if that was complete, else the old one."""
    folders = _Folders(spark, path)
    staged, old = _names(path)
    if not folders.exists(old):
        return
    if folders.exists(path):
        folders.remove(old)
    elif folders.exists(f"{staged}/_SUCCESS"):
        folders.move(staged, path)
        folders.remove(old)
    else:
        folders.move(old, path)
