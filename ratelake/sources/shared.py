"""The shared folder for data that must outlive an executor."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the one the session gives in spark.checkpoint.dir.

    Without that setting, a local session gets a temporary folder; on a cluster a
    machine's own folder would be lost with the machine, so there it is an error.
    """
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for folders in _TRACKED:
        folders.append(path)
    return path


def shared_root(spark: SparkSession) -> str:
    """The folder that all shared folders are in."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_folder()
    return root.rstrip("/")


#: The lists that are being kept of new folders.
_TRACKED: list[list[str]] = []
#: The name of a folder of :func:`shared_folder`; nothing else is ever swept.
_OURS = re.compile(r"[\w-]+-[0-9a-f]{32}$")


@contextmanager
def tracking() -> Iterator[list[str]]:
    """Keeps a list of the shared folders named while it lasts."""
    folders: list[str] = []
    _TRACKED.append(folders)
    try:
        yield folders
    finally:
        _TRACKED[:] = [one for one in _TRACKED if one is not folders]


def remove_folders(spark: SparkSession, folders: Iterable[str], keep: Iterable[str] = ()) -> None:
    """Remove shared folders, but for those to keep."""
    kept = set(keep)
    for path in folders:
        if path not in kept:
            remove_folder(spark, path)


def sweep_shared(spark: SparkSession, hours: float = 72.0, keep: Iterable[str] = ()) -> list[str]:
    """Remove shared folders that were last changed more than ``hours`` ago, as a crash
    leaves them; returns them. Those to ``keep`` stay (what notes name), and so does every
    folder with another kind of name. A job that is running has touched its folders since:
    choose ``hours`` above the longest job.
    """
    kept = {path.rstrip("/").rsplit("/", 1)[-1] for path in keep}
    gone = []
    for path in folders_older_than(spark, shared_root(spark), hours):
        name = path.rstrip("/").rsplit("/", 1)[-1]
        if _OURS.match(name) and name not in kept:
            remove_folder(spark, path)
            gone.append(path)
    return gone


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="ratelake-")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read back: no lineage to what they came from.

    Needed where the plan reads a table that is about to be rewritten.
    """
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same as :func:`staged`, and the folder, for a later run to find."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def folders_older_than(spark: SparkSession, root: str, hours: float) -> list[str]:
    """The folders in ``root`` that were last changed more than ``hours`` ago."""
    folder, system = _folder(spark, root)
    if not system.exists(folder):
        return []
    limit = (time.time() - hours * 3600) * 1000
    found = [s for s in system.listStatus(folder) if s.isDirectory()]
    return [s.getPath().toString() for s in found if s.getModificationTime() <= limit]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that the session can write to."""
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(context._jsc.hadoopConfiguration())
