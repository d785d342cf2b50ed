"""Where snapshots, ledgers and ingested tables are written."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

#: Names the workspace; without it everything lies below Spark's warehouse folder.
ROOT_CONF = "spark.drydock.workspace"


def workspace_root(spark: SparkSession) -> str:
    """A lasting folder that all executors reach.

    Not the checkpoint folder: clusters clear that, and these tables are meant to stay.
    """
    root = spark.conf.get(ROOT_CONF, None)
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/drydock").rstrip("/")


def fresh_path(spark: SparkSession, *parts: str) -> str:
    """A new, never used path under the workspace."""
    return "/".join([workspace_root(spark), *parts, uuid.uuid4().hex])


def _owned(spark: SparkSession, path: str):
    """A Hadoop path and the file system that owns it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a path through the Hadoop file system that owns it."""
    target, files = _owned(spark, path)
    return files.delete(target, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, hidden ones left out; none if there is no such folder."""
    target, files = _owned(spark, path)
    if not files.exists(target):
        return []
    names = (status.getPath().getName() for status in files.listStatus(target))
    return sorted(name for name in names if name[0] not in "._")


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder as a whole: readers of the target's parent see all of it or nothing."""
    old, files = _owned(spark, source)
    new, _ = _owned(spark, target)
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"{source} could not be moved to {target}")


def existing_path(spark: SparkSession, path: str) -> str:
    """A path (or pattern of paths) in full, with its file system; nothing there is an error."""
    try:
        target, files = _owned(spark, path)
        if not target.isUriPathAbsolute():
            raise ValueError(f"{path!r} is not an absolute path or URI")
        found = files.globStatus(target)
    except (Py4JJavaError, PySparkException) as error:
        raise ValueError(f"{path!r} is not an absolute path or URI: {error}") from error
    if not found:
        raise ValueError(f"{path!r} does not exist")
    return target.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()
