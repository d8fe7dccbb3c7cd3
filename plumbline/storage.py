"""Tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is the one named in ``spark.checkpoint.dir``.  Only where that is unset
    on a local master (tests) a temporary folder is made and set; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written.

    This cuts the lineage: a lost executor costs a re-read, not a re-run, and
    values that depend on partitioning stay what they were.
    """
    return written_to(df, shared_path(df.sparkSession, name))


def written_to(df: DataFrame, path: str) -> DataFrame:
    """The same at a path of the caller's."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def digest_of(df: DataFrame) -> str:
    """A digest of the files that ``df`` reads: their names, lengths and times."""
    told = []
    for name in sorted(df.inputFiles()):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.sparkSession._jvm.java.net.URI(name))
        status = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(at)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def once(source: DataFrame, name: str, make: Callable[[str], None]) -> str:
    """The folder of what ``make`` writes of the files of ``source``: made when it is first asked for, kept while they stay what they are.

    A folder counts once it is renamed to its final name, so one that was broken off is never read.  Of two that are
    made at a time the first stays.
    """
    spark = source.sparkSession
    final = f"{shared_root(spark)}/plumbline/{name}-{digest_of(source)[:32]}"
    system, at = _file_system(spark, final)
    if not system.exists(at):
        draft = shared_path(spark, f"{name}-draft")
        make(draft)
        if not system.exists(at):
            system.rename(_file_system(spark, draft)[1], at)
    return final


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder in order; none if it is not there."""
    system, at = _file_system(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def published(df: DataFrame, path: str) -> bool:
    """Write the few rows of ``df`` and rename them to ``path`` in one step; false if another was there first, which stays."""
    spark = df.sparkSession
    system, at = _file_system(spark, path)
    if system.exists(at):
        return False
    draft = f"{path.rpartition('/')[0]}-drafts/{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(draft)
    system.mkdirs(at.getParent())
    if not system.rename(_file_system(spark, draft)[1], at):
        return False
    # a rename onto a folder that came in between puts the draft inside it
    nested = _file_system(spark, f"{path}/{draft.rpartition('/')[2]}")[1]
    if system.exists(nested):
        system.delete(nested, True)
        return False
    return True


def removed(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)
