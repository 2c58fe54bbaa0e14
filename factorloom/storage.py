"""Stored intermediate tables and files: they cut lineage, and survive the loss of any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has stored and not deleted.
STORED: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the store that Spark takes it to be in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Where a qualified path is, for reading and writing by ranges; a plain path is on this machine."""
    scheme, _, rest = uri.partition(":")
    if not rest or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's qualified path, deleted by `discard_all`."""
    path = qualified(spark, f"{scratch_dir(spark)}/{uuid.uuid4().hex}")
    STORED[path] = spark
    return path


def materialize(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write a table to the scratch folder and return it as read from there: its lineage ends here.

    Unlike a checkpoint of a DataFrame, this computes the plan once, and any executor may be lost afterwards. It is written in `parts` files at
    most, for tables that are known to be smaller than the shuffle's partitions make them seem: many small files cost more than their rows.
    """
    path = scratch_folder(df.sparkSession)
    (df if parts is None else df.coalesce(max(1, parts))).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(*folders: str) -> None:
    for folder in folders:
        spark = STORED.pop(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    delete(*{df.scratch_path for df in tables if df.scratch_path in STORED})


def discard_all() -> None:
    """Delete whatever this process still has stored; results that read it have to be written by then."""
    delete(*STORED)


@contextmanager
def temporary() -> Iterator[None]:
    """What is stored within is deleted at the end; results that read it have to be written by then."""
    before = set(STORED)
    try:
        yield
    finally:
        delete(*(set(STORED) - before))
