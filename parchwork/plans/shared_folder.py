"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder where that is unset, which only a local session may be."""
    global _own
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="parchwork-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        root = f"file://{_own}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """A path on a mounted file system as open() takes it."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} isn't on a mounted file system")
    return path.removeprefix("file://")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written to a table and read from there, for plans that read it more than once."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
