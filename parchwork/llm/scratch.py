"""Intermediate tables in the folder that the cluster shares.

``stash`` cuts lineage by writing a table and reading it again. The folder is
``spark.checkpoint.dir`` of the session; only a local session may go without.

A result is lazy, so its tables must outlive the call that made it: they stay
until ``discard``, the end of their ``Scope`` or the end of the process.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
#: Tables that exist, each with the session that made it.
_live: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    global _local_root
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="parchwork-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


class Scope:
    """The tables made while ``recording``; no others are deleted with it."""

    def __init__(self):
        self.paths: list[str] = []

    @contextlib.contextmanager
    def recording(self) -> Iterator[None]:
        token = _scope.set(self)
        try:
            yield
        finally:
            _scope.reset(token)

    def is_read_by(self, df: DataFrame) -> bool:
        """Whether df reads one of the tables."""
        plain = lambda path: path.removeprefix("file:").lstrip("/")
        return not {plain(p) for p in self.paths}.isdisjoint(map(plain, read_by(df)))

    def end(self) -> None:
        """Delete the tables; nothing that was made of them may be read any more."""
        for path in self.paths:
            _delete(path)
        self.paths = []


_scope: contextvars.ContextVar[Scope | None] = contextvars.ContextVar("scope", default=None)


def fresh(spark: SparkSession, tag: str) -> str:
    """A path for a table of this process."""
    path = f"{scratch_root(spark)}/parchwork/{tag}-{uuid.uuid4().hex}"
    _live[path] = spark
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    return path


def stash(df: DataFrame, tag: str) -> DataFrame:
    """df, written to a table of its own and read from there."""
    spark = df.sparkSession
    path = fresh(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete tables that nothing will read again."""
    for df in stashed:
        _delete(df._stash_path)


def remove(path: str) -> None:
    """Delete the table at a path from ``fresh``."""
    _delete(path)


def read_by(df: DataFrame) -> set[str]:
    """The folders that df reads."""
    out, leaves = set(), df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        if leaves.apply(k).getClass().getSimpleName() == "LogicalRelation" and leaves.apply(k).relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaves.apply(k).relation().location().rootPaths()
            out |= {str(roots.apply(n).toString()) for n in range(roots.size())}
    return out


def _delete(path: str) -> None:
    if (spark := _live.pop(path, None)) is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _end() -> None:
    for path in list(_live):
        with contextlib.suppress(Exception):  # the JVM may be gone by then
            _delete(path)
