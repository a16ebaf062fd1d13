"""Cutting lineage in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session, else the checkpoint folder set on its context.  Only on a
local master, where both may be absent (tests on one machine), a temporary folder is made; elsewhere that is an error.
Files are written as Parquet, so a lost executor costs a re-read and never a re-run of the steps before the cut.
They are deleted at the end of the :func:`scope` they were made in, else when the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
_SCOPE: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("marlstone_scope", default=_MADE)


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only on a local master where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    return _OWN[key]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Columns keep their names and types.  An empty table stays empty with its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession, path: str) -> None:
    """Note a file or folder of this process in the shared folder, for :func:`drop_cuts`."""
    _SCOPE.get().append((spark, path))


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is cut inside is deleted at the end, but for what the given function cuts: that belongs to the scope around it."""
    own: list[tuple[SparkSession, str]] = []
    outer = _SCOPE.get()
    token = _SCOPE.set(own)

    def keep(df: DataFrame) -> DataFrame:
        out = cut_lineage(df)
        outer.append(own.pop())
        return out

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        _delete(own)


def drop_cuts() -> None:
    """Delete what this process wrote to the shared folder (also runs at exit)."""
    _delete(_MADE)


def _delete(made: list[tuple[SparkSession, str]]) -> None:
    while made:
        spark, path = made.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended; its folder goes with the cluster
            pass


atexit.register(drop_cuts)
