"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which the cluster names. A lost
executor then costs only the tasks that it was running: later stages reread the written table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Paths given out, for ``cleared``.
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset on one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or _LOCAL.get(context.applicationId)
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="proofmill-")
    return _LOCAL[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    _WRITTEN.append(f"{shared_folder(spark)}/proofmill/{uuid.uuid4().hex}/{name}")
    return _WRITTEN[-1]


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once and return a reader of what was written."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file system that Spark can open has ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, every table that was written in it; results read from them have to be written or counted before.

    Without such a block the tables stay until the shared folder is cleared.
    """
    outer, _WRITTEN[:] = list(_WRITTEN), []
    try:
        yield
    finally:
        for path in _WRITTEN:
            at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN[:] = outer
