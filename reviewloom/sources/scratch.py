"""Tables on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local runs by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir`` or the checkpoint folder that is set.

    Where neither is, a local run gets a temporary folder; on a cluster that is an
    error, as no machine's own folder would do. Nothing is set for the session.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = context.applicationId
        found = _LOCAL[key] = _LOCAL.get(key) or "file://" + tempfile.mkdtemp(prefix="reviewloom-")
    return found.rstrip("/")


#: (label, path) of the tables that the innermost :func:`tables_made` of this thread has seen.
_MADE: ContextVar[list[tuple[str, str]] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    path = f"{shared_dir(spark)}/reviewloom-{label}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append((label, path))
    return path


#: Spark's setting for removing the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors.

    The shuffle files behind it go when it is written, instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables_made(spark: SparkSession) -> Iterator[Callable[[Collection[str]], None]]:
    """Gives a function that removes the tables written within so far, but for those of the labels it is called with."""
    made: list[tuple[str, str]] = []

    def drop_but(labels: Collection[str]) -> None:
        for label, path in made:
            if label not in labels:
                delete(spark, path)
        made[:] = [m for m in made if m[0] in labels]

    outer = _MADE.get()
    token = _MADE.set(made)
    try:
        yield drop_but
    finally:
        _MADE.reset(token)
        if outer is not None:
            outer.extend(made)
