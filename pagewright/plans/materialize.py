"""Cutting lineage into storage that every executor shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
#: Spark's setting by which a query's shuffle files go when it ends; they stay until the driver collects its garbage otherwise.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(jvm, configuration, root: str) -> None:
    """Delete a session's folder when its driver ends; a JVM that is gone leaves local folders to Python."""
    with contextlib.suppress(Exception):
        target = jvm.org.apache.hadoop.fs.Path(root)
        target.getFileSystem(configuration).delete(target, True)
    if root.startswith("file:"):
        shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder below ``spark.checkpoint.dir``, deleted when the driver ends.

    Where that is unset, a local master (as in tests) gets a temporary folder; any other one raises, as
    a folder of one machine would not outlive an executor.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _ROOTS:
        configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if configured:
            root = f"{configured.rstrip('/')}/pagewright-{app}"
        elif context.master.startswith("local"):
            root = f"file://{tempfile.mkdtemp(prefix='pagewright-')}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _ROOTS[app] = root
        atexit.register(_remove, context._jvm, context._jsc.hadoopConfiguration(), root)
    return _ROOTS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, what is written deletes its shuffle files as soon as it is there."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The result does not depend on any executor staying alive, is columnar (so later
    branches read only what they need) and carries exact sizes for the optimiser. The
    shuffle files of writing it are deleted at once.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_go(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """:func:`materialize`, and the number of rows, counted as they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return out, seen.get["n"]


def discard(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in frames:
        delete_path(df.sparkSession, df._written_at)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path through the Hadoop file system it lives on; missing paths are fine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on the Hadoop file system it lives on."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
