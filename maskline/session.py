"""Session helpers: a local session for tests, and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables of the scope that this thread is in.
_scope: ContextVar[list[str] | None] = ContextVar("maskline_scope", default=None)
#: Paths of the tables that materialize() has written and nobody has deleted.
WRITTEN: list[str] = []


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("maskline")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a folder of our own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="maskline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as a parquet table in the shared folder and read it back.

    Used where a plan needs the same rows several times (or the same partition numbers), so that they are neither
    computed twice nor lost with an executor. The table is columnar: later readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/maskline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = _scope.get()
    (WRITTEN if own is None else own).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that materialize() has written (WRITTEN lists them); frames that read them can no longer be used."""
    for name in list(paths):
        system, path = _path(spark, name)
        system.delete(path, True)
        if name in WRITTEN:
            WRITTEN.remove(name)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The tables that materialize() writes inside, in this thread, for whoever deletes them later; they are not in WRITTEN."""
    own: list[str] = []
    before = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(before)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes inside, in this thread, are deleted at the end: for a batch of a stream, whose
    results are written by then."""
    with recorded() as own:
        try:
            yield
        finally:
            forget(spark, own)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a query as soon as it has ended, so that steps that each write a table don't
    add up on the executors' disks."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def collected(spark: SparkSession) -> None:
    """Asks the driver to look for frames that nobody holds any more: Spark deletes their shuffle files then, and not before."""
    spark._jvm.System.gc()


def exists(spark: SparkSession, name: str) -> bool:
    system, path = _path(spark, name)
    return system.exists(path)


def publish(spark: SparkSession, df: DataFrame, staging: str, name: str) -> None:
    """df as the folder `name`, all of its files at once: written elsewhere, then renamed. A folder that is there stays.

    Needs a file system that renames folders as one step, as checkpoints do.
    """
    if exists(spark, name):
        return
    df.write.mode("overwrite").parquet(staging)
    system, path = _path(spark, name)
    system.mkdirs(path.getParent())
    if not system.rename(_path(spark, staging)[1], path):
        raise RuntimeError(f"could not rename {staging} to {name}")


def make_folder(spark: SparkSession, name: str) -> None:
    system, path = _path(spark, name)
    system.mkdirs(path)
