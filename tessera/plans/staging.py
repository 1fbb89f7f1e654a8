"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back: the files outlive
any executor, and a later stage starts from them instead of recomputing. A local session, whose driver is its only
executor, may leave the setting out; a folder of this process then takes its place. On a cluster that is an error.

Tables are removed when nothing reads them any more: ``drop`` removes one, as loops do with the state of the round before,
and ``scope`` removes what was written inside it but for the tables it is told to keep.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
#: Spark's setting by which an execution removes its shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessera-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder as a URI, without a trailing slash."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder, with the writer's options, and return the written table."""
    path = new_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._staged_at = path
    return made


def _remove(spark: SparkSession, path: str) -> None:
    if path in _written:
        _written.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame | None) -> None:
    """Removes tables that ``stage`` returned; nothing may read them any more."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            _remove(df.sparkSession, path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes, at its end, all tables staged inside it that are not in the list it gives."""
    before, kept = set(_written), []
    try:
        yield kept
    finally:
        stay = {getattr(df, "_staged_at", None) for df in kept}
        for path in [p for p in _written if p not in before and p not in stay]:
            _remove(spark, path)
