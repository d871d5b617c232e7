"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or
    one of our own where that is unset (a single machine, as in tests)."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: this cluster names no shared folder")
    own = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def _store(spark: SparkSession, path: str):
    """A path as Hadoop sees it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str, outer: int = 0) -> str:
    """A fresh path in the application's part of the shared folder, which goes when the driver
    ends as it should; in the innermost open scope, or in one that is `outer` scopes around it."""
    own = f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"
    at, store = _store(spark, own)
    store.mkdirs(at)
    store.deleteOnExit(at)
    scopes = _scopes.get()
    return "/".join([own, *scopes[: len(scopes) - outer], f"{name}-{uuid.uuid4().hex}"])


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written as outer; so they take
    room only while they are needed. What leaves a scope must not read them any more."""
    name = f"scope-{uuid.uuid4().hex}"
    held = _scopes.set((*_scopes.get(), name))
    folder = shared_path(spark, name).rpartition("/")[0]
    try:
        yield
    finally:
        _scopes.reset(held)
        at, store = _store(spark, folder)
        store.delete(at, True)


def written(df: DataFrame, name: str, outer: int = 0, compression: str | None = None) -> DataFrame:
    """df written once as a Parquet table in the shared folder and read again: lineage ends
    there, a lost executor costs no recomputation, and Spark knows the table's size. Tables of
    texts take less room with zstd than with what the session compresses by."""
    spark = df.sparkSession
    path = shared_path(spark, name, outer)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like written(), as a table whose rows are dealt to buckets by key: what is grouped or joined by
    key (and more) needs no shuffle. df should be dealt to as many partitions by key before."""
    spark, table = df.sparkSession, f"quarry_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", shared_path(spark, name)).bucketBy(buckets, key).saveAsTable(table)
    atexit.register(_forget, spark, table)
    return spark.table(table)


def _forget(spark: SparkSession, table: str) -> None:
    """Takes a table's name out of the catalog, if there is one left."""
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


@contextlib.contextmanager
def settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what is run inside; its own come back."""
    held = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
