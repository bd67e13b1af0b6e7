"""Session helpers: sensible defaults and a safe place for lineage cuts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "voltide", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and the time zone pinned.

    Nothing cluster-specific is forced: master and sizes come from ``spark-submit``
    unless given here (tests and the bench give them).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a scratch one is made only in local mode where none is set."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


_written: dict[str, list[str]] = {}
_drops = 0
_scope: ContextVar[str] = ContextVar("scope", default="session")


@contextlib.contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """Tables written inside are noted under ``name``, so that they can be dropped apart from others."""
    before = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(before)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, noted under the current scope for :func:`drop_tables`."""
    path = f"{shared_folder(spark).rstrip('/')}/voltide-{uuid.uuid4().hex}"
    _written.setdefault(_scope.get(), []).append(path)
    return path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str) -> None:
    """Write ``df``; the write's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The table survives the loss of any executor, is computed once, and stays columnar, so later
    steps read only the columns they use. It is kept until :func:`drop_tables` is called for its scope.
    """
    path = scratch_path(df.sparkSession)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewrite_table(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Like :func:`cut_lineage`, and deletes the table at ``path``, which nothing but ``df`` may still read."""
    spark, new = df.sparkSession, scratch_path(df.sparkSession)
    write_table(df, new)
    if path:
        delete_path(spark, path)
    return spark.read.schema(df.schema).parquet(new), new


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tables_dropped() -> int:
    """How often :func:`drop_tables` ran; what is kept between queries and reads a scratch table holds only as long as this stays."""
    return _drops


def drop_tables(spark: SparkSession, scope: str | None = None) -> int:
    """Delete the scratch tables of one scope, or of all; returns how many. Frames that read them end with it."""
    global _drops
    _drops += 1
    paths = _written.pop(scope, []) if scope else [p for ps in _written.values() for p in ps]
    if not scope:
        _written.clear()
    for path in paths:
        delete_path(spark, path)
    return len(paths)
