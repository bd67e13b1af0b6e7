"""Writers: fold tables, CSV, JSON and Parquet sinks, and write-once intermediates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from voltide.operators.folds import with_folds
from voltide.sources.readers import _exists


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Snappy Parquet; partitioned outputs are clustered first so each folder gets few files."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)   # by size: large folders get more files
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_folds(book_sec: DataFrame, assignment: DataFrame, path: str) -> None:
    """Full table once, fold membership beside it, and the per-fold train/test tables.

    Jobs of this package use the first two; the copied fold tables are for outside readers.
    """
    write_parquet(book_sec, f"{path}/full")
    write_parquet(assignment, f"{path}/fold_assignment")
    write_parquet(with_folds(book_sec, assignment).drop("inner"), f"{path}/folds", ["fold", "split"])


def write_tensor(tensor: DataFrame, path: str) -> None:
    write_parquet(tensor, path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metric table as JSON lines, one object per row."""
    write_json(metrics, path)


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` if a finished table is there, else build, write and read it back."""
    if not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_trees(trees, path: str) -> None:
    """Write fitted trees in order; :func:`load_trees` reads them back."""
    for i, tree in enumerate(trees):
        tree.write().overwrite().save(f"{path}/tree_{i:05d}")


def load_trees(path: str, n: int) -> list:
    """The first ``n`` trees saved under ``path``."""
    from pyspark.ml.regression import DecisionTreeRegressionModel

    return [DecisionTreeRegressionModel.load(f"{path}/tree_{i:05d}") for i in range(n)]
