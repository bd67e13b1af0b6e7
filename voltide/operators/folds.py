"""Fold assignment: independent shuffle splits of snapshots, row splits and K-fold parts.

Order is by a portable hash, so folds do not depend on partitioning and any SQL engine can
reproduce them.  Exact split sizes come from a distributed index, not from a window over one
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltide.functions.columns import mixed_hash
from voltide.plans.ordered import with_global_index

SEED = 42


def row_key(stock: str = "stock_id", time: str = "time_id") -> Column:
    return F.col(stock).cast("bigint") * 1000003 + F.col(time)


def distinct_snapshots(df: DataFrame) -> DataFrame:
    return df.select("time_id").distinct()


def shuffle_splits(snapshots: DataFrame, n_splits: int = 5, test_ratio: float = 0.2, seed: int = SEED,
                   n_inner: int = 5) -> DataFrame:
    """``fold, time_id, split, inner``: ceil(ratio * n) test snapshots per fold.

    Test sets of different folds may overlap.  ``inner`` numbers balanced inner parts of the
    training snapshots (-1 on test rows).
    """
    order = [F.struct(F.lit(k).alias("fold"), mixed_hash("time_id", seed + k).alias("h")) for k in range(n_splits)]
    exploded = snapshots.select("time_id", F.explode(F.array(*order)).alias("_o")).select("_o.*", "time_id")
    indexed = with_global_index(exploded, ["fold", "h", "time_id"])
    sizes = indexed.groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    pos = F.col("idx") - F.col("fold") * F.col("_n")
    n_test = F.ceil(F.col("_n") * F.lit(float(test_ratio)))
    return indexed.join(F.broadcast(sizes), "fold").select(
        "fold", "time_id",
        F.when(pos < n_test, "test").otherwise("train").alias("split"),
        F.when(pos < n_test, -1).otherwise((pos - n_test) % n_inner).cast("int").alias("inner"),
    )


def overlap_check(assignment: DataFrame) -> DataFrame:
    """Snapshots on both sides of a fold; must be empty."""
    train = assignment.where("split = 'train'").select("fold", "time_id")
    test = assignment.where("split = 'test'").select("fold", "time_id")
    return train.intersect(test)


def with_folds(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Attach every fold's split to each row.

    The per-snapshot memberships travel as one array, so a row crosses the shuffle once and is
    multiplied by the number of folds only afterwards, map-side.
    """
    packed = assignment.groupBy("time_id").agg(F.collect_list(F.struct("fold", "split", "inner")).alias("_folds"))
    return df.join(packed, "time_id").select(*df.columns, F.explode("_folds").alias("_f")).select(*df.columns, "_f.*")


def split_rows(df: DataFrame, assignment: DataFrame, fold: int, split: str) -> DataFrame:
    """Rows of one side of one fold (semi join on the snapshot)."""
    chosen = assignment.where((F.col("fold") == fold) & (F.col("split") == split)).select("time_id")
    return df.join(chosen, "time_id", "left_semi")


def require_folds(assignment: DataFrame, folds: list[int] | None = None) -> DataFrame:
    """Keep the chosen folds; fail when a fold or one of its sides is missing."""
    out = assignment if folds is None else assignment.where(F.col("fold").isin(folds))
    present = {(r.fold, r.split) for r in out.select("fold", "split").distinct().collect()}
    wanted = folds if folds is not None else sorted({f for f, _ in present})
    missing = [(f, s) for f in wanted for s in ("train", "test") if (f, s) not in present]
    if not wanted or missing:
        raise ValueError(f"missing fold sides: {missing or 'no folds'}")
    return out


def holdout_split(rows: DataFrame, test_ratio: float = 0.2, seed: int = SEED) -> DataFrame:
    """Row-level split: max(1, round(ratio * n)) test rows."""
    keyed = rows.withColumn("_h", mixed_hash(row_key(), seed))
    indexed = with_global_index(keyed, ["_h", "stock_id", "time_id"]).withColumn("_k", F.lit(0))
    size = indexed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    n_test = F.greatest(F.lit(1), F.rint(F.col("_n") * F.lit(float(test_ratio))))
    return indexed.join(F.broadcast(size), "_k").withColumn(
        "split", F.when(F.col("idx") < n_test, "test").otherwise("train")
    ).drop("_h", "_k", "_n", "idx")


def _even_parts(idx: Column, n: Column, parts: Column) -> Column:
    """Part number when n rows are cut into near-equal runs, longer runs first."""
    size, longer = F.floor(n / parts), n % parts
    head = longer * (size + 1)
    return F.when(idx < head, F.floor(idx / (size + 1))).otherwise(
        longer + F.floor((idx - head) / F.greatest(size, F.lit(1)))
    ).cast("int")


def kfold_parts(rows: DataFrame, n_splits: int = 5, by_stock: bool = False, seed: int = SEED) -> DataFrame:
    """Add ``part`` (0-based) for K-fold CV over rows, or over whole stocks."""
    if by_stock:
        stocks = rows.select("stock_id").distinct().withColumn("_h", mixed_hash("stock_id", seed))
        indexed = with_global_index(stocks, ["_h", "stock_id"])
    else:
        indexed = with_global_index(rows.withColumn("_h", mixed_hash(row_key(), seed)), ["_h", "stock_id", "time_id"])
    indexed = indexed.withColumn("_k", F.lit(0))
    size = indexed.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    n = F.col("_n")
    parts = indexed.join(F.broadcast(size), "_k").withColumn(
        "part", _even_parts(F.col("idx"), n, F.least(n, F.lit(n_splits)))
    ).drop("_h", "_k", "_n", "idx")
    return rows.join(parts.select("stock_id", "part"), "stock_id") if by_stock else parts
