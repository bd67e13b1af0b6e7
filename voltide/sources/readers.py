"""Readers: raw book CSV files, dense books, predictions, saved tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltide import schemas
from voltide.functions.columns import stock_number


def stock_id_from_file():
    """Stock number from names such as ``stock_17.csv``."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.csv", 1).cast("int")


def read_raw_book(spark: SparkSession, folder: str) -> DataFrame:
    """All ``stock_<n>.csv`` files of a folder, the ten book columns only.

    The first file's header names the columns; a file whose header differs fails the read instead of being
    taken by position. Types are applied by name after an all-string read.
    """
    text = spark.read.option("header", True).option("enforceSchema", False).option("pathGlobFilter", "stock_*.csv").csv(folder)
    missing = sorted(set(schemas.BOOK_RAW_COLUMNS) - set(text.columns))
    if missing:
        raise ValueError(f"{folder} is missing book columns: {missing}")
    return text.select(
        stock_id_from_file().alias("stock_id"),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.BOOK_RAW])


def limit_stocks(df: DataFrame, n: int | None) -> DataFrame:
    """Keep the ``n`` smallest stock ids (None keeps all)."""
    if n is None:
        return df
    return df.join(df.select("stock_id").distinct().orderBy("stock_id").limit(n), "stock_id", "left_semi")


def read_book_sec(spark: SparkSession, path: str) -> DataFrame:
    """Dense per-second book from Parquet, stock ids normalised."""
    df = spark.read.parquet(path)
    if dict(df.dtypes)["stock_id"] == "string":
        df = df.withColumn("stock_id", stock_number("stock_id"))
    return df


def read_fold(spark: SparkSession, path: str, fold: int, split: str) -> DataFrame:
    """One side of one fold; partition pruning reads only its files."""
    return spark.read.parquet(path).where((F.col("fold") == fold) & (F.col("split") == split))


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prediction CSVs of several folds; paths that do not exist are skipped, none at all fails.

    All headers must agree (a file with another order fails the read); ids may carry a ``stock_`` prefix.
    """
    present = [p for p in paths if _exists(spark, p)]
    if not present:
        raise ValueError(f"no prediction files among {list(paths)}")
    text = spark.read.option("header", True).option("enforceSchema", False).csv(present)
    return text.select(
        stock_number("stock_id").alias("stock_id"), F.col("time_id").cast("int").alias("time_id"),
        F.col("fold").cast("int").alias("fold"), F.col("actual_rv").cast("double").alias("actual_rv"),
        F.col("predicted_rv").cast("double").alias("predicted_rv"))


def rename_forecasts(df: DataFrame, fold: int, actual: str, predicted: str) -> DataFrame:
    """A model's own forecast table in the shared prediction layout."""
    return df.select(stock_number("stock_id").alias("stock_id"), F.col("time_id").cast("int").alias("time_id"),
                     F.lit(fold).alias("fold"), F.col(actual).cast("double").alias("actual_rv"),
                     F.col(predicted).cast("double").alias("predicted_rv")).orderBy("stock_id", "time_id")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A saved feature, tensor or dashboard table (Parquet, or CSV with a schema)."""
    if path.rstrip("/").endswith(".csv") or schema is not None:
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
