"""Explicit schemas; nothing is inferred at read time."""

from pyspark.sql import types as T

BOOK_RAW_FIELDS = (
    ("time_id", T.IntegerType()),
    ("seconds_in_bucket", T.IntegerType()),
    ("bid_price1", T.DoubleType()),
    ("ask_price1", T.DoubleType()),
    ("bid_price2", T.DoubleType()),
    ("ask_price2", T.DoubleType()),
    ("bid_size1", T.LongType()),
    ("ask_size1", T.LongType()),
    ("bid_size2", T.LongType()),
    ("ask_size2", T.LongType()),
)
BOOK_RAW = T.StructType([T.StructField(n, t) for n, t in BOOK_RAW_FIELDS])
BOOK_RAW_COLUMNS = [n for n, _ in BOOK_RAW_FIELDS]

BOOK_SEC = T.StructType([
    T.StructField("stock_id", T.IntegerType()),
    T.StructField("time_id", T.IntegerType()),
    T.StructField("seconds_in_bucket", T.IntegerType()),
    T.StructField("wap", T.DoubleType()),
    T.StructField("bid_ask_spread", T.DoubleType()),
    T.StructField("total_volume", T.DoubleType()),
    T.StructField("price_spread", T.DoubleType()),
    T.StructField("depth_imbalance", T.DoubleType()),
])

PREDICTIONS = T.StructType([
    T.StructField("stock_id", T.IntegerType()),
    T.StructField("time_id", T.IntegerType()),
    T.StructField("fold", T.IntegerType()),
    T.StructField("actual_rv", T.DoubleType()),
    T.StructField("predicted_rv", T.DoubleType()),
])

PREPROCESSED_REQUIRED = (
    "stock_id", "time_id", "seconds_in_bucket", "wap", "bid_ask_spread", "total_volume",
)
