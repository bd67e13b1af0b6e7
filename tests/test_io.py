import pytest
from pyspark.sql import functions as F

from voltide.operators.folds import distinct_snapshots, shuffle_splits
from voltide.session import cut_lineage, shared_folder
from voltide.sources import readers, writers


@pytest.fixture(scope="module")
def csv_book(tmp_path_factory):
    folder = tmp_path_factory.mktemp("book")
    head = "time_id,seconds_in_bucket,bid_price1,ask_price1,bid_price2,ask_price2,bid_size1,ask_size1,bid_size2,ask_size2,extra\n"
    for s in (3, 10, 21):
        (folder / f"stock_{s}.csv").write_text(head + "".join(f"{t},{k},1.0,1.1,0.9,1.2,{s},2,3,4,x\n" for t in range(10) for k in (0, 5)))
    (folder / "notes.csv").write_text("a,b\n1,2\n")
    return str(folder)


def test_raw_book_scan(spark, csv_book):
    raw = readers.read_raw_book(spark, csv_book)
    assert raw.columns[0] == "stock_id" and "extra" not in raw.columns and raw.count() == 60
    assert {r.stock_id for r in readers.limit_stocks(raw, 2).select("stock_id").distinct().collect()} == {3, 10}
    assert readers.limit_stocks(raw, None) is raw
    scanned = raw.select("time_id").distinct()._jdf.queryExecution().executedPlan().toString()
    assert "bid_price1" not in scanned.split("ReadSchema")[-1]  # column pruning reaches the scan


def test_folds_round_trip(spark, csv_book, tmp_path):
    book = readers.read_raw_book(spark, csv_book)
    a = shuffle_splits(distinct_snapshots(book))
    writers.write_folds(book, a, str(tmp_path))
    test = readers.read_fold(spark, f"{tmp_path}/folds", 1, "test")
    assert test.select("time_id").distinct().count() == 2 and test.count() == 12
    assert "PartitionFilters: [isnotnull(fold" in test._jdf.queryExecution().executedPlan().toString()
    assert readers.read_book_sec(spark, f"{tmp_path}/full").count() == 60


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("stock_7", 1, 0, 0.1, 0.2)], "stock_id string, time_id int, fold int, actual_rv double, predicted_rv double")
    writers.write_csv(df, f"{tmp_path}/p0.csv")
    back = readers.read_predictions(spark, [f"{tmp_path}/p0.csv", f"{tmp_path}/absent.csv"])
    assert back.first().stock_id == 7
    with pytest.raises(ValueError, match="no prediction files"):
        readers.read_predictions(spark, [f"{tmp_path}/absent.csv"])
    renamed = readers.rename_forecasts(df.withColumnRenamed("actual_rv", "true_rv"), 4, "true_rv", "predicted_rv")
    assert renamed.first().fold == 4
    writers.write_metrics(df, f"{tmp_path}/m.json")
    assert spark.read.json(f"{tmp_path}/m.json").first().fold == 0
    calls = []

    def build():
        calls.append(1)
        return df
    for _ in range(2):
        assert writers.materialise(spark, f"{tmp_path}/stage", build).count() == 1
    assert len(calls) == 1
    assert readers.read_table(spark, f"{tmp_path}/p0.csv", df.schema).count() == 1


def test_lineage_cut_uses_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    cut = cut_lineage(df)
    assert cut.count() == 10 and shared_folder(spark).split(":")[-1] in cut.inputFiles()[0]


def test_files_with_another_column_order_fail(spark, tmp_path):
    """Such a file must not be read by position."""
    from voltide import schemas

    names = list(schemas.BOOK_RAW_COLUMNS)
    other = [*names[:2], names[3], names[2], *names[4:]]
    folder = tmp_path / "orders"
    folder.mkdir()
    for i, header in enumerate((names, other)):
        (folder / f"stock_{i}.csv").write_text(",".join(header) + "\n" + ",".join("1" for _ in header) + "\n")
    with pytest.raises(Exception):
        readers.read_raw_book(spark, str(folder)).collect()


def test_trees_round_trip(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(float(i), float(i > 5)) for i in range(12)], "x double, y double"))
    trees = [DecisionTreeRegressor(labelCol="y", maxDepth=d).fit(rows) for d in (1, 2)]
    writers.save_trees(trees, f"{tmp_path}/trees")
    back = writers.load_trees(f"{tmp_path}/trees", 2)
    assert [t.toDebugString.split("\n", 1)[1] for t in back] == [t.toDebugString.split("\n", 1)[1] for t in trees]


def test_tensor_round_trip(spark, tmp_path):
    tensor = spark.createDataFrame([(1, 2, [[0.5, 1.5], [2.5, 3.5]], 0.25)], "time_id int, stock_id int, x array<array<float>>, y float")
    writers.write_tensor(tensor, f"{tmp_path}/tensor")
    assert readers.read_table(spark, f"{tmp_path}/tensor").collect() == tensor.collect()


def test_a_written_table_leaves_no_shuffle_files(spark):
    import time
    from pathlib import Path

    from voltide.session import SHUFFLE_CLEANUP, cut_lineage

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    there = lambda: {p.name for d in manager.localDirsString() for p in Path(d).rglob("shuffle_*.data")}
    before = there()
    table = cut_lineage(spark.range(100_000).repartition(4, "id"))
    for _ in range(50):
        if not there() - before:
            break
        time.sleep(0.1)
    assert not there() - before and spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert table.count() == 100_000
