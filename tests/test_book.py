import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voltide.functions import columns as vc
from voltide.operators import book, eda, garch, har, har_models, rv
from voltide.schemas import BOOK_RAW

RAW = "stock_id int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BOOK_RAW)


def quote(t, s, bp1=99.0, ap1=101.0, bp2=98.0, ap2=102.0, bs1=1, as1=3, bs2=5, as2=7, stock=1):
    return (stock, t, s, bp1, ap1, bp2, ap2, bs1, as1, bs2, as2)


def test_level1_and_best_level_prices(spark):
    raw = spark.createDataFrame([quote(1, 0), quote(1, 1, bp2=99.5), quote(1, 2, bs1=0, as1=0), quote(1, 3, ap1=None)], RAW)
    one = {r.seconds_in_bucket: r for r in book.with_book_columns(raw).collect()}
    best = {r.seconds_in_bucket: r for r in book.with_book_columns(raw, "best").collect()}
    assert one[0].wap == pytest.approx((99 * 3 + 101 * 1) / 4)
    assert best[0].wap == one[0].wap
    assert best[1].wap == pytest.approx((99.5 * 3 + 101 * 5) / 8)  # size follows the better price
    assert one[2].wap is None and best[2].volume_imbalance is None
    assert one[3].bid_ask_spread is None  # a missing side gives no spread
    assert one[3].price_spread == pytest.approx(102 - 98)  # but the price range skips it
    assert one[0].bid_ask_spread == pytest.approx(101 / 99 - 1)
    assert one[0].total_volume == 16 and one[0].depth_imbalance == pytest.approx((6 - 10) / 16)


def test_gap_fill_start_middle_end(spark):
    df = spark.createDataFrame([(1, 1, 2, 10.0), (1, 1, 5, 20.0), (1, 1, 700, 99.0), (1, 2, 0, None), (1, 2, 3, 7.0)],
                               "stock_id int, time_id int, seconds_in_bucket int, wap double")
    out = book.fill_seconds(df, ["wap"])
    rows = {(r.time_id, r.seconds_in_bucket): r.wap for r in out.collect()}
    assert len(rows) == 1200
    assert [rows[1, s] for s in range(8)] == [10, 10, 10, 10, 10, 20, 20, 20] and rows[1, 599] == 20
    assert rows[2, 0] == 7.0 and rows[2, 599] == 7.0  # a missing value in an observed row is filled too


def test_last_quote_per_second(spark):
    df = spark.createDataFrame([(1, 1, 0, 5, 1.0), (1, 1, 0, 9, 2.0), (1, 1, 0, 7, 3.0)],
                               "stock_id int, time_id int, seconds_in_bucket int, id bigint, v double")
    assert [r.v for r in book.last_quote_per_second(df, "id", ["v"]).collect()] == [2.0]


def test_edge_return_rule(spark):
    df = spark.createDataFrame([(1, 1, s, 100.0 if s < 480 else 110.0) for s in range(600)],
                               "stock_id int, time_id int, seconds_in_bucket int, wap double")
    win = [("t", 480, 600)]
    assert rv.realised_vol(df, win).first().t == pytest.approx(math.log(1.1))
    assert rv.realised_vol(df, win, edge="exclude").first().t == 0.0
    assert rv.realised_vol(df, win, clip=0.05).first().t == pytest.approx(0.05)


def test_bucket_rvs_add_up(spark, dense):
    df, pdf = dense
    out = rv.realised_vol(df, [("full", None, None), *rv.BUCKETS_120], first=0.0).collect()
    for r in out:
        assert sum(r[n] ** 2 for n, _, _ in rv.BUCKETS_120) == pytest.approx(r.full ** 2)


def test_stock_numbers(spark):
    df = spark.createDataFrame([("stock_17",), ("8",)], "s string")
    assert sorted(r[0] for r in df.select(vc.stock_number("s")).collect()) == [8, 17]
    with pytest.raises(PySparkException, match="does not end in an integer"):
        spark.createDataFrame([("abc",)], "s string").select(vc.stock_number("s")).collect()


def test_regime_and_tier_bounds(spark):
    df = spark.createDataFrame([(0.0009,), (0.001,), (0.005,), (0.02,), (None,)], "rv double")
    assert [r[0] for r in df.select(vc.regime_label("rv")).collect()] == ["calm", "normal", "elevated", "stressed", "stressed"]


def test_preprocessed_inputs(spark, dense):
    df, _ = dense
    with pytest.raises(ValueError, match="missing required"):
        book.normalise_preprocessed(df.drop("wap"))
    bare = book.normalise_preprocessed(df.drop("depth_imbalance").withColumn("stock_id", F.concat(F.lit("stock_"), "stock_id")))
    row = bare.first()
    assert row.volume_imbalance == 0.0 and isinstance(row.stock_id, int)


def test_har_features_and_filter(spark, dense):
    df, pdf = dense
    out = har.features_from_preprocessed(df).toPandas().set_index(["stock_id", "time_id"])
    import numpy as np
    for key, g in pdf.groupby(["stock_id", "time_id"]):
        g = g.sort_values("seconds_in_bucket")
        lr = np.log(g.wap).diff().to_numpy()
        assert out.loc[key, "rv_360_480"] == pytest.approx(np.sqrt((lr[360:480] ** 2).sum()))
        assert out.loc[key, "target_rv_480_600"] == pytest.approx(np.sqrt((lr[480:] ** 2).sum()))
        assert out.loc[key, "volume_imbalance_mean_0_480"] == pytest.approx(g.depth_imbalance[:480].mean())
    rows = har.add_model_columns(har.features_from_preprocessed(df))
    report = har.target_filter_report(rows, 1e9).first()
    assert report.kept_rows == 0 and report.dropped_rows == len(out)
    with pytest.raises(ValueError):
        har.require_rows(har.drop_small_targets(rows, 1e9))


def test_tensor_shapes(spark, dense):
    df, _ = dense
    t = rv.bucket_tensor(df.where("NOT (stock_id = 3 AND time_id = 5)"))
    full = rv.dense_tensor(t)
    assert full.count() == 48 and t.count() == 47
    gap = full.where("stock_id = 3 AND time_id = 5").first()
    assert len(gap.x) == 8 and all(len(b) == 7 and not any(b) for b in gap.x) and gap.y == 0.0
    w = rv.sampling_weights(rv.log_target_rv(df)).toPandas()
    assert w.weight.sum() == pytest.approx(1.0) and (w.weight > 0).all()


@pytest.fixture(scope="module")
def runs_and_seconds(spark):
    """Quotes of uneven gaps, some without price or spread, one snapshot of a single quote and one without prices; as runs and by the second."""
    rng = np.random.default_rng(8)
    frames = []
    for t, n in enumerate([1, 2, 5, 40, 300, 600, 12]):
        price = np.where(rng.random(n) < 0.1, None, 1 + rng.normal(0, 0.02, n)) if t < 6 else np.full(n, None)
        spread = np.where(rng.random(n) < 0.1, None, rng.uniform(1e-4, 9e-4, n))
        frames.append(pd.DataFrame({
            "stock_id": t % 2, "time_id": t, "seconds_in_bucket": np.sort(rng.permutation(600)[:n]), "wap": price, "bid_ask_spread": spread,
            "total_volume": rng.integers(1, 500, n).astype(float), "price_spread": rng.uniform(1e-3, 9e-3, n), "depth_imbalance": 0.25}))
    schema = "stock_id int, time_id int, seconds_in_bucket int, " + ", ".join(f"{c} double" for c in book.DERIVED)
    rows = [tuple(None if c is None or c != c else c for c in r) for r in pd.concat(frames).astype(object).itertuples(index=False)]
    quotes = spark.createDataFrame(rows, schema).repartition(4)
    return book.fill_runs(quotes).cache(), book.fill_seconds(quotes).cache()


def same(a, b):
    if isinstance(a, (list, tuple)):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            same(x, y)
    else:
        assert a == (b if b is None or isinstance(b, str) else pytest.approx(b, rel=1e-9, abs=1e-12))


WINDOWS = [("a", None, None), ("b", 0, 480), ("c", 480, None), ("d", 100, 250)]
FEATURES = [c for c in book.DERIVED]


@pytest.mark.parametrize("table, keys", [
    (lambda d: rv.realised_vol(d, WINDOWS), 2), (lambda d: rv.realised_vol(d, WINDOWS, first=0.0, clip=0.01), 2),
    (lambda d: rv.realised_vol(d, WINDOWS, edge="exclude"), 2), (rv.target_rv_panel, 2), (rv.bucket_features, 3),
    (lambda d: rv.bucket_features(d, 50, 9), 3), (lambda d: rv.bucket_tensor(d).select("stock_id", "time_id", "x", "y"), 2),
    (har.features_from_preprocessed, 2), (har_models.stock_har_windows, 2), (garch.garch_inputs, 2),
    (lambda d: garch.garch_predictions(d, solver=False), 2), (lambda d: eda.input_window_samples(d, FEATURES), 2),
    (lambda d: eda.second_profile(d, FEATURES), 1)])
def test_runs_give_what_their_seconds_give(runs_and_seconds, table, keys):
    got, want = [sorted(map(tuple, table(d).collect()), key=lambda r: r[:keys]) for d in runs_and_seconds]
    assert want
    same(got, want)


def test_samples_of_seconds_are_plain_moments(runs_and_seconds):
    runs, seconds = runs_and_seconds
    want = seconds.where("seconds_in_bucket < 480").groupBy("stock_id", "time_id").agg(
        F.avg("wap"), F.stddev_samp("wap"), F.avg("bid_ask_spread"), F.stddev_samp("bid_ask_spread"), F.avg("depth_imbalance"), F.stddev_samp("depth_imbalance"))
    got = eda.input_window_samples(runs, ["wap", "bid_ask_spread", "depth_imbalance"]).drop("log_rv_input")
    same(*[sorted(map(tuple, d.collect()), key=lambda r: r[:2]) for d in (got, want)])


@pytest.mark.parametrize("name", ["bucket_tensor", "scaled_rv_baseline", "input_window_samples", "second_profile", "rv_windows_edge_excluded", "har_features_dense"])
def test_returns_are_taken_before_runs_are_cut(spark, name):
    """A window above the cut would sort 600 rows a snapshot in a task."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, cut, _ = plan.partition("Generate explode(sequence(")
    assert cut and "Window" not in above
