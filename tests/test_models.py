import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltide.functions import columns as vc
from voltide.functions import distributions as dist
from voltide.operators import boost, folds, garch, har_models, ols, scoring
from voltide.workload import model_queries


def test_ols_matches_lstsq_and_leave_one_out(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["a", "b", "c"])
    pdf["y"] = 1 + pdf.a * 2 - pdf.b + rng.normal(size=200) * 0.1
    pdf["k"], pdf["part"] = 0, np.arange(200) % 4
    df = spark.createDataFrame(pdf)
    xs = ["a", "b", "c"]
    x = np.column_stack([np.ones(200), pdf[xs]])
    beta, rss, *_ = np.linalg.lstsq(x, pdf.y, rcond=None)
    got = ols.fit(df, ["k"], xs, "y").first()
    assert [got.b_0, got.b_1, got.b_2, got.b_3] == pytest.approx(beta.tolist()) and got.rss == pytest.approx(rss[0])
    loo = ols.solve(ols.leave_part_out(ols.cross_sums(df, ["k", "part"], xs, "y"), ["k"], "part", 3), ["k", "part"], 3)
    for r in loo.collect():
        keep = pdf.part != r.part
        want = np.linalg.lstsq(x[keep], pdf.y[keep], rcond=None)[0]
        assert [r.b_0, r.b_1, r.b_2, r.b_3] == pytest.approx(want.tolist())
    table = ols.coefficient_table(ols.fit(df, ["k"], xs, "y"), ["k"], xs).orderBy("position").toPandas()
    assert table.feature.tolist() == ["intercept", "a", "b", "c"]


def test_collinear_regressor_keeps_fitted_values(spark):
    pdf = pd.DataFrame({"k": 0, "a": [1.0, 2, 3, 5], "b": [2.0, 1, 4, 3]})
    pdf["c"] = pdf.b - pdf.a
    pdf["y"] = [1.0, 3, 2, 6]
    df = spark.createDataFrame(pdf)
    out = ols.predict(df, ols.fit(df, ["k"], ["a", "b", "c"], "y"), ["k"], ["a", "b", "c"], "p").orderBy("a").toPandas()
    x = np.column_stack([np.ones(4), pdf[["a", "b", "c"]]])
    assert out.p.tolist() == pytest.approx((x @ np.linalg.lstsq(x, pdf.y, rcond=None)[0]).tolist())


def test_splits(spark):
    snaps = spark.range(23).select(F.col("id").cast("int").alias("time_id"))
    a = folds.shuffle_splits(snaps).toPandas()
    assert (a[a.split == "test"].groupby("fold").size() == 5).all() and len(a) == 115
    assert folds.overlap_check(folds.shuffle_splits(snaps)).count() == 0
    inner = a[a.split == "train"].groupby(["fold", "inner"]).size()
    assert inner.max() - inner.min() <= 1
    with pytest.raises(ValueError, match="missing fold sides"):
        folds.require_folds(folds.shuffle_splits(snaps), [0, 9])
    rows = spark.range(23).select((F.col("id") % 7).cast("int").alias("stock_id"), F.col("id").cast("int").alias("time_id"))
    parts = folds.kfold_parts(rows, 5).groupBy("part").count().toPandas().set_index("part")["count"]
    assert parts.sort_index().tolist() == [len(p) for p in np.array_split(np.arange(23), 5)]
    by_stock = folds.kfold_parts(rows, 5, by_stock=True)
    assert by_stock.groupBy("stock_id").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    assert folds.holdout_split(rows).where("split = 'test'").count() == round(23 * 0.2)


def test_stock_out_of_fold_is_a_refit(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"stock_id": 4, "time_id": np.arange(40), "log_rv_in": rng.normal(size=40), "log_rv_last_window": rng.normal(size=40)})
    pdf["log_rv_fut"] = pdf.log_rv_in * 0.5 + rng.normal(size=40) * 0.2
    few = pdf[:8].assign(stock_id=9)
    df = spark.createDataFrame(pd.concat([pdf, few]))
    assignment = folds.shuffle_splits(folds.distinct_snapshots(df))
    a = assignment.toPandas()
    out = har_models.stock_har_oof(df, assignment).toPandas()
    assert set(out.stock_id) == {4}  # the short stock has fewer than ten training rows
    f0 = a[a.fold == 0].set_index("time_id").loc[pdf.time_id]
    x = np.column_stack([np.ones(40), pdf[["log_rv_in", "log_rv_last_window"]]])
    got = out[out.fold == 0].set_index("time_id").har_pred_log_rv
    for part in (-1, 2):
        fit_on = (f0.inner.to_numpy() >= 0) & (f0.inner.to_numpy() != part)
        score = f0.inner.to_numpy() == part
        beta = np.linalg.lstsq(x[fit_on], pdf.log_rv_fut[fit_on], rcond=None)[0]
        assert got.loc[pdf.time_id[score]].tolist() == pytest.approx((x[score] @ beta).tolist())


def test_garch_recovers_parameters_and_falls_back(spark):
    rng = np.random.default_rng(2)
    omega, alpha, beta, n = 0.02, 0.1, 0.85, 4000
    y, var = np.zeros(n), omega / 0.05
    for t in range(n):
        y[t] = np.sqrt(var) * rng.normal()
        var = omega + alpha * y[t] ** 2 + beta * var
    total, ok, converged, nll = garch.fit_batch(y[None, :], np.array([n]))
    grid = garch.fit_batch(y[None, :], np.array([n]), 0)
    assert converged[0] and nll[0] < grid[3][0] and not grid[2][0]        # refinement never has a worse likelihood
    want, v = 0.0, var
    for _ in range(garch.HORIZON):
        want += v
        v = omega + (alpha + beta) * v
    assert ok[0] and total[0] == pytest.approx(want, rel=0.15)
    rows = [(1, 1, s, 100.0) for s in range(600)] + [(1, 2, s, 100.0 * float(np.exp(0.001 * np.sin(s * 1.7)))) for s in range(600)]
    rows += [(1, 3, s, 100.0) for s in range(3)]
    df = spark.createDataFrame(rows, "stock_id int, time_id int, seconds_in_bucket int, wap double")
    out = garch.garch_predictions(df).toPandas().set_index("time_id")
    assert sorted(out.index) == [1, 2]  # snapshot 3 has too few rows
    assert out.loc[1, "fallback"] == 1 and out.loc[1, "true_rv"] == 1e-4 and out.loc[2, "fallback"] == 0
    assert out.loc[2, "n_input_obs"] == 480 and out.loc[2, "n_future_obs"] == 120 and out.loc[2, "pred_rv"] > 0


def test_distribution_tails():
    assert 2 * dist.normal_sf(1.959963984540054) == pytest.approx(0.05)
    assert dist.t_quantile(0.975, 4) == pytest.approx(2.7764451051977987)
    assert dist.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert dist.binomial_sf(2, 3, 0.5) == pytest.approx(0.5) and dist.binomial_sf(0, 3, 0.5) == 1.0


def test_spread_weights_bias_and_blend(spark):
    pdf = pd.DataFrame({"stock_id": [1] * 4 + [2] * 2, "true_log_rv": [-5.0, -6, -7, -4, -5, -6], "pred_log_rv": [-5.5, -5.7, -6, -5, -5, -5]})
    df = spark.createDataFrame(pdf)
    w = scoring.spread_weights(df).toPandas().set_index("stock_id").spread_weight
    one = np.clip(2 - pdf.pred_log_rv[:4].std(ddof=0) / pdf.true_log_rv[:4].std(ddof=0), 0.25, 4)
    assert w[1] == pytest.approx(one / ((one + 1) / 2)) and w.mean() == pytest.approx(1.0)
    fixed = scoring.apply_stock_bias(df, scoring.stock_bias(df)).groupBy("stock_id").agg(F.avg(F.col("true_log_rv") - F.col("pred_log_rv")).alias("m"))
    assert all(abs(r.m) < 1e-12 for r in fixed.collect())
    rows = df.withColumn("a", F.col("true_log_rv")).withColumn("b", F.col("pred_log_rv"))
    assert scoring.best_blend(scoring.blend_weight_grid(rows, "a", "b")).first().weight == 1.0
    assert scoring.least_squares_blend(rows, "a", "b").first().weight == 1.0


def test_booster_improves_on_its_anchor(spark):
    rng = np.random.default_rng(4)
    n = 600
    x = rng.normal(size=(n, 2))
    pdf = pd.DataFrame({"stock_id": np.arange(n) % 5, "time_id": np.arange(n), "x0": x[:, 0], "x1": x[:, 1],
                        "har_pred_log_rv": -6.0, "har_residual": 0.5 * np.sign(x[:, 0]) + rng.normal(size=n) * 0.05})
    rows = boost.assemble(spark.createDataFrame(pdf), ["x0", "x1"])
    params = boost.BoostParams(rounds=5, learning_rate=0.5, max_depth=2, min_rows=5, checkpoint_every=3)
    trees, score = boost.fit_booster(rows, params)
    start = boost._score(rows.withColumn("margin", F.lit(0.0)))
    assert trees and score < 0.3 * start
    imp = boost.permutation_importance(rows, trees, 0.5, ["x0", "x1"]).toPandas()
    assert imp.feature.tolist() == ["x0", "x1"] and imp.delta_qlike[0] > 10 * abs(imp.delta_qlike[1])
    assert boost.split_importance(trees, spark, ["x0", "x1"]).first().feature == "x0"


def test_early_stopping_decides_in_the_registered_booster(spark):
    """Nothing to learn: the fit ends by patience, long before the round limit, and the best round is kept."""
    assert model_queries.BOOST.rounds > 10 * model_queries.BOOST.patience and model_queries.TRIALS == 10
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"stock_id": np.arange(n) % 5, "time_id": np.arange(n), "x0": rng.normal(size=n), "inner": np.arange(n) % 2,
                        "har_pred_log_rv": -6.0, "har_residual": rng.normal(size=n) * 0.5})
    rows = boost.assemble(spark.createDataFrame(pdf), ["x0"])
    fitted = []
    real = boost.DecisionTreeRegressor
    try:
        boost.DecisionTreeRegressor = lambda **kw: fitted.append(1) or real(**kw)
        params = boost.BoostParams(rounds=200, learning_rate=0.9, max_depth=5, min_rows=2, patience=4, checkpoint_every=3)
        trees, best = boost.fit_booster(rows, params)
    finally:
        boost.DecisionTreeRegressor = real
    assert len(fitted) == len(trees) + 4 < 200
    held = rows.where(vc.mixed_hash(folds.row_key(), params.seed) % 1000 < 100)
    assert boost._score(boost.add_margin(held, trees, 0.9, "margin")) == pytest.approx(best, rel=1e-9)


def test_garch_fits_a_bounded_number_of_rows_at_once(spark, monkeypatch):
    """An Arrow batch may hold 10,000 snapshots; the arrays of a fit do not grow with it."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n = 1300
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([rng.normal(0, 1e-3, 30).tolist() if i % 9 else [0.0] * 7 for i in range(n)])], ["time_id", "inp"])
    sizes, fit = [], garch.fit_batch
    monkeypatch.setattr(garch, "fit_batch", lambda y, lengths, steps: sizes.append(len(y)) or fit(y, lengths, steps))
    out = pa.Table.from_batches(list(garch._forecasts(0, ["time_id"])(iter([batch])))).to_pandas()
    assert max(sizes) <= garch.FIT_ROWS < n and out.time_id.tolist() == list(range(n))
    assert out.garch_rv.isna().tolist() == [i % 9 == 0 for i in range(n)]
