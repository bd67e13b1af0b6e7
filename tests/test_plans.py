import numpy as np
import pandas as pd
import pytest

from voltide.plans import ordered, pairs


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value a third of them."""
    rng = np.random.default_rng(0)
    g = np.where(rng.random(3000) < 0.7, 1, rng.integers(2, 6, 3000))
    v = np.where(rng.random(3000) < 0.33, 0.5, rng.normal(size=3000).round(2))
    pdf = pd.DataFrame({"g": g.astype("int32"), "v": v, "id": np.arange(3000)})
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_global_index(spark, skewed):
    df, pdf = skewed
    out = ordered.with_global_index(df, ["g", "v", "id"]).toPandas().sort_values("idx")
    assert out.idx.tolist() == list(range(3000))
    assert out.id.tolist() == pdf.sort_values(["g", "v", "id"]).id.tolist()


def test_exact_quantiles(spark, skewed):
    df, pdf = skewed
    out = ordered.exact_quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.37, "c": 0.99, "d": 1.0}).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        assert out.loc[g].tolist() == pytest.approx(np.quantile(part.v, [0, 0.37, 0.99, 1]).tolist())
    total = ordered.exact_quantiles(df, [], "v", {"m": 0.5}).first().m
    assert total == pytest.approx(np.median(pdf.v))


def test_average_ranks(spark, skewed):
    df, pdf = skewed
    out = {(r.g, r.v): r["rank"] for r in ordered.average_ranks(df, ["g"], "v").collect()}
    want = pdf.groupby("g").v.rank()
    assert all(out[g, v] == w for g, v, w in zip(pdf.g, pdf.v, want))


def test_lag_by_index(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(5)], "k int, idx bigint, v double")
    out = {r.idx: r.v_prev for r in ordered.lag_by_index(df, ["k"], ["v"], 2).collect()}
    assert out == {0: None, 1: None, 2: 0.0, 3: 1.0, 4: 4.0}


@pytest.mark.parametrize("block,slices", [(256, None), (3, 4)])
def test_pair_correlations(spark, monkeypatch, block, slices):
    monkeypatch.setattr(pairs, "BLOCK_STOCKS", block)
    rng = np.random.default_rng(1)
    wide = pd.DataFrame(rng.normal(size=(60, 8))).mask(rng.random((60, 8)) < 0.2)
    wide[7] = 1.5
    long = wide.stack().rename("v").reset_index().set_axis(["t", "sid", "v"], axis=1).astype({"t": "int32", "sid": "int32"})
    df = spark.createDataFrame(long)
    sums = pairs.pair_sums(df, df, n_slices=slices).toPandas()
    assert len(sums) == 28 and sums.set_index(["stock_a", "stock_b"]).loc[(0, 1), "n"] == wide[[0, 1]].dropna().shape[0]
    out = pairs.pair_correlations(df).toPandas().set_index(["stock_a", "stock_b"])
    want = wide.corr()
    for (a, b), row in out.iterrows():
        if b == 7:
            assert pd.isna(row["corr"])
        else:
            assert row["corr"] == pytest.approx(want.loc[a, b])
