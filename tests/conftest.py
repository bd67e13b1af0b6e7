import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from voltide.session import build_session, drop_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_tables(session)
    session.stop()


@pytest.fixture(scope="session")
def dense(spark):
    """A small random dense book: 4 stocks x 12 snapshots x 600 seconds, and its pandas twin."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    frames = []
    for t in range(12):
        common = rng.normal(0, 2e-4, 600) * np.exp(rng.normal())
        for s in range(4):
            r = common * 0.6 + rng.normal(0, 1e-4, 600) * np.exp(rng.normal())
            frames.append(pd.DataFrame({
                "stock_id": s, "time_id": 5 + 3 * t, "seconds_in_bucket": np.arange(600), "wap": 10 * np.exp(np.cumsum(r)),
                "bid_ask_spread": rng.uniform(1e-4, 9e-4, 600), "total_volume": rng.integers(1, 500, 600).astype(float),
                "price_spread": rng.uniform(1e-3, 9e-3, 600), "depth_imbalance": rng.uniform(-1, 1, 600)}))
    pdf = pd.concat(frames, ignore_index=True).astype({"stock_id": "int32", "time_id": "int32", "seconds_in_bucket": "int32"})
    return spark.createDataFrame(pdf).repartition(4).cache(), pdf
