import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
CHECKED = ["naive_rv_scores_by_stock", "book_gap_fill", "wide_interval_features", "fold_assignment", "stock_har_out_of_fold",
           "diebold_mariano_statistics", "correlation_pairs", "clipped_histogram", "leaderboard_hit"]


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) or "" for v in row) for row in df.select(*cols).toPandas().astype(object).itertuples(index=False, name=None))
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(row[names.index(c)]) or "" for c in cols) for row in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["bucket_har_forecast", "stock_effect_scored"])
def test_every_fold_is_there_and_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF).toPandas().astype(object)
    assert sorted(df.fold.unique()) == [0, 1, 2, 3, 4]
    got = sorted(tuple(norm(v) or "" for v in row) for row in df.itertuples(index=False, name=None))
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(row[names.index(c)]) or "" for c in df.columns) for row in cur.fetchall())
    assert got == want
