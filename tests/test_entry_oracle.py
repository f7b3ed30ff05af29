"""Registered queries against their DuckDB oracle on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as se
from tabprobe.sources.tables import TABLES

from conftest import SF_SMALL

def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5)
        return v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_contract(spark):
    q, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(q)
    df = se.entry(spark)
    assert df.count() > 0 and df.columns == ["col", "pos", "association"]


@pytest.mark.parametrize("name", sorted(set(se.oracle_sql())))
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF_SMALL)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    cur = con.execute(se.oracle_sql()[name])
    orows, ocols = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    assert _canon(rows, cols) == _canon(orows, ocols)


@pytest.mark.parametrize("name,column", [("panel_scores", "value"), ("leaderboard", "score")])
def test_query_without_oracle_scores_every_pair(spark, name, column):
    rows = se.queries()[name](spark, SF_SMALL).collect()
    assert len(rows) == (3 if name == "panel_scores" else 2)
    assert all(0.0 <= r[column] <= 1.0 for r in rows)


@pytest.mark.parametrize("name", ["split_stratified", "spearman_cols", "eta_cols", "ordinal_encode",
                                  "auc_binary", "knn_topk", "overview", "corpus_dedupe"])
def test_invariant_under_shuffle_partitions(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = se.queries()[name](spark, SF_SMALL)
            results.append(_canon([tuple(r) for r in df.collect()], df.columns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] == results[2]
