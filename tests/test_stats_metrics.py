import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tabprobe.operators import association as A
from tabprobe.operators.knn import knn_neighbors
from tabprobe.operators.metrics import auc_frame, regression_scores


def test_spearman_monotone_constant_and_small(spark):
    rows = [(float(i), float(i) ** 3, 1.0, float(i % 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, y double, k double, z double")
    got = {r.col: r.association for r in A.spearman_abs(df, ["x", "k"], "y").collect()}
    assert got["x"] == pytest.approx(1.0) and got["k"] == 0.0
    tiny = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    assert A.spearman_abs(tiny, ["x"], "y").first().association == 0.0


def test_eta_separates_classes(spark):
    rows = [(float(i), "a" if i < 25 else "b") for i in range(50)]
    df = spark.createDataFrame(rows, "x double, c string")
    eta = A.eta_ranks(df, ["x"], "c").first().association
    assert 0.85 < eta <= 1.0


def test_cap_keeps_strong_column(spark):
    rng = random.Random(0)
    rows = []
    for _ in range(200):
        c = [rng.gauss(0, 1) for _ in range(10)]
        rows.append(tuple(c) + (2 * c[0] + rng.gauss(0, 0.01),))
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(10)) + ", y double")
    kept = A.cap_columns(df, [f"c{i}" for i in range(10)], "y", "regression", 3)
    assert "c0" in kept and len(kept) == 3
    assert A.cap_columns(df, ["c0", "c1"], "y", "regression", 3) == ["c0", "c1"]


def test_auc_ties_match_pairwise(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 5))) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = auc_frame(df, F.col("y") == 1, F.col("s")).first().auc
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    ref = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    assert got == pytest.approx(ref / (len(pos) * len(neg)))


def test_r2_mae(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    r = regression_scores(df, F.col("y"), F.col("p")).first()
    assert r.r2 == pytest.approx(1 - 0.5 / 2.0) and r.mae == pytest.approx(1 / 3)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_knn_equals_brute_force(spark, broadcast_bytes):
    rng = random.Random(5)
    tr = [(i, rng.random(), rng.random()) for i in range(120)] + [(200 + i, 0.5, 0.5) for i in range(9)]
    te = [(1000 + i, rng.random(), rng.random()) for i in range(30)] + [(2000, 0.5, 0.5)]
    trd = spark.createDataFrame(tr, "id long, a double, b double")
    ted = spark.createDataFrame(te, "id long, a double, b double")
    got = knn_neighbors(trd, ted, ["a", "b"], "id", "id", k=5, block_rows=16, broadcast_bytes=broadcast_bytes)
    want = [(q, rank, i) for q, qa, qb in te for rank, (_, i) in
            enumerate(sorted((math.dist((qa, qb), (a, b)), i) for i, a, b in tr)[:5], 1)]
    assert sorted((r.qid, r.nn_rank, r.rid) for r in got.collect()) == want
    none = knn_neighbors(trd.limit(0), ted, ["a", "b"], "id", "id", broadcast_bytes=broadcast_bytes)
    assert none.columns == got.columns and none.count() == 0
