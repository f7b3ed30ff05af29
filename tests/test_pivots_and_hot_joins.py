"""kNN by pivots, and ranks that return to hot values."""
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabprobe.operators import knn
from tabprobe.operators.association import eta_ranks, spearman_abs
from tabprobe.operators.knn import knn_neighbors
from tabprobe.operators.rank import join_hot


def brute(train, test, k):
    return {q: [i for _, i in sorted((math.dist(v, t), i) for i, t in train)[:k]] for q, v in test}


def searched(spark, train, test, k, block_rows, log=None):
    dims = len(train[0][1])
    names = [f"x{i}" for i in range(dims)]
    schema = "id long, " + ", ".join(f"{n} double" for n in names)
    frames = [spark.createDataFrame([(i, *map(float, v)) for i, v in side], schema) for side in (train, test)]
    out = {}
    for r in knn_neighbors(*frames, names, "id", "id", k=k, block_rows=block_rows, broadcast_bytes=0, log=log) \
            .orderBy("qid", "nn_rank").collect():
        out.setdefault(r.qid, []).append(r.rid)
    return out


def clustered(n, dims, centres, seed):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(size=(centres, dims)) * 50
    return [(i, v) for i, v in enumerate(middle[rng.integers(centres, size=n)] + rng.normal(size=(n, dims)))]


@pytest.mark.parametrize("dims,centres", [(2, 12), (8, 6)])
def test_pivots_visit_few_units(spark, dims, centres):
    train, test = clustered(3000, dims, centres, 1), clustered(400, dims, centres, 2)
    log = {}
    assert searched(spark, train, test, 5, 100, log) == brute(train, test, 5)
    blocks = math.ceil(len(train) / 100)
    all_pairs = math.ceil(len(test) / 100) * len(train) + blocks * len(test)
    assert log["train_copies"] + log["test_copies"] < all_pairs // 2
    assert log["test_copies"] < blocks * len(test) // 4


def test_pivots_with_equal_vectors_ties_and_few_rows(spark):
    rng = random.Random(3)
    train = [(i, (0.5, 0.5)) for i in range(400)] + [(1000 + i, (rng.random(), 1.0)) for i in range(500)] + \
        [(2000 + i, (float(i % 5), 0.0)) for i in range(100)]
    test = [(i, (0.5, 0.5)) for i in range(150)] + [(500 + i, (rng.random(), rng.random())) for i in range(50)]
    log = {}
    assert searched(spark, train, test, 7, 50, log) == brute(train, test, 7)
    few = train[:2] + train[600:601]
    assert searched(spark, few, test[:5], 7, 1) == brute(few, test[:5], 7)


def test_hot_keys_stay_where_they_are(spark):
    """A key of a third of all rows: no task after the join holds twice the median."""
    n = 60_000
    big = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5003).alias("k"), "id").checkpoint()
    table = big.groupBy("k").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("top")).checkpoint()
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = join_hot(big, table, ["k"], "rows", hot_rows=1000, small_rows=0)
        sizes = [r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * statistics.median(sizes)
        plain = [r["count"] for r in big.join(table, "k").groupBy(F.spark_partition_id()).count().collect()]
        assert max(plain) > 2 * statistics.median(plain)
        got = {(r.k, r.id, r.top) for r in j.collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert got == {(r.k, r.id, r.top) for r in big.join(table, "k").select("k", "id", "top").collect()}


def test_associations_are_the_same_with_hot_joins(spark):
    rng = random.Random(8)
    rows = [(float(i % 3 and rng.random()), None if i % 7 == 0 else float(rng.randrange(9)),
             1.5 if i % 3 == 1 else rng.random(), f"c{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, y double, c string")
    hot = dict(hot_rows=20, small_rows=0)
    for fn, target in ((spearman_abs, "y"), (eta_ranks, "c")):
        want = {r.col: r.association for r in fn(df, ["a", "b"], target).collect()}
        got = {r.col: r.association for r in fn(df, ["a", "b"], target, **hot).collect()}
        assert got == {c: pytest.approx(v, rel=1e-9) for c, v in want.items()}


@pytest.mark.parametrize("slab_rows", [1 << 16, 300])
def test_pivots_copy_few_rows_where_no_bound_helps(spark, monkeypatch, slab_rows):
    """Many features without clusters: a test row goes to each slab once, not to each unit."""
    monkeypatch.setattr(knn, "SLAB_ROWS", slab_rows)
    rng = np.random.default_rng(5)
    train, test = [[(i, v) for i, v in enumerate(rng.normal(size=(n, 24)))] for n in (2000, 150)]
    log = {}
    assert searched(spark, train, test, 6, 20, log) == brute(train, test, 6)
    assert log["slabs"] <= 2 * math.ceil(2000 / slab_rows)
    assert log["test_copies"] <= log["slabs"] * len(test)
    assert log["train_copies"] <= 2 * len(train)


def test_many_pairs_go_by_pivots(spark, monkeypatch):
    train, test = clustered(600, 3, 5, 1), clustered(80, 3, 5, 2)
    schema = "id long, a double, b double, c double"
    frames = [spark.createDataFrame([(i, *map(float, v)) for i, v in side], schema) for side in (train, test)]
    got = []
    for pairs in (knn.STREAM_PAIRS, 1000):
        monkeypatch.setattr(knn, "STREAM_PAIRS", pairs)
        log = {}
        got.append(sorted(knn_neighbors(*frames, ["a", "b", "c"], "id", "id", k=4, log=log).collect()))
        assert bool(log) == (pairs == 1000)
    assert got[0] == got[1]


def test_pivots_with_missing_values(spark):
    """A ring with a missing value is left out, the others are still searched."""
    train, test = clustered(600, 2, 6, 1), clustered(60, 2, 6, 2)
    got = searched(spark, train + [(9000, (float("nan"), 0.0))], test + [(9001, (float("nan"), 1.0))], 4, 20)
    want = brute(train, test, 4)
    assert 9001 not in got and all(9000 not in ids for ids in got.values())
    assert sum(got.get(q) == ids for q, ids in want.items()) > len(want) // 2
