import hashlib
import math

import numpy as np
import pytest

from llm.rows import SF
from tabprobe.llm import queries, va_file

SCHEMA = "vec_id bigint, embedding array<float>, label int, distance string, ints int"


def expected(rows, k=16, rounds=3, dims=64):
    """Plain k-means on Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c
                     for j, c in enumerate(centroids)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, c, d in out:
        inertia[c] = inertia.get(c, 0) + d
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()),
                   hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out)


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)
                  for r in df.collect())


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(queries.op12_va_file(spark, SF)) == expected(rows)


def odd_rows():
    rng = np.random.default_rng(5)
    good = [(int(i), [float(x) for x in rng.normal(size=64).astype(np.float32)]) for i in range(60)]
    tie = [0.0] * 64
    return good + good[:10] + [(100 + i, tie) for i in range(30)] + [
        (None, tie), (None, good[0][1]), (200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65),
        (204, [float("nan")] + tie[1:]), (205, [float("inf")] + tie[1:]), (206, [None] + tie[1:]),
        (207, [-1000.0] + tie[1:]), (208, [1000.0] + tie[1:])]


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_vectors(spark, parts):
    """Missing, short, long and non-finite vectors go; ties, copies, outliers and
    clashing column names don't matter."""
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in rows], SCHEMA).repartition(parts)
    assert got(va_file.digest(va_file.cluster(df))) == expected(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = odd_rows()[:5]
    df = spark.createDataFrame([(i, v, 0, "x", 3) for i, v in rows], SCHEMA)
    assert got(va_file.digest(va_file.cluster(df))) == expected(rows)
    assert va_file.digest(va_file.cluster(df.limit(0))).collect() == []


def test_bounds_hold_and_settle_most(spark):
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(3000, 64)) * 8).astype(np.int64)
    cells = va_file.Cells(x[:500], x.min(axis=0), x.max(axis=0))
    codes, centroids = cells.of(x), x[:16]
    near, far = (sum(t[d][codes[:, d]] for d in range(64)) for t in cells.bounds(centroids))
    d = va_file.distances(x, centroids)
    assert (near <= d).all() and (d <= far).all()
    nearest = va_file.Nearest(cells, centroids)
    assert (nearest.of(codes, lambda rows: x[rows]) == d.argmin(axis=1)).all()
    assert nearest.fetched < len(x) // 20
    coarse = va_file.Cells(x[:500] // 100 * 100, x.min(axis=0), x.max(axis=0))  # bounds that settle little
    nearest = va_file.Nearest(coarse, centroids)
    assert (nearest.of(coarse.of(x), lambda rows: x[rows]) == d.argmin(axis=1)).all()


def test_rounds_fetch_only_what_moved_or_is_open(spark):
    log = []
    va_file.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"), log=log)
    assert log[0]["moved"] == log[0]["rows"]
    assert all(r["moved"] < r["rows"] // 2 and r["unsettled"] < r["rows"] // 10 for r in log[1:])


def test_too_large_component(spark):
    df = spark.createDataFrame([(1, [1e9] * 64, 0, "x", 3)], SCHEMA)
    with pytest.raises(ValueError, match="beyond"):
        va_file.cluster(df)
