"""Hot keys: one value / name / class holding a third or more of all rows."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabprobe.operators import encoders as E
from tabprobe.operators.metrics import auc_frame
from tabprobe.operators.splits import add_split, class_counts
from tabprobe.sources.catalog import build_corpus


def test_corpus_hot_name_keeps_first(spark):
    rows = [(i % 3, i, "Hot" if i % 3 == 0 else f"name{i}") for i in range(3000)]
    members = spark.createDataFrame(rows, "suite_pos int, pos int, name string")
    excl = spark.createDataFrame([("name4",)], "name string")
    out = build_corpus(members, excl, "name", cap=5).collect()
    assert [(r.suite_pos, r.pos, r.name) for r in out] == [
        (0, 0, "Hot"), (1, 1, "name1"), (1, 7, "name7"), (1, 10, "name10"), (1, 13, "name13")]


def test_median_with_hot_value(spark):
    rng = random.Random(2)
    vals = [5.0] * 1500 + [rng.random() * 10 for _ in range(1500)] + [7.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert E.exact_medians(df, ["x"])["x"] == pytest.approx(statistics.median(vals))


def test_auc_with_hot_score(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 1), 0.5 if i % 2 else rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = auc_frame(df, F.col("y") == 1, F.col("s")).first().auc
    pos = sorted(s for y, s in rows if y == 1)
    neg = sorted(s for y, s in rows if y == 0)
    import bisect
    u = sum(bisect.bisect_left(neg, p) + 0.5 * (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p))
            for p in pos)
    assert got == pytest.approx(u / (len(pos) * len(neg)))


def test_stratified_split_with_hot_class(spark):
    rows = [(i, "hot" if i % 2 else f"c{i % 7}") for i in range(7000)]
    df = spark.createDataFrame(rows, "id long, y string")
    s = add_split(df, ["id"], "skewed", "y", stratify=True)
    for r in class_counts(s, "y").collect():
        assert r.n_test == round(r.n * 0.2)
