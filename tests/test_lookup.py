"""Entries of many columns in one table, with and without a byte budget."""
import random
import re

import pytest
from pyspark.sql import functions as F

from tabprobe.operators import encoders as E
from tabprobe.operators import lookup as L


def frame(spark, n=3000, cols=("a", "b", "c")):
    """A third of ``a`` is one value, a third of ``b`` is missing, ``c`` has a value per row."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"a{rng.randrange(300)}", None if i % 3 == 1 else f"b{rng.randrange(40)}",
             f"c{i}" if i % 2 else "x" * 100 + str(i % 50), rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a string, b string, c string, y double").repartition(6)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("budget", [0, 4000, 40_000])
def test_same_codes_at_every_budget(spark, budget):
    train, cols = frame(spark), ["a", "b", "c"]
    test = frame(spark, 3600).withColumn("a", F.when(F.col("id") % 3 == 2, "new").otherwise(F.col("a")))
    whole = E.fit_ordinal(train, cols)
    assert whole.codes.cold is None
    part = E.fit_ordinal(train, cols, budget_bytes=budget)
    assert part.codes.cold is not None
    for df in (train, test, train.limit(0)):
        assert rows_of(part.transform(df)) == rows_of(whole.transform(df))


@pytest.mark.parametrize("budget", [0, 4000])
def test_same_target_statistics_at_every_budget(spark, budget):
    train, cols = frame(spark), ["a", "b", "c"]
    whole = rows_of(E.fit_target_encoder(train, cols, "y", "regression").transform(train))
    assert rows_of(E.fit_target_encoder(train, cols, "y", "regression", budget_bytes=budget).transform(train)) == whole
    folds = rows_of(E.target_encode_oof(train, cols, "y", "regression", ["id"]))
    assert rows_of(E.target_encode_oof(train, cols, "y", "regression", ["id"], budget_bytes=budget)) == folds


def test_hot_values_are_broadcast_first(spark):
    model = E.fit_target_encoder(frame(spark), ["a", "b", "c"], "y", "regression", budget_bytes=1000)
    hot = {r["key"] for r in model.stats.hot.collect()}
    assert {"a\x1fvhot", "b\x1fn"} <= hot and len(hot) < 60


def exchanges(df):
    df.collect()
    nodes = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "ReusedExchange" not in x]
    return tuple(sum(bool(re.search(kind, x)) for x in nodes)
                 for kind in (r"\bExchange hashpartitioning", "BroadcastExchange"))


@pytest.mark.parametrize("budget", [None, 0])
def test_shuffles_for_a_hundred_columns(spark, budget):
    n = 100
    df = spark.range(400).select("id", *[
        F.concat(F.lit("v"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20 + i))).alias(f"c{i}") for i in range(n)])
    model = E.fit_ordinal(df, [f"c{i}" for i in range(n)], **({} if budget is None else {"budget_bytes": budget}))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan, with what it reuses
    try:
        shuffles, broadcasts = exchanges(model.transform(df))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    if budget is None:
        assert (shuffles, broadcasts) == (0, 1)
    else:
        assert shuffles <= 2  # by key, by row


def test_long_values_have_short_keys(spark):
    df = spark.createDataFrame([("x" * 10_000,), ("x" * 9_999 + "y",), (None,)], "v string")
    keys = {r[0] for r in df.select(L.entry_key("c", F.col("v"))).collect()}
    assert len(keys) == 3 and max(map(len, keys)) < 80
