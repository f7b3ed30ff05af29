import pytest
from pyspark.sql import functions as F

from tabprobe.operators import encoders as E


@pytest.fixture(scope="module")
def frames(spark):
    train = spark.createDataFrame(
        [(1, 1.0, "red", "x", 0), (2, None, "green", "y", 1), (3, 2.0, None, "x", 1),
         (4, 4.0, "blue", "x", 0), (5, 8.0, "red", "y", 1), (6, 8.0, "red", "x", 0)],
        "id long, num_a double, cat_a string, cat_b string, y int")
    test = spark.createDataFrame([(7, None, "purple", "x", 0), (8, 3.0, None, "z", 1)],
                                 "id long, num_a double, cat_a string, cat_b string, y int")
    return train, test


def test_split_columns(frames):
    cat, num = E.split_columns(frames[0], exclude=["id"])
    assert cat == ["cat_a", "cat_b"] and num == ["num_a", "y"]


def test_ordinal_unseen_and_missing(frames):
    train, test = frames
    m = E.fit_ordinal(train, ["cat_a", "cat_b"])
    tr = {r.id: (r.cat_a, r.cat_b) for r in m.transform(train).collect()}
    assert tr[4] == (0, 0) and tr[2] == (1, 1) and tr[1] == (2, 0) and tr[3] == (-2, 0)
    te = {r.id: (r.cat_a, r.cat_b) for r in m.transform(test).collect()}
    assert te[7] == (-1, 0)      # unseen category
    assert te[8] == (-2, -1)     # missing seen in train -> -2; unseen -> -1


def test_median_midpoint_and_fill(spark, frames):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 4.0, 8.0, 8.0]], "x double")
    assert E.exact_medians(df, ["x"])["x"] == 3.0
    m = E.fit_median_imputer(frames[0], ["num_a"])
    assert m.fill["num_a"] == 4.0
    got = {r.id: r.num_a for r in m.transform(frames[1]).collect()}
    assert got[7] == 4.0 and got[8] == 3.0


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert E.modes(df, ["c"])["c"] == "a"


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = E.fit_scaler(df, ["a", "b"])
    out = m.transform(df).collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.b for r in out] == [0.0, 0.0]


def test_one_hot_unseen_all_zero(frames):
    train, test = frames
    m = E.fit_one_hot(train, ["cat_b"])
    assert m.categories == {"cat_b": ["x", "y"]}
    got = {r.id: (r.cat_b__0, r.cat_b__1) for r in m.transform(test).collect()}
    assert got[8] == (0.0, 0.0) and got[7] == (1.0, 0.0)


def test_target_encoder_needs_target_and_shrinks(frames):
    train, test = frames
    with pytest.raises(ValueError):
        E.fit_tree_encoder(train.drop("y"), ["cat_b"], target=None, categorical_encoding="target")
    m = E.fit_target_encoder(train, ["cat_b"], "y", "classification")
    out = {r.id: r.cat_b for r in m.transform(test).collect()}
    g = 0.5
    assert out[8] == pytest.approx(g)            # unseen -> global mean
    # x: n=4, mean=0.25, var_within=0.1875; global var 0.25
    lam = 0.25 * 4 / (0.25 * 4 + 0.1875)
    assert out[7] == pytest.approx(lam * 0.25 + (1 - lam) * g)


def test_target_oof_never_sees_own_fold(spark):
    rows = [(i, "a" if i % 2 else "b", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    out = E.target_encode_oof(df, ["c"], "y", "classification", ["id"])
    assert out.count() == 40
    assert out.where(F.col("c").isNull()).count() == 0


def test_fit_state_from_train_only(frames):
    train, test = frames
    prep = E.fit_prep_for_generation(train, ["num_a", "cat_a"], ["cat_a"])
    out = {r.id: (r.num_a, r.cat_a) for r in prep.transform(test).collect()}
    assert out[7] == (4.0, -1.0)


@pytest.mark.parametrize("n", [1, 2, 999, 4000])
def test_exact_median_matches_python(spark, n):
    import random
    import statistics

    rng = random.Random(n)
    vals = [float(rng.randint(0, 50)) if i % 3 else rng.random() for i in range(n)]
    df = spark.createDataFrame([(v, None) for v in vals], "x double, e double")
    got = E.exact_medians(df, ["x", "e"])
    assert got["x"] == pytest.approx(statistics.median(vals)) and got["e"] is None
