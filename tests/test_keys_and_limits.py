"""Row identity, missing values, far-off targets, and limits that must not cut data."""
import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tabprobe.functions.scalar import key_text, sector_family
from tabprobe.operators import encoders as E
from tabprobe.operators.association import cap_columns, pearson_abs
from tabprobe.operators.models import fit_and_score
from tabprobe.operators.splits import add_split, hash_sample
from tabprobe.plans import report, run
from tabprobe.plans.methods import SampledPandasMethod
from tabprobe.sources.catalog import build_corpus
from tabprobe.sources.tables import Dataset, attach_labels, column_profile, flatten_arrays, keyless_dataset


@pytest.mark.parametrize("kind", ["timestamp", "double", "string"])
def test_close_keys_stay_apart(spark, kind):
    start = dt.datetime(2024, 1, 1)
    value = {"timestamp": lambda i: start + dt.timedelta(microseconds=i),
             "double": lambda i: 1 + i * 1e-6, "string": lambda i: f"x:{i}"}[kind]
    df = spark.createDataFrame([(value(i), i) for i in range(1000)], f"k {kind}, v int")
    assert add_split(df, ["k"], "d").where("is_test").count() == 200
    assert hash_sample(df, ["k"], 100).count() == 100


def test_key_text_is_unambiguous(spark):
    rows = [(None, "a"), ("a", None), ("a:b", "c"), ("a", "b:c"), ("", None), (None, ""), (None, None), ("n", "n")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(key_text(df, ["a", "b"])).distinct().count() == len(rows)


def test_keyless_tables(spark):
    rows = [(i % 50, float(i % 7), None if i % 3 else "x") for i in range(1000)] + [(1, 1.0, "y")] * 500
    ds = keyless_dataset("t", spark.createDataFrame(rows, "a int, y double, c string").repartition(5), "y")
    assert ds.features == ["a", "c"]
    assert ds.df.select(*ds.key_cols).distinct().count() == ds.df.count() == len(rows)
    assert sorted(map(str, ds.df.select("a", "y", "c").collect())) == sorted(
        f"Row(a={a}, y={y}, c={c!r})" for a, y, c in rows)
    assert add_split(ds.df, ds.key_cols, "t").where("is_test").count() == 300


def test_nan_is_missing(spark):
    rows = [(float(i), float(i % 5), float("nan") if i == 7 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    scores = {r["col"]: r["association"] for r in pearson_abs(df, ["a", "b"], F.col("y")).collect()}
    assert scores["b"] == pytest.approx(1.0)
    broken = df.withColumn("z", F.lit(float("nan")))
    assert cap_columns(broken, ["z", "a", "b"], "y", "regression", 1) == ["b"]
    mean, std = E.fit_scaler(df, ["b"]).stats["b"]
    assert mean == pytest.approx(sum(i for i in range(40) if i != 7) / 39) and std > 0
    assert {r["col"]: r["n_missing"] for r in column_profile(df).collect()} == {"y": 0, "a": 0, "b": 1}


def test_out_of_fold_encoding_of_a_shifted_target(spark):
    rows = [(i, f"c{i % 4}", (i * 37 % 11) / 10 + (i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string, y double")

    def encoded(shift):
        out = E.target_encode_oof(df.withColumn("y", F.col("y") + shift), ["c"], "y", "regression", ["id"])
        return {r["id"]: r["c"] - shift for r in out.select("id", "c").collect()}

    near, far = encoded(0.0), encoded(1e8)
    assert max(abs(near[i] - far[i]) for i in near) < 1e-6


def test_labels_unique_under_clashes(spark):
    keys = ["alpha", "apple", "a-2", "avocado", "b"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, pos int")
    got = {r["key"]: r["abbrev"] for r in report.abbreviations(df).collect()}
    assert got == {"alpha": "A", "apple": "A2", "a-2": "A22", "avocado": "A3", "b": "B"}


def test_sector_rules(spark):
    names = ["Telco churn", "Healthcare", "material science", "chemistry", "retail", "personal finance", "ENERGY"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(sector_family(F.col("s"))).collect()] == [
        "finance", "healthcare", "physical-science", "physical-science", "general", "finance", "physical-science"]


def test_nothing_is_cut_by_default(spark):
    wide = spark.createDataFrame([([1.0] * 3,), ([2.0] * 5,)], "a array<double>")
    assert len(flatten_arrays(wide, "a").columns) == 5
    with pytest.raises(Exception, match="more than 4 elements"):
        flatten_arrays(wide, "a", 4).collect()
    assert flatten_arrays(wide, "a", categorical=True).dtypes[0] == ("c0", "string")
    members = spark.createDataFrame([(0, i, f"n{i}") for i in range(150)], "suite_pos int, pos int, name string")
    nothing = spark.createDataFrame([], "name string")
    assert build_corpus(members, nothing).count() == 150 and build_corpus(members, nothing, cap=7).count() == 7
    many = spark.range(12_000).select(F.concat(F.lit("v"), "id").alias("c"))
    assert len(E.fit_one_hot(many, ["c"]).categories["c"]) == 12_000
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert attach_labels(left, spark.createDataFrame([(1, 5)], "k int, y int"), ["k"]).count() == 2
    big = spark.range(200).select(F.col("id").cast("double").alias("x"), F.rand(1).alias("y"))
    method = SampledPandasMethod("p", lambda pdf, target, task: len(pdf), lambda pdf, n: pdf.assign(n=float(n)),
                                 ["n"], fit_rows=50)
    assert method.fit(big, "y", "regression").transform(big).first()["n"] == 50


def test_knn_scores_every_test_row(spark):
    rows = spark.range(26_000).select("id", (F.col("id") % 97 / 97.0).alias("x"),
                                      (F.col("id") % 97 > 40).cast("int").alias("y"))
    train, test = rows.where("id < 2000"), rows.where("id >= 2000")
    assert fit_and_score("knn", "classification", train, test, ["x"], "y", "id")["value"] == pytest.approx(1.0)
    assert fit_and_score("knn", "classification", train, test.limit(500), ["x"], "y", "id",
                         knn_train_rows=300)["value"] > 0.95


def test_budget_returns_at_its_deadline(spark):
    t0 = time.time()
    with pytest.raises(run.BudgetExceeded):
        run.run_with_budget(spark, lambda: time.sleep(8), 1)
    assert time.time() - t0 < 2


def test_sweep_splits_once_per_dataset_and_retries_failures(spark, tmp_path, monkeypatch):
    rows = [(i, i % 13, (i * 7) % 5, float(i % 13) + (i % 5) / 10) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, a int, b int, y double")
    splits = []
    plain = run.add_split
    monkeypatch.setattr(run, "add_split", lambda *a, **k: splits.append(a[2]) or plain(*a, **k))

    class Broken:
        name, works = "broken", False

        def fit(self, train, target, task):
            if not Broken.works:
                raise ValueError("x" * 3000)
            return run.resolve_method("baseline").fit(train, target, task)

    out = str(tmp_path / "results")
    data = [Dataset("d", df, "y", ["id"], "regression")]
    run.run_benchmark(spark, data, ["baseline", Broken], out, ("linear",))
    assert splits == ["d"]
    stored = {r["method"]: r for r in run.read_results(spark, out).collect()}
    assert stored["baseline"]["status"] == "ok" and len(stored["broken"]["error"]) >= 3000
    assert run.run_benchmark(spark, data, ["baseline", Broken], out, ("linear",))[0] == 0
    Broken.works = True
    assert run.run_benchmark(spark, data, ["baseline", Broken], out, ("linear",), retry_failed=True)[0] == 1
    assert splits == ["d", "d"]
    result = run.compare(spark, ["baseline"], [("keyless", df.drop("id"), "y", "regression")], ("linear",))
    assert "keyless" in repr(result) and "(mean)" in repr(result)
