"""The result store's commits, cached tables, CSV folders."""
import json
import os

import pytest
from pyspark.sql import functions as F

from tabprobe.sources import files
from tabprobe.sources.cache import load_cached
from tabprobe.sources.catalog import build_corpus, list_keys, lookup, registry_frame
from tabprobe.sources.results import append_results, compact_results, pair_file, read_results, rows_to_frame
from tabprobe.sources.tables import read_csv_dir


def rows(spark, key, method, values, status="ok"):
    return rows_to_frame(spark, [dict(key=key, method=method, status=status, model_family=f"f{i}", value=v)
                                 for i, v in enumerate(values)])


def stored(spark, out):
    return sorted((r.key or "", r.method, r.model_family, r.value) for r in read_results(spark, out).collect())


def test_pair_stored_again_replaces_its_rows(spark, tmp_path):
    out = str(tmp_path / "store")
    assert stored(spark, out) == []
    append_results(rows(spark, "k", "m", [1.0, 2.0]), out)
    append_results(rows(spark, "k", "m2", [3.0]), out)
    append_results(rows(spark, None, "m", [4.0]), out)
    append_results(rows(spark, "k", "m", [1.0, 2.0]), out)      # retried: the answer was lost
    assert stored(spark, out) == [("", "m", "f0", 4.0), ("k", "m", "f0", 1.0), ("k", "m", "f1", 2.0),
                                  ("k", "m2", "f0", 3.0)]
    append_results(rows(spark, "k", "m", [9.0]), out)
    assert ("k", "m", "f1", 2.0) not in stored(spark, out) and len(os.listdir(out)) < 8


def test_failure_while_writing_leaves_the_store(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "store")
    append_results(rows(spark, "k", "m", [1.0]), out)
    before = stored(spark, out)
    (tmp_path / "store" / "_half-written").write_text('{"key": "k", "method"')   # a draft that was never renamed
    assert stored(spark, out) == before


def test_compaction_however_far_it_gets(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "store")
    for i in range(3):
        append_results(rows(spark, f"k{i}", "m", [float(i), 0.5]), out)
    want = stored(spark, out)
    kept = files.remove
    monkeypatch.setattr(files, "remove", lambda *a: None)   # fails before it deletes anything
    compact_results(spark, out)
    assert stored(spark, out) == want
    compact_results(spark, out)                              # another one over files and the first
    assert stored(spark, out) == want
    monkeypatch.setattr(files, "remove", kept)
    compact_results(spark, out)
    assert stored(spark, out) == want
    assert [f for f in os.listdir(out) if f.endswith(".json") and not f.startswith(".")] == ["all-00000003.json"]
    append_results(rows(spark, "k1", "m", [7.0]), out)       # newer than the compacted rows
    assert ("k1", "m", "f0", 7.0) in stored(spark, out) and len(stored(spark, out)) == 5
    assert pair_file(None, "m") != pair_file("n", "m")


def test_second_load_reads_no_source(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    src.mkdir()
    (src / "train.csv").write_text("id,c,y\n1,a,0.5\n2,,1.5\n3,b,2.5\n")
    calls = []

    def read(spark, paths):
        calls.append(paths)
        return spark.read.option("header", True).option("inferSchema", True).csv(paths)

    def load(**kw):
        ds, meta = load_cached(spark, "toy", [str(src)], read, "y", cache, key_cols=["id"], sector="food",
                               meta={"license": "free", "scale": "small"}, **kw)
        return sorted((r.id, r.c, r.y) for r in ds.df.collect()), meta

    want = [(1, "a", 0.5), (2, None, 1.5), (3, "b", 2.5)]
    first, meta = load()
    assert first == want and len(calls) == 1
    assert (meta["n_rows"], meta["n_features"], meta["n_categorical"], meta["task"], meta["license"], meta["sector"],
            meta["scale"]) == (3, 2, 1, "regression", "free", "food", "small")
    assert load() == (want, meta) and len(calls) == 1
    folder = next((tmp_path / "cache").iterdir())
    data = next(p for p in folder.iterdir() if p.name.startswith("data-"))
    part = next(p for p in data.iterdir() if p.name.endswith(".parquet"))
    part.write_bytes(part.read_bytes()[:-3])                 # a cut file
    assert load() == (want, meta) and len(calls) == 2
    (folder / "manifest.json").write_text('{"data": "da')    # a broken manifest
    assert load() == (want, meta) and len(calls) == 3
    assert load(use_cache=False) == (want, meta) and len(calls) == 4
    (src / "train.csv").write_text("id,c,y\n1,a,0.5\n")      # another source
    assert load()[0] == want[:1] and len(calls) == 5
    assert json.loads((next(p for p in (tmp_path / "cache").iterdir() if p != folder) / "manifest.json").read_text())


def test_csv_folder_becomes_one_table(spark, tmp_path):
    (tmp_path / "train_a.csv").write_text("id,x,y\n1,5,0\n2,6,1\n3,7,0\n")
    (tmp_path / "train_b.csv").write_text("id,z\n1,u\n3,v\n")
    (tmp_path / "test.csv").write_text("id,x\n9,9\n")
    got = sorted(tuple(r) for r in read_csv_dir(spark, str(tmp_path), target="y").select("id", "x", "y", "z").collect())
    assert got == [(1, 5, 0, "u"), (2, 6, 1, None), (3, 7, 0, "v")]
    with pytest.raises(FileNotFoundError):
        read_csv_dir(spark, str(tmp_path / "none"))


def test_unknown_and_empty_keys_are_errors(spark):
    reg = registry_frame(spark, [dict(key="b", task="regression"), dict(key="a", task="regression")])
    assert list_keys(reg) == ["a", "b"] and lookup(reg, "b").first()["pos"] == 0
    with pytest.raises(KeyError):
        lookup(reg, "c")
    with pytest.raises(ValueError):
        list_keys(registry_frame(spark, [dict(key="", task="regression")]))


def test_members_without_a_name_stay(spark):
    members = spark.createDataFrame([(0, 0, None), (0, 1, "a"), (1, 0, "A"), (1, 1, None)],
                                    "suite_pos int, pos int, name string")
    nothing = spark.createDataFrame([(None,), ("b",)], "name string")
    assert [tuple(r) for r in build_corpus(members, nothing).collect()] == [(0, 0, None), (0, 1, "a"), (1, 1, None)]


def test_sparse_one_hot_trains_a_million_categories(spark):
    from pyspark.ml.classification import LogisticRegression

    from tabprobe.operators import encoders as E

    n = 1_000_000
    df = spark.range(n).select(F.concat(F.lit("user"), "id").alias("c"), (F.col("id") % 4 == 0).cast("string").alias("g"),
                               (F.col("id") % 4 == 0).cast("double").alias("y"))
    model = E.fit_one_hot_sparse(df, ["c", "g"])
    assert model.sizes == {"c": n, "g": 2}
    hot = model.transform(df.sample(0.02, seed=1))
    assert hot.schema["c__onehot"].dataType.typeName() == "vectorudt"
    assert hot.first()["c__onehot"].size == n + 1 and hot.first()["c__onehot"].numNonzeros() == 1
    fit = LogisticRegression(featuresCol="c__onehot", labelCol="y", maxIter=1, regParam=1e-4).fit(hot)
    assert fit.numFeatures == n + 1
    unseen = model.transform(spark.createDataFrame([("nobody", None, 0.0)], df.schema)).first()
    assert list(unseen["c__onehot"].indices) == [n] and list(unseen["g__onehot"].indices) == [2]


@pytest.mark.parametrize("encoding", ["tree", "linear"])
def test_cross_fitted_codes_in_both_profiles(spark, encoding):
    from tabprobe.operators.encoders import fit_target_encoder, target_encode_oof
    from tabprobe.plans.run import iter_folds
    from tabprobe.sources.tables import Dataset

    df = spark.createDataFrame([(i, "abc"[i % 3], float(i % 3 + i % 7)) for i in range(300)], "id long, c string, y double")
    ds = Dataset("cross", df, "y", ["id"], task="regression")
    (fold,) = iter_folds(ds, encoding, "target_oof")
    train = fold.train.select("id").join(df, "id")
    want = {r.id: r.c for r in target_encode_oof(train, ["c"], "y", "regression", ["id"]).collect()}
    assert {r.id: r.c for r in fold.train.collect()} == {i: pytest.approx(v) for i, v in want.items()}
    assert len(set(want.values())) > 3                        # not one code per category
    whole = {r.c: r.e for r in fit_target_encoder(train.withColumn("e", F.col("c")), ["e"], "y", "regression")
             .transform(train.withColumn("e", F.col("c"))).collect()}
    test = {r.id: r.c for r in fold.test.collect()}
    assert test and all(test[i] == pytest.approx(whole["abc"[i % 3]]) for i in test)


def test_sparse_fold_scores_like_the_dense_one(spark):
    from tabprobe.operators.models import fit_and_score
    from tabprobe.plans.run import iter_folds
    from tabprobe.sources.tables import Dataset

    df = spark.createDataFrame([(i, "abcd"[i % 4], float(i % 5), float(i % 4 + i % 5)) for i in range(400)],
                               "id long, c string, x double, y double")
    ds = Dataset("sparse", df, "y", ["id"], task="regression")
    scores = []
    for encoding in ("onehot", "onehot_sparse"):
        (f,) = iter_folds(ds, "linear", encoding)
        scores.append(fit_and_score("linear", "regression", f.train, f.test, f.features, "y", "id")["value"])
    assert scores[0] == pytest.approx(scores[1], abs=1e-4)


def test_model_without_predictions_is_an_error(spark):
    from tabprobe.operators.models import _regression_row

    df = spark.createDataFrame([(1.0, 1.0), (2.0, float("nan"))], "__y double, p double")
    with pytest.raises(ValueError, match="1 test rows"):
        _regression_row(df, "p")
