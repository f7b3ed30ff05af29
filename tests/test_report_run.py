import pytest
from pyspark.sql import functions as F

from tabprobe.plans import report as R
from tabprobe.plans.methods import BaselineMethod, function_method
from tabprobe.plans.run import compare, run_benchmark, run_dataset
from tabprobe.sources.results import RESULT_SCHEMA, read_results, rows_to_frame
from tabprobe.sources.tables import Dataset


#: fold scores by dataset, method and family: eighths, so that means and ties are exact
SCORES = {
    ("harbor-traffic", "plain"): (4.0, {"tree": [0.25, 0.5, 0.75], "linear": [0.25]}),
    ("harbor-traffic", "ratios"): (200.0, {"tree": [0.625], "linear": [0.125, 0.375], "knn": [0.25]}),
    ("harbor-traffic", "bins"): (16.0, {"tree": [0.125]}),
    ("bean-yield", "plain"): (2.0, {"knn": [0.875, 0.625]}),
    ("bean-yield", "ratios"): (8.0, {"linear": [0.5]}),
}
FAILED = [("bean-yield", "bins", "timeout", "over 300 s"), ("bean-yield", "bins", "error", "bad bin\n  at line 3"),
          ("harbor-traffic", "bins", "model_error", "bad bin\n  at line 9")]


def _scored():
    found = []
    for (key, method), (seconds, families) in SCORES.items():
        task = "regression" if key.startswith("harbor") else "classification"
        found += [{"key": key, "method": method, "task": task, "status": "ok", "model_family": family,
                   "fold_id": f"part{i}", "value": v, "gen_elapsed_s": seconds,
                   "metric": "r2" if task == "regression" else "auc"}
                  for family, folds in families.items() for i, v in enumerate(folds)]
    return found + [{"key": k, "method": m, "status": st, "error": e} for k, m, st, e in FAILED]


def test_report_cells(spark):
    """Cells worked out by hand from ``SCORES``: a fold mean per family, their mean per cell."""
    res = rows_to_frame(spark, _scored())
    cells = {(r.key, r.method): (r.score, r.is_best) for r in R.overview(res).collect()}
    assert cells == {
        ("harbor-traffic", "plain"): (0.375, True), ("harbor-traffic", "ratios"): (0.375, True),  # a tie
        ("harbor-traffic", "bins"): (0.125, False),
        ("bean-yield", "plain"): (0.75, True), ("bean-yield", "ratios"): (0.5, False)}
    table = {r.method: (r["HT"], r["BY"]) for r in R.overview_table(res).collect()}
    assert table["plain"] == ("**0.375**", "**0.750**") and table["ratios"] == ("**0.375**", "0.500")
    assert table["bins"][0] == "0.125"
    assert {r.method: r.median_txt for r in R.speed_median(res).collect()} == {
        "plain": "3.0 s", "ratios": "104.0 s", "bins": "16.0 s"}


def test_failures_are_counted(spark):
    res = rows_to_frame(spark, _scored())
    assert {(r.key, r.method, r.status): r["count"] for r in R.failure_counts(res).collect()} == {
        (k, m, st): 1 for k, m, st, _ in FAILED}
    assert {(r.status, r.message, r["count"]) for r in R.failure_details(res).collect()} == {
        ("timeout", "over 300 s", 1), ("error", "bad bin", 1), ("model_error", "bad bin", 1)}


def test_narrow_rows_accepted(spark, tmp_path):
    narrow = [dict(key="k", method="m", task="regression", status="ok", model_family="tree",
                   metric="r2", value=0.5)]
    out = str(tmp_path / "res")
    rows_to_frame(spark, narrow).select("key", "method", "task", "status", "model_family", "metric", "value") \
        .write.json(out)
    back = read_results(spark, out)
    assert back.schema == RESULT_SCHEMA and back.count() == 1
    assert R.overview(back).first().score == 0.5


class Boom:
    name = "boom"

    def fit(self, train, target, task):
        raise RuntimeError("boom")


def _dataset(spark):
    rows = [(i, float(i % 7), "abc"[i % 3], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, num_a double, cat_a string, target int")
    return Dataset("toy", df, "target", ["id"], task="classification")


def test_run_dataset_rows_and_isolated_failure(spark):
    ds = _dataset(spark)
    rows = run_dataset(spark, ds, [BaselineMethod(), Boom()], ["linear", "knn"], budget_seconds=None)
    ok = [r for r in rows if r["method"] == "baseline"]
    assert len(ok) == 2 and all(r["status"] == "ok" for r in ok)
    assert {r["metric"] for r in ok} == {"auc"}
    bad = [r for r in rows if r["method"] == "boom"]
    assert len(bad) == 1 and bad[0]["status"] == "error" and "boom" in bad[0]["error"]


def test_function_and_class_agree(spark):
    ds = _dataset(spark)
    noop = function_method(lambda tr, te, t, k: (tr, te), name="noop")
    a = run_dataset(spark, ds, [noop], ["linear"], budget_seconds=None)
    b = run_dataset(spark, ds, [BaselineMethod()], ["linear"], budget_seconds=None)
    assert a[0]["value"] == pytest.approx(b[0]["value"])


def test_timeout_row(spark):
    import time

    class Slow:
        name = "slow"

        def fit(self, train, target, task):
            time.sleep(3)
            return BaselineMethod().fit(train, target, task)

    rows = run_dataset(spark, _dataset(spark), [Slow()], ["linear"], budget_seconds=1)
    assert rows[0]["status"] == "timeout"


def test_resume_and_compare(spark, tmp_path):
    out = str(tmp_path / "results")
    ds = _dataset(spark)
    n1, _ = run_benchmark(spark, [ds], ["baseline"], out, model_families=["linear"], budget_seconds=None)
    n2, _ = run_benchmark(spark, [ds], ["baseline"], out, model_families=["linear"], budget_seconds=None)
    assert n1 == 1 and n2 == 0
    with pytest.raises(ValueError):
        compare(spark, ["baseline"], [])


def test_tree_family_scores(spark):
    rows = run_dataset(spark, _dataset(spark), ["baseline"], ["tree"], budget_seconds=None, tree_rounds=5)
    assert rows[0]["status"] == "ok" and 0.0 <= rows[0]["value"] <= 1.0


def test_status_stream(spark, tmp_path):
    from tabprobe.sources.results import append_results
    from tabprobe.streaming.status import start_status

    out = str(tmp_path / "res")
    append_results(rows_to_frame(spark, _scored()), out)
    q = start_status(spark, out, str(tmp_path / "ck"), name="status_test")
    try:
        q.processAllAvailable()
        got = {r.status: r["count"] for r in spark.table("status_test").collect()}
    finally:
        q.stop()
    assert got == {"ok": 12, "timeout": 1, "error": 1, "model_error": 1}


def test_iter_folds_train_only_encoders(spark):
    from tabprobe.plans.run import iter_folds

    ds = _dataset(spark)
    folds = list(iter_folds(ds, "linear"))
    assert len(folds) == 1
    f = folds[0]
    assert f.categorical_columns == ("cat_a",)
    assert f.train.count() + f.test.count() == 80
    assert {"cat_a__0", "cat_a__1", "cat_a__2", "num_a"} <= set(f.features)
    t = list(iter_folds(ds, "tree"))[0]
    assert t.train.schema["cat_a"].dataType.typeName() == "long"
    with pytest.raises(KeyError):
        list(iter_folds(ds, "nope"))


def test_unknown_family_is_model_error_row(spark):
    rows = run_dataset(spark, _dataset(spark), ["baseline"], ["linear", "svm"], budget_seconds=None)
    by = {r["model_family"]: r for r in rows}
    assert by["linear"]["status"] == "ok"
    assert by["svm"]["status"] == "model_error" and "unknown model family" in by["svm"]["error"]


def _centred():
    """A mean as a mergeable state."""
    from tabprobe.plans.methods import PandasMethod

    return PandasMethod(
        "centred", start=lambda: (0, 0.0), merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        add=lambda state, pdf, target, task: (state[0] + len(pdf), state[1] + float(pdf["num_a"].sum())),
        finish=lambda state, target, task: state[1] / max(state[0], 1),
        transform_pandas=lambda pdf, mean: pdf.assign(num_centred=pdf["num_a"] - mean), new_columns=["num_centred"])


def test_pandas_method(spark):
    rows = run_dataset(spark, _dataset(spark), [_centred()], ["linear"], budget_seconds=None)
    assert rows[0]["status"] == "ok" and rows[0]["n_features_generated"] == 1


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_pandas_method_fits_on_every_row(spark, parts):
    """States of any number of partitions merge into that of a single pass."""
    n = 1_000_000
    df = spark.range(n, numPartitions=parts).select((F.col("id") % 1000).cast("double").alias("num_a"),
                                                    F.lit(0).alias("y"))
    fitted = _centred().fit(df, "y", "regression")
    assert fitted.state == 499.5
    assert fitted.transform(df.limit(3)).columns == ["num_a", "y", "num_centred"]
    assert _centred().fit(df.limit(0), "y", "regression").state == 0


def test_pandas_states_merge_in_order(spark):
    from tabprobe.plans.methods import PandasMethod

    m = PandasMethod("order", start=list, merge=lambda a, b: a + b,
                     add=lambda state, pdf, target, task: state + pdf["id"].tolist(),
                     transform_pandas=lambda pdf, state: pdf, new_columns=[])
    assert m.fit(spark.range(0, 100, numPartitions=50), "id", "regression").state == list(range(100))


def test_csv_source_and_split_plan_roundtrip(spark, tmp_path):
    from tabprobe.sources import catalog as C
    from tabprobe.sources.tables import read_csv_dir

    d = tmp_path / "csv"
    d.mkdir()
    (d / "train.csv").write_text("a,b\n1,x\n2,y\n")
    (d / "other.csv").write_text("a,b\n9,z\n")
    df = read_csv_dir(spark, str(d))
    assert sorted(r.a for r in df.collect()) == [1, 2]
    reg = C.registry_frame(spark, [dict(key="california-housing", task="regression", sector="geo"),
                                   dict(key="german-credit", task="classification", sector="finance")])
    plan = C.split_plan(reg)
    path = str(tmp_path / "plan")
    C.write_split_plan(plan, path)
    back = {r.key: (r.seed, r.stratify) for r in C.load_split_plan(spark, path).collect()}
    assert back["california-housing"] == (1404229301, False) and back["german-credit"][1] is True
    fallback = C.load_split_plan(spark, str(tmp_path / "missing"), reg)
    assert fallback.count() == 2


def test_compare_rows_and_summary(spark, tmp_path):
    ds = _dataset(spark)
    out = str(tmp_path / "cmp")
    res = compare(spark, ["baseline"], [ds], ["linear"], out_dir=out)
    assert len(res.rows) == 1 and res.rows[0]["status"] == "ok"
    assert res.rows[0].get("fold_id") is None          # compare() writes narrow rows
    summ = res.summary().collect()
    assert {(r.key, r.method, r.status) for r in summ} == {("toy", "baseline", "ok"), (None, "baseline", "ok")}
    again = compare(spark, ["baseline"], [ds], ["linear"], out_dir=out)
    assert len(again.rows) == 1                          # resumed: nothing re-run


def test_named_methods_and_failures_in_summary(spark):
    noop = lambda tr, te, t, k: (tr, te)
    res = compare(spark, [("my name", noop), ("mine too", BaselineMethod), Boom()], [_dataset(spark)], ["linear"])
    assert {r["method"]: r["status"] for r in res.rows} == {"my name": "ok", "mine too": "ok", "boom": "error"}
    failed = [r for r in res.summary().collect() if r.status != "ok"]
    assert [(r.key, r.method, r.status, r["count"]) for r in failed] == [("toy", "boom", "error", 1)]
    text = repr(res)
    assert "my name" in text and "Failures" in text and "error, 1 times" in text
    alone = compare(spark, [Boom()], [_dataset(spark)], ["linear"])
    assert "No pair has a score" in repr(alone)


def test_methods_see_two_tasks(spark):
    seen = []

    class Spy:
        name = "spy"

        def fit(self, train, target, task):
            seen.append(task)
            return BaselineMethod().fit(train, target, task)

    ds = _dataset(spark)
    run_dataset(spark, Dataset("m", ds.df, "target", ["id"], task="multiclass"), [Spy()], [], budget_seconds=None)
    run_dataset(spark, Dataset("r", ds.df, "num_a", ["id"], task="regression"), [Spy()], [], budget_seconds=None)
    assert seen == ["classification", "regression"]


def test_datasets_of_a_sweep_overlap(spark, tmp_path):
    """Two datasets at once, each in its pool, with the rows of the serial run."""
    import threading
    import time

    met, together, pools = threading.Event(), [], set()
    running = set()

    class Meets:
        name = "meets"

        def fit(self, train, target, task):
            pools.add(train.sparkSession.sparkContext.getLocalProperty("spark.scheduler.pool"))
            running.add(threading.get_ident())
            end = time.time() + 20
            while len(running) < 2 and not met.is_set() and time.time() < end:
                time.sleep(0.05)
            met.set()
            together.append(len(running))
            return BaselineMethod().fit(train, target, task)

    def sets(n):
        return [Dataset(f"d{i}", _dataset(spark).df, "target", ["id"], task="classification") for i in range(n)]

    def scores(folder):
        return {(r.key, r.method, r.model_family): r.value for r in read_results(spark, folder).collect()}

    out, serial = str(tmp_path / "two"), str(tmp_path / "one")
    n, _ = run_benchmark(spark, sets(2), [Meets], out, ["linear"], budget_seconds=None, datasets_at_once=2)
    assert n == 2 and max(together) == 2 and pools == {"dataset-d0", "dataset-d1"}
    run_benchmark(spark, sets(2), [Meets], serial, ["linear"], budget_seconds=None, datasets_at_once=1)
    assert scores(out) == scores(serial)
