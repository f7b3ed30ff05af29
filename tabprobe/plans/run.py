"""End-to-end runs: one dataset, a resumable sweep, and ad-hoc comparisons.

Per dataset: frozen split (persisted once, shared by every method) ->
train-only prep (ordinal codes + exact medians) -> optional column cap ->
per method: fit on a bounded hash sample of train, transform both folds
(distributed), feature efficiency -> per family: train-only family input,
model fit, test metric -> one result row.  Failures become rows.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators.association import cap_columns, feature_efficiency
from ..operators.encoders import fit_family_input, fit_prep_for_generation, split_columns
from ..operators.models import MODEL_FAMILIES, TREE_ROUNDS, fit_and_score
from ..operators.splits import FOLD_ID, PROTOCOL, add_split, hash_sample, train_test
from ..sources.results import append_results, pending_pairs, read_results, rows_to_frame
from ..sources.tables import Dataset, keyless_dataset
from .methods import resolve_method

DEFAULT_BUDGET_SECONDS = 300
ROW_ID = "__rid"


class BudgetExceeded(Exception):
    pass


@dataclass
class Fold:
    """A ready-to-train fold: encoded train/test frames (row key, target,
    features) plus the categorical columns the encoder saw."""
    fold_id: str
    train: DataFrame
    test: DataFrame
    features: list[str]
    categorical_columns: tuple[str, ...]


def iter_folds(ds: Dataset, encoding: str = "tree", categorical_encoding: str | None = None):
    """Split -> fresh encoder fitted on the training rows only -> applied to
    both folds.  ``encoding`` is "tree" (ordinal or target codes, missing
    passed through) or "linear" (imputed, scaled, one-hot or target).
    ``categorical_encoding``: the profile's default, ``target``, ``target_oof``
    (target codes, the training rows' from the other folds) or, for linear ones,
    ``onehot_sparse`` (a sparse vector per column)."""
    from ..operators.encoders import fit_linear_encoder, fit_tree_encoder

    task = ds.resolved_task()
    split = add_split(ds.df, ds.key_cols, ds.name, ds.target, stratify=task != "regression")
    train, test = train_test(split)
    cols = [*ds.key_cols, ds.target]
    if encoding == "tree":
        enc = fit_tree_encoder(train, ds.features, ds.target, task, categorical_encoding or "ordinal", ds.key_cols)
    elif encoding == "linear":
        enc = fit_linear_encoder(train, ds.features, ds.target, task, categorical_encoding or "onehot", ds.key_cols)
    else:
        raise KeyError(f"unknown encoding {encoding!r}; use 'tree' or 'linear'")
    tr = enc.transform_train(train.select(*cols, *ds.features))
    te = enc.transform(test.select(*cols, *ds.features))
    feats = [c for c in tr.columns if c not in cols]
    yield Fold(FOLD_ID, tr, te, feats, enc.categorical_columns)


def run_with_budget(spark: SparkSession, fn, budget_seconds: float | None):
    """Run ``fn()`` (which triggers Spark jobs) under a wall-clock budget.

    The jobs run under their own job group.  At the deadline this returns (by
    raising); a background thread goes on cancelling the group until the worker
    ends, since a cancel sent before a job is submitted is lost.
    """
    if not budget_seconds:
        return fn()
    sc = spark.sparkContext
    group = f"tabprobe-{uuid.uuid4().hex}"
    box: dict = {}

    def work():
        sc.setJobGroup(group, "feature generation", interruptOnCancel=True)
        try:
            box["out"] = fn()
        except BaseException as exc:  # noqa: BLE001
            box["err"] = exc

    t = threading.Thread(target=inheritable_thread_target(spark)(work), daemon=True)
    t.start()
    t.join(budget_seconds)
    if t.is_alive():
        def cancel():
            while t.is_alive():
                sc.cancelJobGroup(group)
                t.join(0.5)

        threading.Thread(target=cancel, daemon=True).start()
        raise BudgetExceeded(f"generation exceeded {budget_seconds} s")
    if "err" in box:
        raise box["err"]
    return box["out"]


def _with_row_id(ds: Dataset) -> DataFrame:
    """A row id: the key itself when it is one integral column, else the whole
    hash of the key text."""
    from pyspark.sql import types as T

    from ..functions.scalar import key_text

    if len(ds.key_cols) == 1 and isinstance(ds.df.schema[ds.key_cols[0]].dataType, T.IntegralType):
        return ds.df.withColumn(ROW_ID, F.col(ds.key_cols[0]).cast("long"))
    return ds.df.withColumn(ROW_ID, F.sha2(key_text(ds.df, ds.key_cols), 256))


def run_dataset(spark: SparkSession, ds: Dataset, methods, model_families=MODEL_FAMILIES,
                budget_seconds: float | None = DEFAULT_BUDGET_SECONDS,
                max_cols: int | None = None,
                fit_sample_rows: int | None = None,
                tree_rounds: int = TREE_ROUNDS, narrow: bool = False,
                max_parallel: int = 6, on_rows=None) -> list[dict]:
    """Result rows for every (method, family) on one dataset.

    All training rows and columns are used; ``max_cols`` and
    ``fit_sample_rows`` bound them only if asked for.  ``on_rows`` gets each
    method's rows as soon as they are known (a sweep stores them).

    Generation runs method by method (each under its budget); the
    (method, family) model fits are independent Spark jobs and run
    concurrently from ``max_parallel`` driver threads.
    """
    task = ds.resolved_task()
    feats = ds.features
    cat, _ = split_columns(ds.df.select(*feats))
    base = _with_row_id(ds)
    split = add_split(base, ds.key_cols, ds.name, ds.target, stratify=task != "regression") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    train_raw, test_raw = train_test(split)
    prep = fit_prep_for_generation(train_raw, feats, cat)
    keep = [ROW_ID, ds.target]
    train_num = prep.transform(train_raw.select(*keep, *feats))
    test_num = prep.transform(test_raw.select(*keep, *feats))
    if max_cols:
        feats = cap_columns(train_num, feats, ds.target, task, max_cols)
        train_num = train_num.select(*keep, *feats)
        test_num = test_num.select(*keep, *feats)
    train_num = train_num.persist(StorageLevel.MEMORY_AND_DISK)
    test_num = test_num.persist(StorageLevel.MEMORY_AND_DISK)
    sample_box: list = []

    def fit_sample():
        """The bounded fit sample: method-independent, thresholds computed once."""
        if not fit_sample_rows:
            return train_num
        if not sample_box:
            sample_box.append(hash_sample(train_num, [ROW_ID], fit_sample_rows, seed=0))
        return sample_box[0]

    rows: list[dict] = []
    scoring: list[tuple] = []
    generated: list[tuple] = []
    try:
        for m in methods:
            sent = len(rows)
            method = resolve_method(m)
            head = dict(key=ds.name, method=method.name, task=task)
            if not narrow:
                head.update(fold_id=FOLD_ID, protocol=PROTOCOL)

            def generate():
                t0 = time.time()
                sample = fit_sample()
                # methods know two tasks; classes beyond two don't concern them
                fitted = method.fit(sample, ds.target, task if task == "regression" else "classification")
                t1 = time.time()
                # checkpoint: generated folds are re-read by every family and
                # joined to their own derivatives; this cuts lineage and
                # survives executor loss
                tr = fitted.transform(train_num).checkpoint(eager=True)
                te = fitted.transform(test_num).checkpoint(eager=True)
                t2 = time.time()
                return tr, te, t1 - t0, t2 - t1, getattr(fitted, "n_candidates_", None)

            try:
                tr, te, fit_s, tf_s, n_cand = run_with_budget(spark, generate, budget_seconds)
            except BudgetExceeded as exc:
                rows.append(dict(head, status="timeout", gen_elapsed_s=budget_seconds,
                                 error=str(exc)))
                if on_rows is not None:
                    on_rows(rows[sent:])
                continue
            except Exception as exc:  # noqa: BLE001 -- a failing method is a row
                rows.append(dict(head, status="error", error=str(exc)))
                if on_rows is not None:
                    on_rows(rows[sent:])
                continue
            head.update(status="ok", gen_elapsed_s=fit_s + tf_s)
            if not narrow:
                head.update(fit_elapsed_s=fit_s, transform_elapsed_s=tf_s, n_candidates=n_cand)
            try:
                gen_cols = [c for c in tr.columns if c not in keep]
                missing = [c for c in gen_cols if c not in te.columns]
                if missing:
                    raise ValueError(f"transformed test fold lacks columns {missing[:5]}")
                te_al = te.select(*keep, *gen_cols)
                head["feature_efficiency"] = feature_efficiency(tr, feats, gen_cols, ds.target, task)
                n_gen = len(gen_cols) - len(feats)
                for family in model_families:
                    scoring.append((dict(head, model_family=family, n_features_generated=n_gen,
                                         n_features_final=len(gen_cols)), family, tr, te_al, gen_cols))
                generated.append((tr, te))
            except Exception as exc:  # noqa: BLE001
                rows.append(dict(head, status="error", error=str(exc)))
            if on_rows is not None:
                rows += _score_all(spark, scoring, task, ds.target, tree_rounds, max_parallel)
                scoring.clear()
                on_rows(rows[sent:])
        rows += _score_all(spark, scoring, task, ds.target, tree_rounds, max_parallel)
    finally:
        train_num.unpersist()
        test_num.unpersist()
        split.unpersist()
    return rows


def _score_all(spark, scoring, task, target, tree_rounds, max_parallel) -> list[dict]:
    from concurrent.futures import ThreadPoolExecutor

    def one(item):
        row, family, tr, te, gen_cols = item
        try:
            fam = fit_family_input(family, tr, gen_cols)
            score = fit_and_score(family, task, fam.transform(tr), fam.transform(te), gen_cols,
                                  target, ROW_ID, tree_rounds=tree_rounds)
            return dict(row, **score)
        except Exception as exc:  # noqa: BLE001 -- a failing model is a row
            out = {k: v for k, v in row.items()
                   if k not in ("n_features_generated", "n_features_final")}
            return dict(out, status="model_error", error=str(exc))

    if not scoring:
        return []
    with ThreadPoolExecutor(max_workers=max(1, min(max_parallel, len(scoring)))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(one), item) for item in scoring]
        return [job.result() for job in jobs]


def _pending(spark: SparkSession, datasets: list[Dataset], methods, out_dir: str | None, resume: bool,
             retry_failed: bool) -> dict[str, list]:
    """Methods still to run, by dataset."""
    named = [(resolve_method(m).name, m) for m in methods]
    if not (out_dir and resume):
        return {ds.name: list(methods) for ds in datasets}
    pairs = spark.createDataFrame([(ds.name, name) for ds in datasets for name, _ in named],
                                  "key string, method string")
    left = {tuple(r) for r in pending_pairs(pairs, read_results(spark, out_dir), retry_failed)
            .select("key", "method").collect()}
    return {ds.name: [m for name, m in named if (ds.name, name) in left] for ds in datasets}


#: datasets of a sweep that run at the same time
DATASETS_AT_ONCE = 2


def _sweep(spark: SparkSession, todo: list[Dataset], run_one, at_once: int) -> list[list[dict]]:
    """``run_one(ds)`` for all datasets in order, ``at_once`` at a time, the jobs of each
    in a scheduler pool of its own (with ``spark.scheduler.mode=FAIR`` pools share the
    cores evenly, so that a large dataset doesn't hold up the small ones)."""
    from concurrent.futures import ThreadPoolExecutor

    def pooled(ds: Dataset):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"dataset-{ds.name}")
        try:
            return run_one(ds)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if at_once <= 1 or len(todo) <= 1:
        return [run_one(ds) for ds in todo]
    with ThreadPoolExecutor(max_workers=min(at_once, len(todo))) as pool:
        # wrapped one by one: each thread has local properties of its own
        jobs = [pool.submit(inheritable_thread_target(spark)(pooled), ds) for ds in todo]
        return [job.result() for job in jobs]


def run_benchmark(spark: SparkSession, datasets: list[Dataset], methods, out_dir: str,
                  model_families=MODEL_FAMILIES, resume: bool = True, retry_failed: bool = False,
                  datasets_at_once: int = DATASETS_AT_ONCE, **kw) -> tuple[int, str]:
    """Every pending (dataset, method) pair: one split and preparation per
    dataset, rows stored per pair."""
    pending = _pending(spark, datasets, methods, out_dir, resume, retry_failed)

    def one(ds: Dataset) -> list[dict]:
        return run_dataset(
            spark, ds, pending[ds.name], model_families,
            on_rows=lambda rows: append_results(rows_to_frame(spark, rows), out_dir), **kw)

    todo = [ds for ds in datasets if pending[ds.name]]
    return sum(map(len, _sweep(spark, todo, one, datasets_at_once))), out_dir


@dataclass
class CompareResult:
    rows: list[dict]
    spark: SparkSession

    def to_frame(self) -> DataFrame:
        return rows_to_frame(self.spark, self.rows)

    def summary(self) -> DataFrame:
        """Scores by family, dataset and method with a mean row (no key) per family and
        method, status ``ok``; then the failures: dataset, method, status and ``count``."""
        from .report import summary_with_failures

        return summary_with_failures(self.to_frame())

    def __repr__(self) -> str:
        rows = self.summary().orderBy("model_family", F.col("key").isNull(), "key", "method", "status").collect()
        scores = [r for r in rows if r["status"] == "ok"]
        failed = [r for r in rows if r["status"] != "ok"]
        out = [f"{'family':8} {'dataset':24} {'method':20} score"] if scores else ["No pair has a score."]
        out += [f"{r['model_family'] or '':8} {r['key'] or '(mean)':24} {r['method']:20} "
                f"{'' if r['value'] is None else format(r['value'], '.4f')}" for r in scores]
        if failed:
            out += ["Failures"] + [f"{r['key']:24} {r['method']:20} {r['status']}, {r['count']} times" for r in failed]
        return "\n".join(out)


def _as_dataset(item) -> Dataset:
    """A :class:`Dataset`, or ``(name, df, target[, task])`` without a row key."""
    if isinstance(item, Dataset):
        return item
    name, df, target, *task = item
    return keyless_dataset(name, df, target, *task)


def compare(spark: SparkSession, methods, datasets: list | None = None,
            model_families=MODEL_FAMILIES, budget_seconds: float | None = None,
            out_dir: str | None = None, resume: bool = True, retry_failed: bool = False,
            datasets_at_once: int = DATASETS_AT_ONCE, **kw) -> CompareResult:
    """Run methods (or ``(name, method)`` pairs) on user datasets: :class:`Dataset`
    objects, or ``(name, df, target[, task])`` tuples for tables without a row key."""
    if not datasets:
        raise ValueError("compare() needs at least one dataset")
    datasets = [_as_dataset(d) for d in datasets]
    pending = _pending(spark, datasets, methods, out_dir, resume, retry_failed)
    store = (lambda rows: append_results(rows_to_frame(spark, rows), out_dir)) if out_dir else None
    found = _sweep(spark, [ds for ds in datasets if pending[ds.name]], lambda ds: run_dataset(
        spark, ds, pending[ds.name], model_families, budget_seconds=budget_seconds, narrow=True, on_rows=store,
        **kw), datasets_at_once)
    rows = [r for part in found for r in part]
    if out_dir:
        rows = [r.asDict() for r in read_results(spark, out_dir).collect()]
    return CompareResult(rows, spark)
