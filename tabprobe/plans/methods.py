"""The feature-method contract and the shipped no-op baseline.

A method is fitted on the prepared training fold and
returns a fitted transform, a DataFrame -> DataFrame function that keeps
every input column and may add numeric ones.  Because the transform is
plain DataFrame code, Catalyst sees through it: generated columns are
pruned, pushed and code-generated with the rest of the plan.

Three ways to supply one:

* an object with ``name`` and ``fit(train, target, task) -> Fitted`` where
  ``Fitted.transform(df) -> df`` (optionally ``n_candidates_``);
* a plain function ``fn(train, test, target, task) -> (train_new, test_new)``
  wrapped by :func:`function_method`;
* pandas code wrapped by :class:`PandasMethod`: a state that grows batch by batch
  and merges, and a transform of Arrow batches;

and any of them as ``(name, method)`` to set the name it is reported under.
"""

from __future__ import annotations

import pickle
from typing import Any, Callable, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fitted(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


class Method(Protocol):
    name: str

    def fit(self, train: DataFrame, target: str, task: str) -> Fitted: ...


class _Identity:
    n_candidates_ = None

    def transform(self, df: DataFrame) -> DataFrame:
        return df


class BaselineMethod:
    """No feature engineering: the prepared features unchanged."""
    name = "baseline"

    def fit(self, train: DataFrame, target: str, task: str) -> Fitted:
        return _Identity()


METHODS: dict[str, type] = {"baseline": BaselineMethod}


class _FunctionFitted:
    n_candidates_ = None

    def __init__(self, fn, train, target, task):
        self.fn, self.train, self.target, self.task = fn, train, target, task

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.fn(self.train, df, self.target, self.task)
        if not (isinstance(out, tuple) and len(out) == 2):
            raise TypeError("a function method must return (train_new, test_new)")
        return out[1]


class function_method:  # noqa: N801 -- reads as an adapter
    """Adapt ``fn(train, test, target, task) -> (train_new, test_new)``.

    ``fit`` keeps the fit sample; every ``transform`` re-invokes ``fn`` with
    that sample as the training side, so state is always train-derived.
    """

    def __init__(self, fn: Callable, name: str | None = None):
        self.fn = fn
        self.name = name or getattr(fn, "__name__", "function")

    def fit(self, train: DataFrame, target: str, task: str) -> Fitted:
        return _FunctionFitted(self.fn, train, target, task)


#: states that are merged by one task, or by the driver at the end
MERGE_FAN_IN = 16


class PandasMethod:
    """Pandas logic that has no DataFrame expression, fitted on all training rows.

    ``start() -> state`` and ``add(state, pdf, target, task) -> state`` run over the
    Arrow batches of each partition; ``merge(left, right) -> state`` joins the
    states of partitions in a tree of tasks, ``MERGE_FAN_IN`` at a time and in the
    order of the partitions; ``finish(state, target, task)`` (default: the state as
    it is) gives what ``transform_pandas(pdf, state) -> pdf`` gets on the executors,
    which must add the columns listed in ``new_columns`` (all double).  No task and
    no driver holds more rows than a batch, or more than ``MERGE_FAN_IN`` states.
    """

    def __init__(self, name: str, start: Callable[[], Any], add: Callable, merge: Callable,
                 transform_pandas: Callable, new_columns: list[str], finish: Callable | None = None):
        self.name, self.start, self.add, self.merge, self.finish = name, start, add, merge, finish
        self.transform_pandas, self.new_columns = transform_pandas, list(new_columns)

    def fit(self, train: DataFrame, target: str, task: str) -> Fitted:
        start, add, merge = self.start, self.add, self.merge

        def partition_state(batches):
            from pyspark import TaskContext

            state = start()
            for pdf in batches:
                state = add(state, pdf, target, task)
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]})

        def merged(pdf: pd.DataFrame) -> pd.DataFrame:
            ordered = pdf.sort_values("slot")
            states = [pickle.loads(s) for s in ordered["state"]]
            state = states[0]
            for other in states[1:]:
                state = merge(state, other)
            return pd.DataFrame({"slot": [ordered["slot"].iloc[0] // MERGE_FAN_IN], "state": [pickle.dumps(state)]})

        states, schema = train.mapInPandas(partition_state, "slot long, state binary"), "slot long, state binary"
        left = train.rdd.getNumPartitions()
        while left > MERGE_FAN_IN:
            states = states.groupBy(F.floor(F.col("slot") / MERGE_FAN_IN)).applyInPandas(merged, schema)
            left = -(-left // MERGE_FAN_IN)
        rows = sorted((r["slot"], r["state"]) for r in states.collect())
        state = pickle.loads(rows[0][1]) if rows else start()
        for _, other in rows[1:]:
            state = merge(state, pickle.loads(other))
        return _PandasFitted(self, state if self.finish is None else self.finish(state, target, task))


class SampledPandasMethod(PandasMethod):
    """``fit_pandas(pdf, target, task) -> state`` on the ``fit_rows`` training rows
    first by row hash, for logic that has no mergeable state; the driver holds them."""

    def __init__(self, name: str, fit_pandas: Callable, transform_pandas: Callable, new_columns: list[str], *,
                 fit_rows: int):
        self.name, self.fit_pandas, self.fit_rows = name, fit_pandas, fit_rows
        self.transform_pandas, self.new_columns = transform_pandas, list(new_columns)

    def fit(self, train: DataFrame, target: str, task: str) -> Fitted:
        sample = train.orderBy(F.xxhash64(*train.columns)).limit(self.fit_rows)
        return _PandasFitted(self, self.fit_pandas(sample.toPandas(), target, task))


class _Named:
    """A method under another name."""

    def __init__(self, name: str, method: Method):
        self.name, self.method = name, method

    def fit(self, train: DataFrame, target: str, task: str) -> Fitted:
        return self.method.fit(train, target, task)


class _PandasFitted:
    n_candidates_ = None

    def __init__(self, m: PandasMethod, state):
        self.m, self.state = m, state

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.sql import types as T

        schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType())
                                                  for c in self.m.new_columns])
        fn, state, cols = self.m.transform_pandas, self.state, schema.fieldNames()

        def run(batches):
            for pdf in batches:
                yield fn(pdf, state)[cols]
        return df.mapInPandas(run, schema)


def resolve_method(m) -> Method:
    """A method object, a class, a registered name, a plain function, or one of
    these as ``(name, method)``."""
    if isinstance(m, tuple):
        name, method = m
        return _Named(name, resolve_method(method))
    if isinstance(m, str):
        if m in METHODS:
            return METHODS[m]()
        raise KeyError(f"unknown method {m!r}; built-ins are {sorted(METHODS)}")
    if isinstance(m, type):
        return m()
    if hasattr(m, "fit") and hasattr(m, "name"):
        return m
    if callable(m):
        return function_method(m)
    raise TypeError(f"not a method: {m!r}")
