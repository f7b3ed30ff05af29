"""Gradient-boosted trees over binned features (second-order, grown level by level).

Features are binned once, at up to ``VALUE_BINS`` quantiles of the training fold; a
missing value has a bin of its own, and every split learns which side it goes to, so
nothing is filled in.  The binned training fold is written once, in blocks of one
byte per value.

A level of a tree needs, per node and feature, the sums of gradients and hessians by
bin.  Beyond ``ONE_TASK_BYTES`` of binned features (counted) every level is a Spark
job: each task adds up its own blocks, the sums are added by (node, feature, bin), a
task per (node, feature) finds the best split there, and one row for each comes
back.  Scores so far are kept with the blocks and written anew every ``interval``
rounds; the rounds since are applied again in the task, so a lost executor costs no
more than its tasks and lineage stays short.  A fold within the bound is one
task's work, where the same sums are taken in memory and no round waits for a job.
Gradients are rounded to a fixed grid, so sums don't depend on their order and both
ways grow the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUE_BINS = 254
BINS = VALUE_BINS + 2  # the missing ones are bin 0
#: binned features up to this size are one task's work
ONE_TASK_BYTES = 32 << 20
#: rows of a block
BLOCK_ROWS = 1 << 16
#: rounds after which scores are written
INTERVAL = 20
MIN_ROWS, MIN_HESSIAN = 20, 1e-3
#: gradients are multiples of this
GRID = 2.0 ** -24


@dataclass
class Tree:
    """A full binary tree as arrays; feature -1 marks a leaf."""
    feature: np.ndarray
    cut: np.ndarray           # bins up to this one go left
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Node that each row (a column of ``bins``) reaches in ``depth`` steps at most."""
        at = np.zeros(bins.shape[1], np.int64)
        rows = np.arange(bins.shape[1])
        for _ in range(depth):
            f = self.feature[at]
            b = bins[np.maximum(f, 0), rows]
            left = np.where(b == 0, self.missing_left[at], b <= self.cut[at])
            at = np.where(f < 0, at, 2 * at + 2 - left)
        return at


@dataclass
class Forest:
    features: list[str]
    borders: list[np.ndarray]
    task: str                       # regression, binary or multiclass
    base: np.ndarray                # one score per output
    rate: float
    depth: int
    scale: float = 1.0              # regression targets are divided by it
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(columns), len(columns[0]) if columns else 0), np.uint8)
        for i, (x, borders) in enumerate(zip(columns, self.borders)):
            missing = ~np.isfinite(x)
            out[i] = np.searchsorted(borders, np.where(missing, 0.0, x), side="left") + 1
            out[i][missing] = 0
        return out

    def add(self, scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
        for trees in rounds:
            for k, tree in enumerate(trees):
                scores[k] += tree.value[tree.nodes(bins, self.depth)]
        return scores

    def outputs(self, scores: np.ndarray) -> np.ndarray:
        """Predictions, or a probability per class, from scores (outputs by rows)."""
        if self.task == "regression":
            return scores * self.scale
        if self.task == "binary":
            p = 1 / (1 + np.exp(-np.clip(scores[0], -500, 500)))
            return np.stack([1 - p, p])
        e = np.exp(scores - scores.max(axis=0))
        return e / e.sum(axis=0)

    def gradients(self, scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.task == "regression":
            g, h = scores - y, np.ones_like(scores)
        else:
            p = self.outputs(scores)
            p = p[1:] if self.task == "binary" else p
            classes = np.array([1]) if self.task == "binary" else np.arange(len(p))
            g, h = p - (y[None, :] == classes[:, None]), np.maximum(p * (1 - p), 1e-16)
        return np.rint(g / GRID) * GRID, np.rint(h / GRID) * GRID

    def scored(self, df: DataFrame, keep: list[str], out: str) -> DataFrame:
        """``keep`` columns and ``out``: the prediction, or the array of probabilities."""
        kind = "double" if self.task == "regression" else "array<double>"
        schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out}` {kind}"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = self.binned(_columns(batch, len(keep)))
                scores = np.repeat(self.base[:, None], batch.num_rows, axis=1)
                got = self.outputs(self.add(scores, bins, self.rounds))
                col = pa.array(got[0]) if self.task == "regression" else pa.array(
                    list(np.ascontiguousarray(got.T)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], col], [*keep, out])

        return df.select(*keep, *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(self.features)]) \
            .mapInArrow(run, schema)


def _columns(batch: pa.RecordBatch, first: int) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[first:]]


def histogram(bins: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(node, feature, bin, [gradients, hessians, rows]); rows with node -1 don't count."""
    here = node >= 0
    slot = node[here] * BINS
    g, h = g[here], h[here]
    out = np.empty((n_nodes, len(bins), BINS, 3))
    for f in range(len(bins)):
        at = slot + bins[f][here]
        for k, w in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(at, w, n_nodes * BINS).reshape(n_nodes, BINS)
    return out


def best_splits(hist: np.ndarray) -> np.ndarray:
    """Per (node, feature): gain, cut and whether missing values go left."""
    total = hist.sum(axis=2)                                # node, feature, 3
    below = np.cumsum(hist[:, :, 1:], axis=2)[:, :, :-1]    # values of bins up to the cut
    best = np.full((*hist.shape[:2], 3), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = total[..., 0] ** 2 / total[..., 1]
        for missing_left in (True, False):
            left = below + hist[:, :, :1] if missing_left else below
            right = total[:, :, None] - left
            gain = left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - whole[:, :, None]
            valid = (np.minimum(left[..., 2], right[..., 2]) >= MIN_ROWS) & \
                (np.minimum(left[..., 1], right[..., 1]) >= MIN_HESSIAN)
            gain = np.where(valid, gain, -np.inf)
            cut = gain.argmax(axis=2)
            top = np.take_along_axis(gain, cut[:, :, None], axis=2)[:, :, 0]
            better = top > best[..., 0]
            best[better] = np.stack([top, cut + 1, np.full_like(top, missing_left)], axis=2)[better]
    return best


def grow(tree: Tree, first: int, splits: np.ndarray, totals: np.ndarray, rate: float, last: bool) -> bool:
    """Split the nodes from ``first`` on by (gain, cut, missing left) per node and feature;
    whether any node was split."""
    split = False
    for i, total in enumerate(totals):
        node = first + i
        if not total[2]:
            continue
        tree.value[node] = -rate * total[0] / max(total[1], MIN_HESSIAN)
        if last:
            continue
        f = int(splits[i, :, 0].argmax())
        gain, cut, left = splits[i, f]
        if gain > 1e-12:
            tree.feature[node], tree.cut[node], tree.missing_left[node] = f, int(cut), bool(left)
            split = True
    return split


def _level(forest: Forest, tree: Tree, level: int, bins: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each row among the level's nodes, -1 if it ended above; their number."""
    n = 2 ** level
    node = tree.nodes(bins, level) - (n - 1)
    return node, n


def train_in_task(forest: Forest, bins: np.ndarray, y: np.ndarray, n_rounds: int) -> Forest:
    scores = np.repeat(forest.base[:, None], len(y), axis=1)
    for _ in range(n_rounds):
        g, h = forest.gradients(scores, y)
        trees = []
        for k in range(len(forest.base)):
            tree = Tree.empty(forest.depth)
            for level in range(forest.depth + 1):
                node, n = _level(forest, tree, level, bins)
                last = level == forest.depth
                hist = histogram(bins[:1] if last else bins, node, n, g[k], h[k])
                if not grow(tree, n - 1, best_splits(hist) if not last else None, hist[:, 0].sum(axis=1),
                            forest.rate, last):
                    break
            trees.append(tree)
        forest.add(scores, bins, [trees])
        forest.rounds.append(trees)
    return forest


_BLOCK = "bins binary, y binary, scores binary"


def _blocks(df: DataFrame, forest: Forest, label: str) -> DataFrame:
    """The binned fold: bins (features by rows), label and starting scores of a block of rows."""
    n_out = len(forest.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block():
            bins = np.concatenate([b for b, _ in held], axis=1)
            y = np.concatenate([v for _, v in held])
            scores = np.repeat(forest.base[:, None], len(y), axis=1)
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
                                               for x in (bins, y, scores)], ["bins", "y", "scores"])

        for batch in batches:
            if batch.num_rows:
                held.append((forest.binned(_columns(batch, 1)),
                             batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64) / forest.scale))
                size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    assert n_out
    return df.select(F.col(label).cast("double").alias("__y"),
                     *[F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(forest.features)]) \
        .mapInArrow(run, _BLOCK).checkpoint()


def _opened(batch: pa.RecordBatch, n_features: int, n_out: int):
    for cells in zip(*batch.columns):
        bins, y, scores = (c.as_py() for c in cells)
        y = np.frombuffer(y)
        yield (np.frombuffer(bins, np.uint8).reshape(n_features, len(y)), y,
               np.frombuffer(scores).reshape(n_out, len(y)).copy())


def _train_by_jobs(forest: Forest, blocks: DataFrame, n_rounds: int, interval: int) -> Forest:
    n_features, n_out = len(forest.features), len(forest.base)
    written = 0  # rounds that the blocks' scores hold

    def sums(trees: list[Tree], level: int, growing: list[int]):
        since = forest.rounds[written:]
        features = n_features if level < forest.depth else min(1, n_features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 2 ** level
            total = np.zeros((len(growing), n, features, BINS, 3))
            for batch in batches:
                for bins, y, scores in _opened(batch, n_features, n_out):
                    g, h = forest.gradients(forest.add(scores, bins, since), y)
                    for i, k in enumerate(growing):
                        node, _ = _level(forest, trees[k], level, bins)
                        total[i] += histogram(bins[:features], node, n, g[k], h[k])
            i, node, f, b = np.nonzero(total[..., 2])
            cells = total[i, node, f, b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(growing, np.int32)[i]), *(pa.array(x.astype(np.int32)) for x in (node, f, b)),
                 *(pa.array(np.ascontiguousarray(cells[:, c])) for c in range(3))],
                ["k", "node", "f", "b", "g", "h", "n"])

        return blocks.mapInArrow(run, "k int, node int, f int, b int, g double, h double, n double") \
            .groupBy("k", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        hist = np.zeros((1, 1, BINS, 3))
        hist[0, 0, pdf["b"]] = pdf[["g", "h", "n"]]
        gain, cut, left = best_splits(hist)[0, 0]
        g, h, n = hist[0, 0].sum(axis=0)
        return pd.DataFrame([[pdf["k"].iloc[0], pdf["node"].iloc[0], pdf["f"].iloc[0], gain, cut, left, g, h, n]],
                            columns=["k", "node", "f", "gain", "cut", "missing_left", "g", "h", "n"])

    for _ in range(n_rounds):
        trees = [Tree.empty(forest.depth) for _ in range(n_out)]
        growing = list(range(n_out))
        for level in range(forest.depth + 1):
            n, last = 2 ** level, level == forest.depth
            rows = sums(trees, level, growing).groupBy("k", "node", "f").applyInPandas(
                best, "k int, node int, f int, gain double, cut double, missing_left double, g double, h double, "
                      "n double").collect()
            splits = np.full((n_out, n, n_features, 3), -np.inf)
            totals = np.zeros((n_out, n, 3))
            for r in rows:
                splits[r["k"], r["node"], r["f"]] = r["gain"], r["cut"], r["missing_left"]
                totals[r["k"], r["node"]] = r["g"], r["h"], r["n"]
            growing = [k for k in growing if grow(trees[k], n - 1, splits[k], totals[k], forest.rate, last)]
            if not growing:
                break
        forest.rounds.append(trees)
        if len(forest.rounds) - written == interval and len(forest.rounds) < n_rounds:
            since = forest.rounds[written:]

            def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    new = [forest.add(scores, bins, since).tobytes()
                           for bins, _, scores in _opened(batch, n_features, n_out)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(new, pa.binary())], batch.schema.names)

            blocks, written = blocks.mapInArrow(update, _BLOCK).checkpoint(), len(forest.rounds)
    return forest


def fit_trees(train: DataFrame, features: list[str], label: str, task: str, n_classes: int = 2, *, rounds: int = 200,
              depth: int = 5, rate: float = 0.1, one_task_bytes: int = ONE_TASK_BYTES,
              interval: int = INTERVAL) -> Forest:
    """Trees on the rows of ``train`` with a ``label``: a number for ``regression``, else
    the class code 0, 1, ... (two classes: logistic loss; more: softmax, a tree per class
    and round)."""
    train = train.where(F.col(label).isNotNull())
    y = F.col(label).cast("double")
    asked = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd")]
    asked += [F.sum((y == k).cast("long")).alias(f"c{k}") for k in range(n_classes)] if task != "regression" else []
    steps = [(i + 1) / (VALUE_BINS + 1) for i in range(VALUE_BINS)]
    asked += [F.percentile_approx(F.col(c).cast("double"), steps, 10_000).alias(f"q{i}") for i, c in enumerate(features)]
    row = train.agg(*asked).first()
    n = max(row["n"], 1)
    borders = [np.unique(np.array(row[f"q{i}"] or [], np.float64)) for i in range(len(features))]
    if task == "regression":
        scale = row["sd"] or 1.0
        forest = Forest(features, borders, task, np.array([(row["mean"] or 0.0) / scale]), rate, depth, scale)
    else:
        share = np.clip(np.array([row[f"c{k}"] or 0 for k in range(n_classes)], np.float64) / n, 1e-9, 1 - 1e-9)
        binary = n_classes <= 2
        base = np.log(share[-1:] / (1 - share[-1:])) if binary else np.log(share)
        forest = Forest(features, borders, "binary" if binary else "multiclass", base, rate, depth)
    if not row["n"] or not features:
        return forest
    blocks = _blocks(train, forest, label)
    if n * (len(features) + 8 * (1 + len(forest.base))) > one_task_bytes:
        return _train_by_jobs(forest, blocks, rounds, interval)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [x for batch in batches for x in _opened(batch, len(features), len(forest.base))]
        if opened:
            bins, labels = np.concatenate([b for b, _, _ in opened], axis=1), np.concatenate([v for _, v, _ in opened])
            done = train_in_task(forest, bins, labels, rounds)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(done.rounds)], pa.binary())], ["trees"])

    # the fold is within one_task_bytes
    forest.rounds = pickle.loads(blocks.coalesce(1).mapInArrow(run, "trees binary").first()["trees"])
    return forest
