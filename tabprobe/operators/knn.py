"""Exact k-nearest-neighbour search (Euclidean).

Train vectors of at most ``BROADCAST_BYTES`` (counted first) are sent to every
task and the test rows stream past them, unless that makes more than
``STREAM_PAIRS`` pairs: no row of either side is copied, and nothing but the test
rows is shuffled.

Beyond these bounds the train rows are laid out by pivots, a few of their own
vectors.  A row belongs to its nearest pivot, there to a ring of distances from
it, and a ring of many rows is dealt over several units by hash, so that a unit
holds about ``block_rows`` rows even where all vectors are equal.  Units of
neighbouring pivots are put together into slabs of at most ``SLAB_BYTES``, which
are what a task reads.  A test row

1. visits the slab of the unit around its nearest pivot that lies closest, which
   gives it k train rows and their largest distance t (pivots and rings alone
   give an upper bound too, and the smaller one counts);
2. then only the slabs with a unit that may hold a row within t: by the triangle
   inequality a row of a ring (lo, hi) around pivot p is no nearer than
   ``d(q, p) - hi`` and ``lo - d(q, p)``, and as it is nearer to p than to the test
   row's own pivot a, no nearer than ``(d(q, p)^2 - d(q, a)^2) / (2 d(a, p))``.

In a slab the same bounds, which shrink as rows are found, leave out units.  A test
row is copied at most once per slab, and a slab once per some thousands of its
visitors, so that the rows sent are few even where no bound helps (many features)
and all pairs must be looked at.  Each (slab, part of its visitors) is one group of
``applyInPandas``, emitting at most k rows per visitor, none beyond t; a window over
these keeps the final k.

Both ways give the same rows; ties go to the smaller train id.  No row pair is
ever a Spark row, and work per task is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = 10
BLOCK_ROWS = 2048
#: train vectors up to this size are broadcast
BROADCAST_BYTES = 64 << 20
#: pairs of rows looked at without any bound
STREAM_PAIRS = 1 << 30
#: train vectors that a task holds, and rows of either side
SLAB_BYTES, SLAB_ROWS = 8 << 20, 1 << 16
#: train rows compared at once in a slab, and test rows a group has at least
CHUNK_ROWS, MIN_VISITORS = 2048, 1024
#: distances held at once
TILE_CELLS = 1 << 22
#: bounds of what is sent to every task: pivots (also by ``PIVOT_BYTES``), rings of
#: each, and units of all (beyond that, units of more rows)
MAX_PIVOTS, PIVOT_BYTES, RINGS, MAX_UNITS = 1024, 8 << 20, 16, 1 << 15
_LOCATED = "id long, x array<double>, pivot int, d double"
_CANDIDATE = "qid long, rid long, dist double"


def _top(A: np.ndarray, rid: np.ndarray, B: np.ndarray, k: int,
         within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of B nearest to each row of A, nearest first, or those of them
    ``within`` its bound: row of A, rank from 0, id, distance."""
    kk = min(k, len(B))
    a2 = (A * A).sum(1)
    b2 = (B * B).sum(1)
    d2 = A @ B.T
    d2 *= -2.0
    d2 += a2[:, None]
    d2 += b2[None, :]
    # fast distances only pick candidates (with a rounding margin);
    # exact distances of the candidates decide, ties by train id
    tol = 1e-9 * (a2 + b2.max()) + 1e-12
    near = None
    if within is not None:
        near = d2 <= (within * within * (1 + 1e-9) + tol)[:, None]
        if np.count_nonzero(near) > 4 * k * len(A):
            near = None
    if near is None:
        near = d2 <= (np.partition(d2, kk - 1, axis=1)[:, kk - 1] + tol)[:, None]
    rows, cols = np.nonzero(near)
    diff = B[cols] - A[rows]
    exact = np.sqrt((diff * diff).sum(1))
    order = np.lexsort((rid[cols], exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(A)))[rows]
    keep = rank < kk
    return rows[keep], rank[keep], rid[cols[keep]], exact[keep]


def _nearest(qid: np.ndarray, A: np.ndarray, rid: np.ndarray, B: np.ndarray, k: int) -> pd.DataFrame:
    """The k rows of B nearest to each row of A, nearest first."""
    rows, rank, ids, dist = _top(A, rid, B, k)
    return pd.DataFrame({"qid": qid[rows], "nn_rank": (rank + 1).astype("int32"), "rid": ids, "dist": dist})


def _vectors(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["id"].to_numpy().astype("int64"), np.stack(pdf["x"].to_numpy()).astype("float64")


def _streamed(tr: DataFrame, te: DataFrame, k: int, n_test: int) -> DataFrame:
    """Test rows past the broadcast train vectors."""
    sc = tr.sparkSession.sparkContext
    sent = sc.broadcast(_vectors(tr.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rid, B = sent.value
        step = max(1, TILE_CELLS // len(B))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                yield _nearest(*_vectors(pdf.iloc[s:s + step]), rid, B, k)

    parts = max(min(sc.defaultParallelism, n_test), math.ceil(n_test / (1 << 20)))
    return te.repartition(parts, "id").mapInPandas(run, "qid long, nn_rank int, rid long, dist double")


def _distances(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    """Distances of all rows of A to all of B, to rounding of the fast formula."""
    d2 = (A * A).sum(1)[:, None] + (B * B).sum(1)[None, :] - 2.0 * (A @ B.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _exact(A: np.ndarray, B: np.ndarray) -> np.ndarray:
    return np.sqrt(((A - B) ** 2).sum(1))


def _pivots(tr: DataFrame, want: int) -> np.ndarray:
    """Different train vectors, the first by hash, neighbours side by side."""
    rows = tr.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(want).collect()
    return _side_by_side(np.unique(np.array([r["x"] for r in rows], np.float64), axis=0))


def _side_by_side(P: np.ndarray) -> np.ndarray:
    """Rows halved again and again across the feature of the largest spread."""
    if len(P) <= 2:
        return P
    P = P[np.argsort(P[:, np.ptp(P, axis=0).argmax()], kind="stable")]
    return np.concatenate([_side_by_side(P[:len(P) // 2]), _side_by_side(P[len(P) // 2:])])


def _located(side: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of every row and the distance to it."""
    sent = side.sparkSession.sparkContext.broadcast(pivots)
    least = np.lexsort(pivots.T[::-1])[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        P = sent.value
        step = max(1, TILE_CELLS // len(P))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                ids, X = _vectors(part)
                # vectors with missing values go to the pivot of the smallest numbers
                at = np.where(np.isnan(X).any(axis=1), least, _distances(X, P).argmin(axis=1))
                yield pd.DataFrame({"id": ids, "x": part["x"].to_numpy(), "pivot": at.astype("int32"),
                                    "d": _exact(X, P[at])})

    return side.mapInPandas(run, _LOCATED)


class Layout:
    """Units of the train rows (pivot, ring bounds and number of rows of each), the
    slabs they form, and what they say about a test row."""

    def __init__(self, pivots: np.ndarray, units: np.ndarray, k: int, slab_rows: int):
        self.pivots, self.k = pivots, k
        self.pivot = units[:, 0].astype(int)
        self.lo, self.hi, self.rows = units[:, 1], units[:, 2], units[:, 3]
        between = _distances(pivots, pivots)
        np.fill_diagonal(between, 1.0)
        self.between = np.maximum(between, 1e-300)
        # first unit of every slab, and the slab of every unit
        self.first, held = [0], 0
        for u, n in enumerate(self.rows):
            if held and held + n > slab_rows:
                self.first.append(u)
                held = 0
            held += n
        self.slab = np.searchsorted(self.first, np.arange(len(units)), side="right") - 1
        self.slab_rows = np.add.reduceat(self.rows, self.first).astype(int)
        # per pivot: a radius that holds k of its rows
        self.radius = np.full(len(pivots), np.inf)
        for p in range(len(pivots)):
            of = np.flatnonzero(self.pivot == p)
            of = of[np.argsort(self.hi[of])]
            enough = np.flatnonzero(np.cumsum(self.rows[of]) >= k)
            if len(enough):
                self.radius[p] = self.hi[of[enough[0]]]

    def bounds(self, X: np.ndarray, slab: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per row: an upper bound of its k-th distance, and for every unit (of the
        slab) a lower bound of the distance to its rows (both with a rounding margin)."""
        end = [*self.first, len(self.pivot)]
        of = slice(None) if slab is None else slice(end[slab], end[slab + 1])
        to = _distances(X, self.pivots)
        a = to.argmin(axis=1)
        own = to[np.arange(len(X)), a]
        slack = 1e-6 * (np.sqrt((X * X).sum(1)) + np.sqrt((self.pivots ** 2).sum(1)).max()) + 1e-12
        upper = (to + self.radius[None, :]).min(axis=1) + slack
        plane = (to ** 2 - own[:, None] ** 2) / (2 * self.between[a])
        plane[np.arange(len(X)), a] = 0.0
        here = to[:, self.pivot[of]]
        lower = np.maximum(np.maximum(here - self.hi[of], self.lo[of] - here), plane[:, self.pivot[of]])
        # a test row with a missing value has no bounds and visits no unit
        lower = lower - slack[:, None]
        return np.where(np.isnan(upper), np.inf, upper), np.where(np.isnan(lower), np.inf, lower)

    def search(self, slab: int, X: np.ndarray, upper: np.ndarray, rid: np.ndarray, B: np.ndarray,
               unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of X, id, distance: the k rows of the slab (vectors B in ``unit``)
        nearest to each row of X, without such beyond ``upper``."""
        k = self.k
        ids = np.full((len(X), k), np.iinfo("int64").max)
        far = np.full((len(X), k), np.inf)
        bound = upper.copy()
        # units with a missing value are left out
        missing = np.unique(unit[np.isnan(B).any(axis=1)])
        order = np.argsort(unit, kind="stable")
        at = np.searchsorted(unit[order], self.first[slab] + np.arange(np.count_nonzero(self.slab == slab) + 1))
        step = max(1, TILE_CELLS // max(CHUNK_ROWS, len(self.pivots), len(at)))
        for s in range(0, len(X), step):
            part = slice(s, s + step)
            lower = self.bounds(X[part], slab)[1]
            # nearest units first, some thousand rows at a time
            nearest = lower.min(axis=0)
            turn = np.argsort(nearest, kind="stable")
            turn = turn[np.isfinite(nearest[turn]) & ~np.isin(turn + self.first[slab], missing)]
            if not len(turn):
                continue
            rows_before = np.cumsum(at[turn + 1] - at[turn])
            for units in np.split(turn, np.flatnonzero(np.diff(rows_before // CHUNK_ROWS)) + 1):
                low = lower[:, units].min(axis=1)
                r = s + np.flatnonzero((low <= bound[part] * (1 + 1e-9)) & np.isfinite(low))
                cols = np.concatenate([order[at[u]:at[u + 1]] for u in units])
                width = max(1, TILE_CELLS // max(1, len(cols)))
                for v in range(0, len(r) if len(cols) else 0, width):
                    q = r[v:v + width]
                    row, rank, found, dist = _top(X[q], rid[cols], B[cols], k, bound[q])
                    d = np.full((len(q), 2 * k), np.inf)
                    i = np.full((len(q), 2 * k), np.iinfo("int64").max)
                    d[:, :k], i[:, :k] = far[q], ids[q]
                    d[row, k + rank], i[row, k + rank] = dist, found
                    best = np.lexsort((i, d), axis=1)[:, :k]
                    far[q], ids[q] = np.take_along_axis(d, best, 1), np.take_along_axis(i, best, 1)
                    bound[q] = np.minimum(bound[q], far[q, k - 1])
        row, rank = np.nonzero(np.isfinite(far))
        return row, ids[row, rank], far[row, rank]


def _layout(tr: DataFrame, pivots: np.ndarray, k: int, block_rows: int,
            slab_rows: int) -> tuple[DataFrame, Layout]:
    """Train rows with their unit, and the units."""
    spark = tr.sparkSession
    located = _located(tr, pivots).checkpoint()
    cells = located.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts")).collect()
    # as many rings as the cell has units of block_rows, of even numbers of rows
    cuts = [(c["pivot"], [c["cuts"][i * RINGS // m - 1] for i in range(1, m)])
            for c in cells for m in [min(RINGS, math.ceil(c["n"] / block_rows))]]
    cuts = F.broadcast(spark.createDataFrame(cuts, "pivot int, cuts array<double>"))
    ringed = located.join(cuts, "pivot") \
        .withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("d")))).drop("cuts")
    rings = ringed.groupBy("pivot", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")) \
        .orderBy("pivot", "ring").collect()
    units, first = [], []
    for r in rings:
        parts = math.ceil(r["n"] / block_rows)
        first.append((r["pivot"], r["ring"], len(units), parts))
        units += [(r["pivot"], r["lo"], r["hi"], r["n"] / parts)] * parts
    table = F.broadcast(spark.createDataFrame(first, "pivot int, ring int, first int, parts int"))
    placed = ringed.join(table, ["pivot", "ring"]).select(
        "id", "x", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("unit"))
    # rows of a unit aren't exactly equal in number: an even share is no promise of k rows
    counted = placed.groupBy("unit").count().collect()
    units = np.array(units, np.float64)
    units[:, 3] = 0
    for r in counted:
        units[r["unit"], 3] = r["count"]
    return placed, Layout(pivots, units, k, slab_rows)


def _visits(placed: DataFrame, sent, visitors: DataFrame, visitors_max: int) -> tuple[DataFrame, dict[str, int]]:
    """(qid, rid, dist): the k nearest rows of the slab to each (id, x, upper, slab)
    visitor, none beyond upper, and how many rows were copied for it."""
    spark = placed.sparkSession
    rows = sent.value.slab_rows
    counts = {r["slab"]: (r["count"], math.ceil(r["count"] / visitors_max))
              for r in visitors.groupBy("slab").count().collect()}
    schema = "slab int, visits long, parts int"
    parts = F.broadcast(spark.createDataFrame([(u, n, p) for u, (n, p) in counts.items()], schema)
                        if counts else spark.createDataFrame([], schema))
    train = placed.join(parts, "slab").select(
        "slab", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "unit", "id", "x",
        F.lit(None).cast("double").alias("upper"))
    test = visitors.join(parts, "slab").select(
        "slab", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(-1).alias("unit"),
        "id", "x", "upper")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["unit"].to_numpy() >= 0
        tr, te = pdf[side], pdf[~side]
        if tr.empty or te.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "rid": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64")})
        qid, X = _vectors(te)
        rid, B = _vectors(tr)
        row, ids, dist = sent.value.search(int(pdf["slab"].iloc[0]), X, te["upper"].to_numpy(), rid, B,
                                           tr["unit"].to_numpy())
        return pd.DataFrame({"qid": qid[row], "rid": ids, "dist": dist})

    found = train.unionByName(test).groupBy("slab", "part").applyInPandas(run, _CANDIDATE)
    return found, {"train": int(sum(rows[u] * p for u, (_, p) in counts.items())),
                   "test": sum(n for n, _ in counts.values())}


def _by_pivots(tr: DataFrame, te: DataFrame, k: int, n_train: int, n_test: int, n_features: int, block_rows: int,
               log: dict | None) -> DataFrame:
    sc = tr.sparkSession.sparkContext
    block_rows = max(block_rows, math.ceil(n_train / MAX_UNITS))
    want = min(max(1, math.ceil(n_train / block_rows)), MAX_PIVOTS, max(1, PIVOT_BYTES // (8 * n_features)))
    most = max(1, min(SLAB_ROWS, SLAB_BYTES // (8 * n_features + 8)))
    placed, layout = _layout(tr, _pivots(tr, want), k, block_rows, most)
    slabs = F.broadcast(tr.sparkSession.createDataFrame(
        [(u, int(b)) for u, b in enumerate(layout.slab)], "unit int, slab int"))
    placed = placed.join(slabs, "unit").checkpoint()
    sent = sc.broadcast(layout)
    # as many visitors in a group as leave some groups to every core
    visitors_max = min(most, max(MIN_VISITORS, n_test * len(layout.first) // (4 * sc.defaultParallelism)))

    def first_slab(batches):
        """The unit each test row is nearest to, its slab, and the bound known without them."""
        lay = sent.value
        step = max(1, TILE_CELLS // len(lay.pivot))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                ids, X = _vectors(part)
                upper, lower = lay.bounds(X)
                # a unit with k rows if there is one; equally near ones are dealt by id
                known = np.isfinite(lower)
                aside = lower.max(initial=0.0, where=known) - lower.min(initial=0.0, where=known) + 1.0
                lower = np.where(lay.rows >= k, lower, lower + aside)
                near = lower <= lower.min(axis=1, keepdims=True)
                turn = ids % near.sum(axis=1)
                unit = (near.cumsum(axis=1) > turn[:, None]).argmax(axis=1)
                yield pd.DataFrame({"id": ids, "x": part["x"].to_numpy(), "slab": lay.slab[unit].astype("int32"),
                                    "upper": upper})

    home = te.mapInPandas(first_slab, "id long, x array<double>, slab int, upper double").checkpoint()
    found, copied = _visits(placed, sent, home, visitors_max)
    found = found.checkpoint()
    reached = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far")) \
        .where(F.col("n") >= k).select(F.col("qid").alias("id"), "far")
    open_rows = home.join(reached, "id", "left").withColumn("upper", F.least("upper", F.col("far"))).drop("far")

    def others(batches):
        """A row per further slab that may hold a neighbour."""
        lay = sent.value
        step = max(1, TILE_CELLS // len(lay.pivot))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                ids, X = _vectors(part)
                upper = part["upper"].to_numpy()
                lower = np.minimum.reduceat(lay.bounds(X)[1], lay.first, axis=1)
                visit = (lower <= upper[:, None] * (1 + 1e-9)) & np.isfinite(lower)
                visit[np.arange(len(part)), part["slab"].to_numpy()] = False
                row, slab = np.nonzero(visit)
                xs = part["x"].to_numpy()
                for a in range(0, len(row), 10_000):
                    r = row[a:a + 10_000]
                    yield pd.DataFrame({"id": ids[r], "x": xs[r], "upper": upper[r],
                                        "slab": slab[a:a + 10_000].astype("int32")})

    further = open_rows.mapInPandas(others, "id long, x array<double>, upper double, slab int").checkpoint()
    more, copied_too = _visits(placed, sent, further, visitors_max)
    if log is not None:
        log.update(units=len(layout.pivot), slabs=len(layout.first), train_copies=copied["train"] + copied_too["train"],
                   test_copies=copied["test"] + copied_too["test"])
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    return found.unionByName(more).withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k) \
        .select("qid", "nn_rank", "rid", "dist")


def knn_neighbors(train: DataFrame, test: DataFrame, features: list[str], train_id: str,
                  test_id: str, k: int = DEFAULT_K, block_rows: int = BLOCK_ROWS,
                  n_train: int | None = None, n_test: int | None = None,
                  broadcast_bytes: int = BROADCAST_BYTES, log: dict | None = None) -> DataFrame:
    """``(qid, nn_rank, rid, dist)``: the k nearest train rows of every test row.

    Ids must be integral and unique per side; ties in distance go to the
    smaller train id.  ``log`` gets the number of units and of rows that were
    sent to them, where the search goes by pivots.
    """
    n_train = train.count() if n_train is None else n_train
    n_test = test.count() if n_test is None else n_test
    vec = F.array(*[F.col(f).cast("double") for f in features])
    tr = train.select(F.col(train_id).cast("long").alias("id"), vec.alias("x"))
    te = test.select(F.col(test_id).cast("long").alias("id"), vec.alias("x"))
    if not n_train or not n_test:
        return tr.sparkSession.createDataFrame([], "qid long, nn_rank int, rid long, dist double")
    if n_train * (8 * len(features) + 8) <= broadcast_bytes and n_train * n_test <= STREAM_PAIRS:
        return _streamed(tr, te, k, n_test)
    return _by_pivots(tr, te, k, n_train, n_test, len(features), block_rows, log)


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], train_id: str,
                test_id: str, label: str, task: str, classes: list | None = None,
                k: int = DEFAULT_K, **kw) -> DataFrame:
    """Uniform-weight kNN prediction per test row.

    regression -> ``pred`` = mean label of the neighbours;
    classification -> ``probs`` = neighbour share of each class (array
    aligned with ``classes``).
    """
    nb = knn_neighbors(train, test, features, train_id, test_id, k, **kw)
    lab = train.select(F.col(train_id).cast("long").alias("rid"), F.col(label).alias("__y"))
    j = nb.join(lab, "rid", "left")
    if task == "regression":
        return j.groupBy("qid").agg(F.avg(F.col("__y").cast("double")).alias("pred"))
    if classes is None:
        raise ValueError("classification kNN needs the train classes")
    shares = [F.avg((F.col("__y") == F.lit(c)).cast("double")).alias(f"__p{i}")
              for i, c in enumerate(classes)]
    return j.groupBy("qid").agg(*shares).select(
        "qid", F.array(*[F.col(f"__p{i}") for i in range(len(classes))]).alias("probs"))
