"""Centroid clustering over a vector-approximation file.

Vectors become integers, ``floor(scale * x)`` per component, and are written
once with their approximation: per dimension the number of the cell (out of
``2 ** BITS``) that holds the component, a byte each.  Cells are of equal width
over all but the 1/256 least and greatest components of a bounded sample of the
vectors; the outer cells end at the dimension's least and greatest component,
over all vectors.

A round needs the nearest centroid of every vector.  Per dimension and cell a
small table gives the least and the greatest squared distance that the cell
allows to each centroid; summed over the dimensions they bound the distance to
every centroid from below and above.  A centroid whose lower bound exceeds
another's upper bound can't be nearest; only a vector that keeps more than one
centroid has its full components fetched and measured.

Centroids are moved by what changed: a vector whose centroid is the one of the
round before adds nothing, one that moved is fetched and moves from one sum to
the other.  So a round reads the approximations of all and the components of
few.  The driver holds ``k`` centroids and their sums; tasks add up their own
rows before anything is shuffled, so no centroid's vectors meet in one task.

Integers are exact: squared distances of components up to ``MAX_COMPONENT`` in size fit
64 bits, a larger one raises an error.

Edge cases: vectors that are null, of another length, or with a null or
non-finite component are left out; equal vectors and repeated ids stay separate
rows; a missing id is hashed as empty text; with fewer vectors than centroids
all vectors are centroids; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import written

BITS = 6
CELLS = 1 << BITS
MAX_COMPONENT = 1 << 24
#: vectors that are bounded at once
ROWS_AT_ONCE = 4096


def quantised(vectors: DataFrame, *, vector: str = "embedding", vector_id: str = "vec_id", dims: int = 64,
              scale: int = 64) -> DataFrame:
    """vec_id and ``ints`` (64-bit integers), of the vectors that have ``dims``
    finite components."""
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    whole = (F.size(vector) == dims) & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(vector_id).cast("bigint").alias("vec_id"),
                                                                 x.alias("ints"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _chosen(ints: DataFrame, k: int, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` vectors by hash (ties: by components), and ``sample`` of them."""
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = [r[0] for r in ints.select(h.alias("h"), "ints").orderBy("h", "ints").limit(max(k, sample))
            .select("ints").collect()]
    got = np.array(rows, np.int64)
    return got[:k], got[:sample]


class Cells:
    """Borders of the cells of each dimension: ``borders`` are the first values
    of the second and later cells, ``low`` and ``high`` the ends of each cell."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, greatest: np.ndarray):
        tail = len(sample) // 256
        ordered = np.sort(sample, axis=0)
        low, high = ordered[tail], ordered[len(sample) - 1 - tail]
        step = np.maximum((high - low) / CELLS, 1)[:, None]  # a cell of one value has exact distances
        middle = ((low + high) // 2)[:, None]
        self.borders = (middle + np.floor((np.arange(1, CELLS) - CELLS // 2) * step)).astype(np.int64)
        self.low = np.c_[np.minimum(least, self.borders[:, 0]), self.borders]
        self.high = np.c_[self.borders - 1, np.maximum(greatest, self.borders[:, -1])]
        self.high = np.maximum(self.high, self.low)  # empty cells where borders are equal

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of the rows of ``x``."""
        cells = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            cells[:, d] = np.searchsorted(self.borders[d], x[:, d], side="right")
        return cells

    def bounds(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per dimension and cell: least and greatest squared distance that the
        cell allows to each centroid."""
        c = centroids.T[:, None, :]  # dimension, cell, centroid
        low, high = self.low[:, :, None], self.high[:, :, None]
        near = np.maximum(np.maximum(low - c, c - high), 0) ** 2
        far = np.maximum(np.abs(c - low), np.abs(c - high)) ** 2
        return near, far


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Nearest:
    """Nearest centroid by approximation, by components where that doesn't settle it."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.centroids = centroids
        self.near, self.far = cells.bounds(centroids)
        self.fetched = 0

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Which centroids' distance intervals reach below every upper bound."""
        near = np.zeros((len(codes), len(self.centroids)), np.int64)
        far = np.zeros_like(near)
        for j in range(codes.shape[1]):
            near += self.near[j][codes[:, j]]
            far += self.far[j][codes[:, j]]
        return near <= far.min(axis=1, keepdims=True)

    def of(self, codes: np.ndarray, fetch) -> np.ndarray:
        """Centroid numbers; ``fetch(rows)`` gives the components of some rows."""
        left = self.candidates(codes)
        nearest = left.argmax(axis=1)
        open_rows = np.flatnonzero(left.sum(axis=1) > 1)
        if len(open_rows):
            self.fetched += len(open_rows)
            d = np.where(left[open_rows], distances(fetch(open_rows), self.centroids), np.iinfo(np.int64).max)
            nearest[open_rows] = d.argmin(axis=1)  # ties: the smaller number
        return nearest


def _blocks(batches: Iterator[pa.RecordBatch], dims: int):
    """(ids, codes, fetch) of some rows at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(a, ROWS_AT_ONCE)
            codes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            vectors = part.column(2)

            def fetch(rows, vectors=vectors):
                some = vectors.take(pa.array(rows))
                return np.frombuffer(b"".join(some.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)

            yield part.column(0), codes, fetch


def _filed(ints: DataFrame, cells: Cells, dims: int) -> DataFrame:
    """The approximation file: vec_id, codes, vector (32-bit integers)."""
    def rows(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            codes, full = cells.of(x), x.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary()),
                 pa.array([r.tobytes() for r in full], pa.binary())], ["vec_id", "codes", "vector"])

    return written(ints.mapInArrow(rows, "vec_id bigint, codes binary, vector binary"))


def _moved(filed: DataFrame, cells: Cells, now: np.ndarray, before: np.ndarray | None,
           dims: int) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    """What the sums and counts of the centroids change by when the vectors go
    from the centroids ``before`` (None: from nowhere) to ``now``."""
    k = len(now)

    def rows(batches):
        new = Nearest(cells, now)
        old = None if before is None else Nearest(cells, before)
        sums, counts, seen, moved = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0, 0

        def add(to, x, sign):
            for c in np.unique(to):
                some = x[to == c]
                sums[c] += sign * some.sum(axis=0)
                counts[c] += sign * len(some)

        for _, codes, fetch in _blocks(batches, dims):
            to = new.of(codes, fetch)
            source = old.of(codes, fetch) if old is not None else np.full(len(to), -1)
            changed = np.flatnonzero(source != to)
            if len(changed):
                x = fetch(changed)
                add(to[changed], x, 1)
                if old is not None:
                    add(source[changed], x, -1)
            seen, moved = seen + len(to), moved + len(changed)
        if seen:
            # a row per centroid and dimension (dims: the count); k and k + 1: what was done
            values = [(c, d, int(v)) for c in range(k) for d, v in enumerate((*sums[c], counts[c])) if v]
            values += [(k, 0, seen), (k, 1, moved), (k, 2, new.fetched)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*values), (pa.int32(), pa.int32(), pa.int64()))],
                ["c", "d", "v"])

    parts = filed.mapInArrow(rows, "c int, d int, v bigint")
    total = np.zeros((k + 1, max(dims + 1, 3)), object)
    for c, d, v in parts.groupBy("c", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        total[c, d] = int(v)
    return total[:k, :dims], total[:k, dims], dict(zip(("rows", "moved", "unsettled"), total[k, :3]))


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64,
            sample: int = 2048, vector: str = "embedding", vector_id: str = "vec_id",
            log: list[dict] | None = None) -> DataFrame:
    """vec_id, cluster, distance (squared, to the cluster's centroid),
    cluster_inertia and inertia (distances added over the cluster and over all)
    and centroid (its components), for every whole vector.  The first centroids
    are the ``k`` vectors first by the hash of ``seed`` and id; each of ``rounds``
    rounds assigns all vectors (ties: the smaller number) and moves every
    centroid with vectors to their mean, rounded down.  Cell borders are fitted
    on ``sample`` vectors, first by the same hash.  ``log`` gets a row per round:
    rows, vectors moved, vectors that bounds didn't settle."""
    spark = vectors.sparkSession
    ints = written(quantised(vectors, vector=vector, vector_id=vector_id, dims=dims, scale=scale))
    result = "vec_id bigint, cluster int, distance bigint"
    centroids, fitted = _chosen(ints, k, sample, seed)
    if not len(centroids):
        return spark.createDataFrame(
            [], f"{result}, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    ends = ints.select(F.posexplode("ints").alias("d", "v")).groupBy("d") \
        .agg(F.min("v").alias("least"), F.max("v").alias("greatest")).orderBy("d").collect()
    least, greatest = (np.array([r[c] for r in ends], np.int64) for c in ("least", "greatest"))
    if max(-least.min(), greatest.max()) > MAX_COMPONENT:
        raise ValueError(f"a component times {scale} is beyond {MAX_COMPONENT} in size")
    cells = Cells(fitted, least, greatest)
    filed = _filed(ints, cells, dims)
    sums, counts = np.zeros((len(centroids), dims), object), np.zeros(len(centroids), object)
    before = None
    for _ in range(rounds):
        more, n, stats = _moved(filed, cells, centroids, before, dims)
        if log is not None:
            log.append(stats)
        sums, counts, before = sums + more, counts + n, centroids
        centroids = np.array([[s // n for s in row] if n else old.tolist()
                              for row, n, old in zip(sums, counts, centroids)], np.int64)

    def assign(batches):
        nearest = Nearest(cells, centroids)
        for ids, codes, fetch in _blocks(batches, dims):
            to = nearest.of(codes, fetch)
            d = fetch(np.arange(len(to))) - centroids[to]
            yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d))],
                                             ["vec_id", "cluster", "distance"])

    assigned = written(filed.mapInArrow(assign, result))
    per_cluster = {r[0]: int(r[1]) for r in assigned.groupBy("cluster")
                   .agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    last = spark.createDataFrame(
        [(c, s, sum(per_cluster.values()), centroids[c].tolist()) for c, s in sorted(per_cluster.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(last), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # at most k rows are sent


def digest(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def oracle_sql(rounds: int = 3, k: int = 16) -> str:
    """The same in SQL: each round assigns all vectors by their distances to all
    centroids."""
    steps = ["""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "parts AS (SELECT r, unnest(v) AS x, unnest(range(64)) AS d FROM kept)",
             f"""c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, unnest(range(64)) AS d FROM (
    SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept)
  WHERE c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM (
    SELECT p.r, c.c, sum((p.x - c.x) * (p.x - c.x)) AS s FROM parts p JOIN c{i} c USING (d) GROUP BY p.r, c.c)
  GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x, c.d
  FROM c{i} c LEFT JOIN (SELECT a.c, p.d, sum(p.x) AS s, count(*) AS n FROM a{i} a JOIN parts p USING (r)
                         GROUP BY a.c, p.d) m ON c.c = m.c AND c.d = m.d)""")
    return f"""WITH {", ".join(steps)},
hashed AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS "cluster", CAST(a.s AS BIGINT) AS distance,
       CAST(sum(a.s) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.s) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (r) JOIN hashed h ON a.c = h.c
"""


ORACLE_SQL = oracle_sql()
