"""Distributed exact ranking without a single-partition window.

Two primitives, both exact and both free of any global sort into one task:

* :func:`cumulative_before` -- for one row per distinct ``(group, value)``
  with weights, the sum of each weight over strictly smaller values of the
  same group.  Values are range-partitioned into buckets (Spark's sampled
  bounds only decide *balance*, never the answer); a tiny
  per-bucket table gives bucket offsets and a window inside each
  ``(group, bucket)`` finishes the job.  Average ranks, exact medians,
  dictionary codes and exact AUC are all built on it.
* :func:`hash_thresholds` -- per group, the k-th smallest of a unique hex
  hash.  Hex-prefix buckets are counted, the bucket holding position k is
  found from a tiny cumulative table, and only that bucket is ranked
  (refined by further hex digits while it is still large).  Exact
  "first k by hash" selections (splits, samples) become ``h <= threshold``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows a single window partition may hold before values are bucketed.
ROWS_PER_BUCKET = 1_000_000
# Tables up to this many rows are broadcast; larger ones are shuffled (AQE may
# still broadcast them after measuring their runtime size).
BROADCAST_ROWS = 100_000
# Largest boundary bucket ranked in one window partition.
BOUNDARY_LIMIT = 2_000_000


# Derived tables up to this many rows are rebuilt as local leaves.
SMALL_ROWS = 100_000


def materialize(df: DataFrame, small_rows: int = SMALL_ROWS, likely_large: bool = False) -> DataFrame:
    """Cut the lineage of a table derived from data it will be joined back to.

    A derived statistic joined to its own source is a self-join; Spark
    re-instantiates one side and can then miss the cached plan and recompute
    the whole upstream chain.  A small result (row count checked) becomes a
    fresh local leaf, broadcast; a large one is checkpointed to the shared
    checkpoint directory (which also survives executor loss).
    """
    if likely_large:
        ck = df.checkpoint(eager=True)
        return F.broadcast(ck) if ck.count() <= small_rows else ck
    rows = df.limit(small_rows + 1).collect()
    if len(rows) <= small_rows:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return df.checkpoint(eager=True)


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns, NULL matching NULL (pandas merge semantics)."""
    if not cols:
        raise ValueError("join_on needs at least one key column")
    ren = {c: f"__r_{c}" for c in cols}
    r = right.select(*[F.col(c).alias(ren[c]) if c in ren else F.col(c) for c in right.columns])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[ren[c]])
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    return out.drop(*ren.values())


#: keys of more rows than one in ``HOT_KEYS`` of a table, and more than ``HOT_ROWS``,
#: are joined by broadcast: at most ``HOT_KEYS`` of them
HOT_KEYS, HOT_ROWS = 2000, 10_000


def join_hot(big: DataFrame, table: DataFrame, cols: list[str], key_rows: str,
             hot_rows: int = HOT_ROWS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """``big`` joined with ``table`` (checkpointed, one row per key), whose column
    ``key_rows`` counts the key's rows in ``big``, or bounds them.

    A table of at most ``small_rows`` is broadcast.  Of a larger one, the keys that
    hold the most rows are few and are sent to all tasks, so that their rows stay
    where they are; only the others are shuffled, and no key among these holds more
    than one in ``HOT_KEYS`` of all rows (or ``hot_rows``).
    """
    payload = [c for c in table.columns if c != key_rows]
    n, total = table.agg(F.count(F.lit(1)), F.sum(key_rows)).first()
    if n <= small_rows:
        return join_on(big, F.broadcast(table.select(*payload)), cols)
    limit = max(hot_rows, total // HOT_KEYS)
    hot = table.where(F.col(key_rows) > limit).select(*payload).collect()
    table = table.where(F.col(key_rows) <= limit).select(*payload)
    if not hot:
        return join_on(big, table, cols)
    sent = F.broadcast(big.sparkSession.createDataFrame(hot, table.schema))
    rest = join_on(big, sent.select(*cols), cols, "left_anti")
    return join_on(big, sent, cols).unionByName(join_on(rest, table, cols))


def _n_buckets(agg: DataFrame, group_cols: list[str], rows_per_bucket: int) -> int:
    """1 if every group fits one window task, else buckets of about ``rows_per_bucket`` rows."""
    sizes = agg.groupBy(*group_cols).count() if group_cols else agg.agg(F.count(F.lit(1)).alias("count"))
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= rows_per_bucket:
        return 1
    return math.ceil(total / max(1, rows_per_bucket))


def cumulative_before(agg: DataFrame, group_cols: list[str], value_col: str,
                      weight_cols: list[str], rows_per_bucket: int = ROWS_PER_BUCKET,
                      n_buckets: int | None = None) -> DataFrame:
    """Add ``<w>_before`` = sum of ``w`` over smaller values of the same group.

    ``agg`` holds one row per distinct ``(group_cols, value_col)``.  Beyond one
    bucket the rows are range-partitioned by group and whole value, of any
    type, so strings with a long common prefix part like any others.
    """
    g = list(group_cols)
    B = n_buckets if n_buckets is not None else _n_buckets(agg, g, rows_per_bucket)
    if B <= 1:
        w = Window.partitionBy(*g).orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
        return agg.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before")
                                 for c in weight_cols])
    # checkpointed: read twice, and both readers must see the same buckets
    ranged = agg.repartitionByRange(B, *g, value_col).withColumn("__b", F.spark_partition_id()) \
        .checkpoint(eager=True)
    # a group spans neighbouring buckets, so this has at most groups + B rows
    sums = ranged.groupBy(*g, "__b").agg(*[F.sum(c).alias(f"__s_{c}") for c in weight_cols])
    wb = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*g, "__b", *[F.coalesce(F.sum(f"__s_{c}").over(wb), F.lit(0)).alias(f"__o_{c}")
                                       for c in weight_cols])
    wv = Window.partitionBy(*g, "__b").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    return join_on(ranged, materialize(offsets), [*g, "__b"]).select(*agg.columns, *[
        (F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(wv), F.lit(0))).alias(f"{c}_before")
        for c in weight_cols])


def average_ranks(df: DataFrame, group_cols: list[str], value_col: str,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per distinct (group, value): ``cnt``, ``n`` (group size) and the
    0-based average rank ``rank0`` (ties share the mean of their positions)."""
    agg = df.where(F.col(value_col).isNotNull()).groupBy(*group_cols, value_col) \
        .agg(F.count(F.lit(1)).alias("cnt"))
    cum = cumulative_before(agg, group_cols, value_col, ["cnt"], rows_per_bucket)
    # one total per group, joined back: no task holds a whole group
    one = F.lit(0).alias("__one")
    totals = materialize(agg.groupBy(*group_cols, one).agg(F.sum("cnt").alias("n")))
    return join_on(cum.withColumn("__one", F.lit(0)), totals, [*group_cols, "__one"]).select(
        *group_cols, value_col, "cnt", (F.col("cnt_before") + (F.col("cnt") - 1) / 2.0).alias("rank0"), "n")


def hash_thresholds(df: DataFrame, group_cols: list[str], h_col: str, need: DataFrame,
                    limit: int = BOUNDARY_LIMIT, need_rows: int | None = None) -> DataFrame:
    """Per group, the ``_need``-th smallest ``h_col`` (unique hex strings).

    ``need`` has ``group_cols + ['_need']``; groups with ``_need <= 0`` or
    absent get no row.  Returns ``group_cols + ['_thr']``.
    """
    g = list(group_cols)
    if not g:
        df = df.withColumn("__g", F.lit(0))
        need = need.withColumn("__g", F.lit(0))
        g = ["__g"]
    cand = df.select(*g, h_col)
    need = need.select(*g, "_need").where(F.col("_need") > 0)
    # at most one boundary row per group: one size check covers every level
    if need_rows is None:
        # derived from the data it is joined back to: cut its lineage first
        need = materialize(need)
        need_rows = need.count()
    small = need_rows <= BROADCAST_ROWS
    bc = F.broadcast if small else (lambda d: d)
    p = 3
    while True:
        counts = cand.groupBy(*g, F.substring(h_col, 1, p).alias("__b")).count()
        w = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        cum = counts.withColumn("__before", F.coalesce(F.sum("count").over(w), F.lit(0)))
        bound = materialize(join_on(cum, bc(need), g, "inner")
                            .where((F.col("__before") < F.col("_need"))
                                   & (F.col("_need") <= F.col("__before") + F.col("count")))
                            .select(*g, "__b", (F.col("_need") - F.col("__before")).alias("_need"),
                                    "count"))
        mx = bound.agg(F.max("count")).first()[0]
        keyed = cand.withColumn("__b", F.substring(h_col, 1, p))
        if mx is None:
            thr = cand.select(*g, F.col(h_col).alias("_thr")).where(F.lit(False))
            return thr.drop("__g") if "__g" in g else thr
        if mx <= limit or p >= 64:
            sel = join_on(keyed, bc(bound.drop("count")), g + ["__b"], "inner")
            w2 = Window.partitionBy(*g).orderBy(h_col)
            thr = sel.withColumn("__rn", F.row_number().over(w2)) \
                .where(F.col("__rn") == F.col("_need")) \
                .select(*g, F.col(h_col).alias("_thr"))
            return thr.drop("__g") if "__g" in g else thr
        cand = join_on(keyed, bc(bound.select(*g, "__b")), g + ["__b"],
                       "left_semi").drop("__b")
        need = bound.select(*g, "_need")
        p += 3
