"""Frozen, exact, hash-ordered train/test splits and row samples.

A row's place in the ordering is ``sha256(seed:row_key)``, so membership
depends only on the dataset key (through the seed) and the row key -- never
on partitioning, file order or cluster size.  Test size is exact:
``round(n * test_size)`` rows overall (holdout) or per class (stratified);
rows with a missing label always stay in train.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import HOLDOUT_TEST_SIZE, row_hash, seed_for_py
from .rank import BOUNDARY_LIMIT, hash_thresholds, join_on, materialize

FOLD_ID = "split0"
PROTOCOL = "holdout"


def _class_need(hashed: DataFrame, label: str, test_size: float) -> DataFrame:
    counts = hashed.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col(label).isNotNull()).select(
        label, "n", F.round(F.col("n") * F.lit(test_size)).cast("long").alias("_need"))


def add_split(df: DataFrame, key_cols: list[str], dataset_key: str, label: str | None = None,
              stratify: bool = False, test_size: float = HOLDOUT_TEST_SIZE,
              seed: int | None = None) -> DataFrame:
    """``df`` plus ``fold_id`` and ``is_test``.

    Holdout: the ``round(n*test_size)`` rows with the smallest hash are test.
    Stratified: the same per label value; NULL labels are always train.
    """
    seed = seed_for_py(dataset_key) if seed is None else seed
    hashed = df.withColumn("_h", row_hash(df, key_cols, seed))
    if stratify:
        if label is None:
            raise ValueError(f"{dataset_key}: stratified split requires a label column")
        narrow = hashed.select(label, "_h").persist()
        need = _class_need(narrow, label, test_size)
        thr = materialize(hash_thresholds(narrow, [label], "_h", need))
        narrow.unpersist()
        out = join_on(hashed, thr, [label], "left")
        is_test = F.coalesce(F.col("_h") <= F.col("_thr"), F.lit(False))
        return out.select(*df.columns, F.lit(FOLD_ID).alias("fold_id"), is_test.alias("is_test"))
    thr = first_k_threshold(hashed, "_h", None, test_size)
    is_test = F.lit(False) if thr is None else (F.col("_h") <= F.lit(thr))
    return hashed.select(*df.columns, F.lit(FOLD_ID).alias("fold_id"), is_test.alias("is_test"))


#: hash prefixes (of 4096) on either side of the expected one whose hashes are kept whole
PREFIXES_ASIDE = 16


def _expected_threshold(hashed: DataFrame, h_col: str, fraction: float) -> tuple[int, str | None]:
    """Number of rows, and the threshold if it lies where even hashes let expect it.

    One pass: rows are counted per 3-digit prefix, but per whole hash near the
    ``fraction`` of all, so that no hash elsewhere is stored or shuffled.
    """
    at = int(fraction * 4096)
    lo, hi = (f"{min(max(at + d, 0), 4095):03x}" for d in (-PREFIXES_ASIDE, PREFIXES_ASIDE))
    head = F.substring(h_col, 1, 3)
    counts = hashed.groupBy(F.when(head.between(lo, hi), F.col(h_col)).otherwise(head).alias("h")) \
        .agg(F.count(F.lit(1)).alias("n")).persist()
    heads = {r["b"]: r["n"] for r in counts.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sum("n").alias("n"))
             .collect()}
    n = sum(heads.values())
    k, before, thr = int(round(n * fraction)), 0, None
    for b in sorted(h for h in heads if h is not None):
        if before < k <= before + heads[b] and lo <= b <= hi and heads[b] <= BOUNDARY_LIMIT:
            w = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
            # one prefix of 4096, no more than BOUNDARY_LIMIT rows
            thr = counts.where(F.substring("h", 1, 3) == b).withColumn("upto", F.sum("n").over(w)) \
                .where(F.col("upto") >= k - before).agg(F.min("h")).first()[0]
        before += heads[b]
    counts.unpersist()
    return n, thr


def first_k_threshold(hashed: DataFrame, h_col: str, k: int | None,
                      fraction: float | None = None) -> str | None:
    """The k-th smallest hash of the whole frame (k = round(n*fraction) if given)."""
    if k is None:
        n, thr = _expected_threshold(hashed, h_col, fraction)
        k = int(round(n * fraction))
        if thr is not None or k <= 0:
            return thr
    narrow = hashed.select(h_col).persist()
    n = narrow.count()
    k = min(int(k), n)
    if k <= 0:
        narrow.unpersist()
        return None
    need = narrow.sparkSession.range(1).select(F.lit(k).cast("long").alias("_need"))
    row = hash_thresholds(narrow, [], h_col, need, need_rows=1).first()
    narrow.unpersist()
    return None if row is None else row["_thr"]


def hash_sample(df: DataFrame, key_cols: list[str], k: int, seed: int = 0) -> DataFrame:
    """Exactly ``min(n, k)`` rows without replacement: the k smallest hashes.

    Deterministic, independent of partitioning; no single-partition sort.
    """
    hashed = df.withColumn("_h", row_hash(df, key_cols, seed))
    thr = first_k_threshold(hashed, "_h", k)
    if thr is None:
        return df.where(F.lit(False))
    return hashed.where(F.col("_h") <= F.lit(thr)).drop("_h")


def class_counts(split_df: DataFrame, label: str) -> DataFrame:
    """Per label value: rows, test rows, train rows."""
    return split_df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_test").cast("long")).alias("n_test"),
        F.sum((~F.col("is_test")).cast("long")).alias("n_train"))


def overlap_check(split_df: DataFrame, key_cols: list[str]) -> DataFrame:
    """One row: keys on both sides, train rows, test rows, all rows, rows on no side."""
    per_key = split_df.groupBy(*key_cols).agg(
        F.sum(F.col("is_test").cast("long")).alias("t"),
        F.sum((~F.col("is_test")).cast("long")).alias("r"),
        F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(((F.col("t") > 0) & (F.col("r") > 0)).cast("long")), F.lit(0))
        .alias("n_overlap"),
        F.sum("r").alias("n_train"), F.sum("t").alias("n_test"), F.sum("n").alias("n_total"),
        (F.sum("n") - F.sum("r") - F.sum("t")).alias("n_uncovered"))


def train_test(split_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_df.where(~F.col("is_test")), split_df.where(F.col("is_test"))
