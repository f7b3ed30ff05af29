"""Held-out metrics as aggregations: exact ROC AUC (ties averaged), macro
one-vs-rest AUC, R^2 and MAE.

AUC = sum over distinct scores s of pos(s) * (neg(< s) + neg(s) / 2) / (P * N):
one group-by on the score and one distributed cumulative sum
(:func:`~tabprobe.operators.rank.cumulative_before`); no sort into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null
from .rank import cumulative_before


def auc_frame(df: DataFrame, label: Column, score: Column, group_cols: list[str] = ()) -> DataFrame:
    """Exact AUC per group; ``label`` is boolean/0-1 (positive = true/1).

    NULL when a group has no positives or no negatives.
    """
    g = list(group_cols)
    base = df.select(*g, label.cast("int").alias("__l"),
                     (score.cast("double") + F.lit(0.0)).alias("__s")) \
        .where(F.col("__l").isNotNull() & F.col("__s").isNotNull())
    agg = base.groupBy(*g, "__s").agg(F.sum("__l").cast("double").alias("pos"),
                                      F.sum(1 - F.col("__l")).cast("double").alias("neg"))
    cum = cumulative_before(agg, g, "__s", ["neg"])
    part = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    red = cum.groupBy(*g).agg(F.sum(part).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N")) \
        if g else cum.agg(F.sum(part).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.try_divide(F.col("u"), F.col("P") * F.col("N")))
    return red.select(*g, auc.alias("auc"), F.col("P").cast("long").alias("n_pos"),
                      F.col("N").cast("long").alias("n_neg"))


def auc_binary(df: DataFrame, label: Column, score: Column) -> float | None:
    return auc_frame(df, label, score).first()["auc"]


def auc_ovr_frame(df: DataFrame, label: Column, scores: Column, classes_col: Column) -> DataFrame:
    """Per class c: AUC of (label == c) ranked by scores[c]; one row per class.

    ``scores`` is an array column aligned with the array ``classes_col``.
    """
    ex = df.select(label.alias("__y"), F.posexplode(F.arrays_zip(classes_col.alias("c"),
                                                                 scores.alias("p"))).alias("__i", "__z"))
    ex = ex.select(F.col("__z.c").alias("cls"), (F.col("__y") == F.col("__z.c")).alias("__pos"),
                   F.col("__z.p").alias("__p"))
    return auc_frame(ex, F.col("__pos"), F.col("__p"), ["cls"])


def auc_ovr_macro(df: DataFrame, label: Column, scores: Column, classes_col: Column) -> float | None:
    per = auc_ovr_frame(df, label, scores, classes_col)
    return per.agg(F.avg("auc")).first()[0]


def regression_scores(df: DataFrame, y: Column, pred: Column, group_cols: list[str] = ()) -> DataFrame:
    """R^2 = 1 - SS_res / SS_tot (may be very negative) and MAE, per group.

    A NaN or infinite label or prediction is missing like a NULL one: its row isn't
    scored.  ``n_missing`` counts rows with a label and no prediction, so that a
    caller can refuse a model that leaves test rows out.
    """
    g = list(group_cols)
    labelled = df.select(*g, finite_or_null(y).alias("__y"), finite_or_null(pred).alias("__all")) \
        .where(F.col("__y").isNotNull())
    base = labelled.select(*g, F.when(F.col("__all").isNotNull(), F.col("__y")).alias("__y"), F.col("__all").alias("__p"))
    aggs = [F.count("__p").alias("n"), F.sum(F.col("__p").isNull().cast("long")).alias("n_missing"),
            F.sum((F.col("__y") - F.col("__p")) ** 2).alias("ss_res"),
            (F.var_pop("__y") * F.count("__p")).alias("ss_tot"),
            F.avg(F.abs(F.col("__y") - F.col("__p"))).alias("mae")]
    red = base.groupBy(*g).agg(*aggs) if g else base.agg(*aggs)
    r2 = F.lit(1.0) - F.try_divide(F.col("ss_res"), F.col("ss_tot"))
    return red.select(*g, "n", r2.alias("r2"), "mae", "n_missing")
