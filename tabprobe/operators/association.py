"""Scale-invariant feature/target association, for every column in one plan.

* regression: |Spearman| -- Pearson of average ranks;
* classification: correlation ratio eta of the feature's normalised ranks
  across classes, sqrt(SS_between / SS_total);
* fewer than 3 usable rows, or no rank variance -> 0.

Columns are unpivoted into one long ``(col, value, y)`` frame and reduced to
counts per distinct value before any ranking, so the work is one set of
shuffles whatever the width, and a hot value is a single row.  Ties get
average ranks (deterministic; a constant column scores 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null
from .encoders import long_form
from .rank import cumulative_before, join_hot

EPS = 1e-9
EFFICIENCY_THRESHOLD = 0.1


def _ranked(agg: DataFrame, value_col: str, weight: str) -> DataFrame:
    """(col, value) -> 0-based average rank and number of ``agg`` rows, from counts."""
    per_value = agg.groupBy("col", value_col).agg(F.sum(weight).alias("cnt"), F.count(F.lit(1)).alias("key_rows"))
    cum = cumulative_before(per_value, ["col"], value_col, ["cnt"])
    return cum.select("col", value_col, (F.col("cnt_before") + (F.col("cnt") - 1) / 2.0).alias(f"r_{value_col}"),
                      "key_rows")


def _zero_fill(stats: DataFrame, cols: list[str], name: str, cached: DataFrame) -> DataFrame:
    """Materialise the one-row-per-column result (bounded by the column
    count), release the cached long frame, fill absent columns with 0."""
    got = {r["col"]: r[name] for r in stats.collect()}
    rows = [(c, i, float(got[c]) if got.get(c) is not None else 0.0) for i, c in enumerate(cols)]
    return stats.sparkSession.createDataFrame(rows, f"col string, pos int, {name} double")


def spearman_abs(df: DataFrame, cols: list[str], target: str, **hot) -> DataFrame:
    """(col, pos, association) = |Spearman(x, y)| per column.

    Ranks return to the pairs by joins on the values; the few values that hold
    many pairs are joined by broadcast, so a value of x or y in a third of all
    rows fills no task (``hot``: bounds of :func:`~.rank.join_hot`).

    Ranks are taken over each column's own pairwise-complete rows.  Columns
    with no missing value where the target is present share one ranking of
    the target (computed once); only the others rank it per column.
    """
    # narrow input read by three actions: persisted for the fit, released below
    base = df.select(finite_or_null(F.col(target)).alias("__y"),
                     *[finite_or_null(F.col(c)).alias(c) for c in cols]).persist()
    nulls = base.where(F.col("__y").isNotNull()).agg(
        *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols]).first()
    full = [c for c in cols if not nulls[c]]
    part = [c for c in cols if nulls[c]]
    lf = long_form(base, cols, "double", ["__y"]) \
        .where(F.col("value").isNotNull() & F.col("__y").isNotNull())
    # checkpointed: joined back to its own ranks below (see rank.materialize)
    pairs = lf.groupBy("col", "value", "__y").agg(F.count(F.lit(1)).alias("w")).checkpoint(eager=True)
    rx = _ranked(pairs, "value", "w").checkpoint()
    jx = join_hot(pairs, rx, ["col", "value"], "key_rows", **hot)
    pieces = []
    if full:
        # a target value has at most as many pairs as rows, in each column
        ycnt = base.where(F.col("__y").isNotNull()).groupBy("__y").agg(F.count(F.lit(1)).alias("cnt"))
        yr = cumulative_before(ycnt, [], "__y", ["cnt"]).select(
            "__y", (F.col("cnt_before") + (F.col("cnt") - 1) / 2.0).alias("r___y"),
            (F.col("cnt") * F.lit(len(full))).alias("key_rows"))
        pieces.append(join_hot(jx.where(F.col("col").isin(full)), yr.checkpoint(), ["__y"], "key_rows", **hot))
    if part:
        ry = _ranked(pairs.where(F.col("col").isin(part)), "__y", "w").checkpoint()
        pieces.append(join_hot(jx.where(F.col("col").isin(part)), ry, ["col", "__y"], "key_rows", **hot))
    j = pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])
    w, a, b = F.col("w"), F.col("r_value"), F.col("r___y")
    s = j.groupBy("col").agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"),
        F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    n = F.col("n")
    va = F.col("saa") / n - (F.col("sa") / n) ** 2
    vb = F.col("sbb") / n - (F.col("sb") / n) ** 2
    cov = F.col("sab") / n - (F.col("sa") / n) * (F.col("sb") / n)
    scale = F.greatest(n - 1, F.lit(1))          # std of ranks normalised to [0, 1]
    sda, sdb = F.sqrt(F.greatest(va, F.lit(0.0))) / scale, F.sqrt(F.greatest(vb, F.lit(0.0))) / scale
    r = F.abs(F.try_divide(cov, F.sqrt(va * vb)))
    assoc = F.when((n < 3) | (sda < EPS) | (sdb < EPS), F.lit(0.0)).otherwise(F.least(r, F.lit(1.0)))
    out = _zero_fill(s.select("col", assoc.alias("association")), cols, "association", pairs)
    base.unpersist()
    return out


def eta_ranks(df: DataFrame, cols: list[str], target: str, **hot) -> DataFrame:
    """(col, pos, association) = correlation ratio of feature ranks across classes.

    A missing label is a class of its own (label codes are taken as given).
    """
    base = df.select(F.col(target).cast("string").alias("__c"),
                     *[finite_or_null(F.col(c)).alias(c) for c in cols])
    lf = long_form(base, cols, "double", ["__c"]).where(F.col("value").isNotNull())
    agg = lf.groupBy("col", "value", "__c").agg(F.count(F.lit(1)).alias("w")).checkpoint(eager=True)
    j = join_hot(agg, _ranked(agg, "value", "w").checkpoint(), ["col", "value"], "key_rows", **hot)
    raw, w = F.col("r_value"), F.col("w")
    # ranks are divided by n - 1 of the column after its classes are added up
    per_cls = j.groupBy("col", "__c").agg(F.sum(w).alias("nk"), F.sum(w * raw).alias("sk"),
                                          F.sum(w * raw * raw).alias("qk"))
    per_col = per_cls.groupBy("col").agg(
        F.sum("nk").alias("n"), F.sum("sk").alias("s"), F.sum("qk").alias("q"),
        F.sum(F.try_divide(F.col("sk") * F.col("sk"), F.col("nk"))).alias("sb_raw"))
    n = F.col("n")
    grand = F.try_divide(F.col("s"), n)
    scale = F.greatest(n - 1, F.lit(1))
    sst = (F.col("q") - n * grand * grand) / (scale * scale)
    ssb = (F.col("sb_raw") - n * grand * grand) / (scale * scale)
    eta = F.sqrt(F.try_divide(F.greatest(ssb, F.lit(0.0)), sst))
    assoc = F.when((n < 3) | (sst < EPS), F.lit(0.0)).otherwise(F.least(eta, F.lit(1.0)))
    return _zero_fill(per_col.select("col", assoc.alias("association")), cols, "association", agg)


def target_association(df: DataFrame, cols: list[str], target: str, task: str) -> DataFrame:
    """Dispatcher: regression -> |Spearman|, classification -> eta."""
    if task == "regression":
        return spearman_abs(df, cols, target)
    return eta_ranks(df, cols, target)


def pearson_abs(df: DataFrame, cols: list[str], y) -> DataFrame:
    """(col, pos, association) = |Pearson(x, y)|; constant column -> 0;
    undefined -> NULL.  ``y`` is a numeric Column (class code for labels)."""
    base = df.select(finite_or_null(y).alias("__y"), *[finite_or_null(F.col(c)).alias(c) for c in cols])
    aggs = []
    for c in cols:
        x = F.col(c)
        xm = F.when(F.col("__y").isNotNull(), x)
        ym = F.when(x.isNotNull(), F.col("__y"))
        aggs += [F.covar_pop(xm, ym).alias(f"c_{c}"), F.stddev_pop(xm).alias(f"sx_{c}"),
                 F.stddev_pop(ym).alias(f"sy_{c}"),
                 (F.min(x) == F.max(x)).alias(f"k_{c}")]
    row = base.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        cov, sx, sy, const = row[f"c_{c}"], row[f"sx_{c}"], row[f"sy_{c}"], row[f"k_{c}"]
        if const is None or const:
            v = 0.0
        elif cov is None or not sx or not sy:
            v = None
        else:
            v = min(abs(cov / (sx * sy)), 1.0)
        out.append((c, i, v))
    return df.sparkSession.createDataFrame(out, "col string, pos int, association double")


def cap_scores(df: DataFrame, cols: list[str], target: str, task: str, max_cols: int,
               classes: list | None = None) -> DataFrame:
    """(col, pos, association, kept): |Pearson| with the target (class code =
    position of the sorted label); the ``max_cols`` best are kept, ties by
    column position, undefined last."""
    if task == "regression":
        y = F.col(target).cast("double")
    else:
        from .encoders import LabelCoder, train_classes

        y = LabelCoder(classes or train_classes(df, target)).code(F.col(target))
    scores = pearson_abs(df, cols, y)
    order = Window.orderBy(F.col("association").desc_nulls_last(), F.col("pos"))
    # one row per column: the unpartitioned window is bounded by the width
    return scores.withColumn("kept", F.row_number().over(order) <= max_cols)


def cap_columns(df: DataFrame, cols: list[str], target: str, task: str, max_cols: int | None,
                classes: list | None = None) -> list[str]:
    """Columns kept by :func:`cap_scores`, in their original order.  No-op
    when not wider than the cap; 0/None disables."""
    if not max_cols or len(cols) <= max_cols:
        return list(cols)
    keep = {r["col"] for r in cap_scores(df, cols, target, task, max_cols, classes)
            .where("kept").collect()}
    return [c for c in cols if c in keep]


def feature_efficiency(train_gen: DataFrame, base_cols: list[str], gen_cols: list[str],
                       target: str, task: str) -> float | None:
    """Share of newly generated columns (by name) with association >= 0.1."""
    new = [c for c in gen_cols if c not in set(base_cols)]
    if not new:
        return None
    assoc = target_association(train_gen, new, target, task)
    r = assoc.agg(F.avg((F.col("association") >= EFFICIENCY_THRESHOLD).cast("double"))).first()
    return float(r[0])
