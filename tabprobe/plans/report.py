"""Leaderboard report as DataFrames over the result table.

Levels of aggregation (each a plain group-by):
family score = fold mean per (key, method, family) -> overview cell = mean of
family scores per (key, method) -> task / sector cell = mean of overview
cells per (method, group).  Best cells are flagged with a window max
(ties all flagged).  Failed rows are counted, never dropped.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_error_line, fmt_before_after, fmt_score, fmt_seconds, initials


def ok_rows(res: DataFrame) -> DataFrame:
    return res.where((F.col("status") == "ok") & F.col("value").isNotNull())


def fail_rows(res: DataFrame) -> DataFrame:
    return res.where(F.col("status").isNull() | (F.col("status") != "ok"))


def method_order(col: str = "method"):
    """baseline first, then alphabetical."""
    return [(F.col(col) != F.lit("baseline")).cast("int"), F.col(col)]


def family_scores(res: DataFrame) -> DataFrame:
    """Fold mean of value per (key, method, model_family)."""
    return ok_rows(res).groupBy("key", "method", "model_family").agg(F.avg("value").alias("value"))


def dataset_info(res: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Per key with a successful row: task, metric and sector ('?' if unknown)."""
    info = ok_rows(res).groupBy("key").agg(F.coalesce(F.max("task"), F.lit("?")).alias("task"),
                                           F.coalesce(F.max("metric"), F.lit("?")).alias("metric"))
    if registry is None:
        return info.withColumn("sector", F.lit("?"))
    reg = registry.select("key", "sector")
    return info.join(reg, "key", "left").withColumn("sector", F.coalesce("sector", F.lit("?")))


def legend(res: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Datasets in report order (task, sector, key) with unique abbreviations:
    initials of the hyphenated key, repeats numbered 2, 3, ... in order."""
    rows = dataset_info(res, registry).withColumn("base", initials(F.col("key"))) \
        .orderBy("task", "sector", "key").collect()
    labels = _numbered([r["base"] for r in rows])
    return res.sparkSession.createDataFrame(
        [(i, label, r["key"], r["task"], r["sector"], r["metric"]) for i, (r, label) in enumerate(zip(rows, labels), 1)],
        "pos int, abbrev string, key string, task string, sector string, metric string")


def _numbered(labels: list[str]) -> list[str]:
    """Labels made unique: a taken one gets the first free number from 2 on."""
    taken: set[str] = set()
    out = []
    for base in labels:
        numbered = itertools.chain([base], (f"{base}{i}" for i in itertools.count(2)))
        out.append(next(x for x in numbered if x not in taken))
        taken.add(out[-1])
    return out


def abbreviations(keys: DataFrame) -> DataFrame:
    """(key, abbrev) for ``(key, pos)`` rows: initials, numbered where taken, in
    ``pos`` order.  One row per report column, read by the driver."""
    rows = keys.select("key", initials(F.col("key")).alias("base")).orderBy(keys["pos"]).collect()
    return keys.sparkSession.createDataFrame(
        list(zip([r["key"] for r in rows], _numbered([r["base"] for r in rows]))), "key string, abbrev string")


def overview(res: DataFrame) -> DataFrame:
    """Mean of family scores per (key, method); ``is_best`` marks every top cell."""
    cell = family_scores(res).groupBy("key", "method").agg(F.avg("value").alias("score"))
    best = F.max("score").over(Window.partitionBy("key"))
    return cell.withColumn("is_best", F.col("score") == best)


def pivot_by_dataset(cells: DataFrame, value_col: str, leg: DataFrame, index=("method",)) -> DataFrame:
    """One row per ``index``, one column per dataset abbreviation (legend order)."""
    order = [r["abbrev"] for r in leg.orderBy("pos").select("abbrev").collect()]
    j = cells.join(leg.select("key", "abbrev"), "key")
    return j.groupBy(*index).pivot("abbrev", order).agg(F.first(value_col))


def overview_table(res: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Overview pivot: formatted score, bold-marked best (``**x**``), "—" if missing."""
    ov = overview(res)
    txt = F.when(F.col("is_best"), F.concat(F.lit("**"), fmt_score(F.col("score")), F.lit("**"))) \
        .otherwise(fmt_score(F.col("score")))
    leg = legend(res, registry)
    p = pivot_by_dataset(ov.withColumn("cell", txt), "cell", leg)
    return p.na.fill("—").orderBy(*method_order())


def per_method_table(res: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    fam = family_scores(res).withColumn("cell", fmt_score(F.col("value")))
    leg = legend(res, registry)
    p = pivot_by_dataset(fam, "cell", leg, ("method", "model_family"))
    return p.na.fill("—").orderBy(*method_order(), "model_family")


def generation_times(res: DataFrame) -> DataFrame:
    """Fold-mean generation seconds per (key, method)."""
    return ok_rows(res).where(F.col("gen_elapsed_s").isNotNull()) \
        .groupBy("key", "method").agg(F.avg("gen_elapsed_s").alias("gen_s"))


def speed_median(res: DataFrame) -> DataFrame:
    """Median over datasets of the per-dataset generation time, per method."""
    return generation_times(res).groupBy("method").agg(F.median("gen_s").alias("median_s")) \
        .withColumn("median_txt", fmt_seconds(F.col("median_s")))


def feature_counts(res: DataFrame) -> DataFrame:
    """Mean column count before (final - generated) and after, per (key, method)."""
    ok = ok_rows(res).where(F.col("n_features_final").isNotNull()
                            & F.col("n_features_generated").isNotNull())
    c = ok.groupBy("key", "method").agg(
        F.avg(F.col("n_features_final") - F.col("n_features_generated")).alias("n_before"),
        F.avg("n_features_final").alias("n_after"))
    return c.withColumn("cell", fmt_before_after(F.col("n_before"), F.col("n_after")))


def grouped_scores(res: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Mean overview cell per (method, task) and per (method, sector), in one
    GROUPING SETS aggregation; ``is_best`` per group column value."""
    info = dataset_info(res, registry)
    cells = overview(res).join(info.select("key", "task", "sector"), "key")
    cells.createOrReplaceTempView("__tabprobe_cells")
    g = cells.sparkSession.sql("""
        SELECT method,
               CASE WHEN grouping(task) = 0 THEN 'task' ELSE 'sector' END AS grouping_kind,
               coalesce(task, sector) AS grp,
               avg(score) AS score
        FROM __tabprobe_cells
        GROUP BY GROUPING SETS ((method, task), (method, sector))""")
    best = F.max("score").over(Window.partitionBy("grouping_kind", "grp"))
    return g.withColumn("is_best", F.col("score") == best)


def failure_counts(res: DataFrame) -> DataFrame:
    return fail_rows(res).groupBy("key", "method", "status").agg(F.count(F.lit(1)).alias("count")) \
        .orderBy("key", "method", "status")


def run_status(res: DataFrame) -> DataFrame:
    """Rows per status plus a ``*`` total row, each with its distinct
    (key, method) pairs, in one GROUPING SETS aggregation."""
    res.select(F.coalesce("status", F.lit("?")).alias("status"), "key", "method") \
        .createOrReplaceTempView("__tabprobe_status")
    return res.sparkSession.sql("""
        SELECT CASE WHEN grouping(status) = 1 THEN '*' ELSE status END AS status,
               count(*) AS count,
               count(DISTINCT concat(key, '|', method)) AS n_pairs
        FROM __tabprobe_status
        GROUP BY GROUPING SETS ((status), ())""")


def summary_table(res: DataFrame) -> DataFrame:
    """Per family: dataset x method scores plus a per-method mean row
    (``key`` NULL), no method privileged."""
    per = ok_rows(res).groupBy("model_family", "key", "method").agg(F.avg("value").alias("value"))
    per.createOrReplaceTempView("__tabprobe_summary")
    return per.sparkSession.sql("""
        SELECT model_family, key, method, avg(value) AS value
        FROM __tabprobe_summary
        GROUP BY GROUPING SETS ((model_family, key, method), (model_family, method))""")


def summary_with_failures(res: DataFrame) -> DataFrame:
    """``summary_table`` with status ``ok``, and a row per failed (dataset, method,
    status) with its number."""
    nothing = F.lit(None)
    scores = summary_table(res).select("model_family", "key", "method", "value", F.lit("ok").alias("status"),
                                       nothing.cast("long").alias("count"))
    failed = failure_counts(res).select(nothing.cast("string").alias("model_family"), "key", "method",
                                        nothing.cast("double").alias("value"), "status", "count")
    return scores.unionByName(failed)


def failure_details(res: DataFrame) -> DataFrame:
    """Failures by the first line of their message: how many, of how many pairs."""
    return fail_rows(res).groupBy("status", first_error_line(F.col("error")).alias("message")).agg(
        F.count(F.lit(1)).alias("count"), F.count_distinct("key", "method").alias("n_pairs"))


def build_report(res: DataFrame, registry: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables by name."""
    return {
        "legend": legend(res, registry),
        "overview": overview_table(res, registry),
        "per_method": per_method_table(res, registry),
        "speed": generation_times(res),
        "speed_median": speed_median(res),
        "feature_counts": feature_counts(res),
        "grouped": grouped_scores(res, registry),
        "failures": failure_counts(res),
        "failure_details": failure_details(res),
    }
