"""The three-model panel (boosted trees, linear, kNN) and its scoring.

Linear models are Spark ML estimators, trees those of :mod:`.trees`, neighbours
those of :mod:`.knn`; metrics are aggregations over the scored test fold (see
:mod:`.metrics`).
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite_or_null
from .encoders import fit_label_coder
from .knn import knn_predict
from .metrics import auc_frame, auc_ovr_frame, regression_scores
from .trees import fit_trees

MODEL_FAMILIES = ("tree", "linear", "knn")
# protocol values
TREE_ROUNDS = 200
TREE_DEPTH = 5
TREE_STEP = 0.1
RIDGE_ALPHA = 1.0
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 1000
KNN_K = 10
KNN_SUBSAMPLE_SEED = 0
#: bytes of assembled features for one partition of a model's input
MODEL_PARTITION_BYTES = 64 << 20


def _assemble(df: DataFrame, features: list[str], n_rows: int | None = None) -> DataFrame:
    """Feature vector.  Iterative learners pass hundreds of times over the
    training input, so its partitions are sized by bytes."""
    out = VectorAssembler(inputCols=features, outputCol="__features").transform(df)
    if n_rows is not None:
        want = 1 + 8 * n_rows * (len(features) + 1) // MODEL_PARTITION_BYTES
        if want < out.rdd.getNumPartitions():
            out = out.coalesce(want)
    return out


def _has_vectors(df: DataFrame, features: list[str]) -> bool:
    return any(df.schema[f].dataType.typeName() == "vectorudt" for f in features)


def _knn_sides(train: DataFrame, test: DataFrame, row_id: str, max_train_rows: int | None):
    """Both sides with a number per row; the train side whole, or, for a
    classifier, a hash sample of ``max_train_rows`` labelled rows if asked for."""
    if max_train_rows:
        from ..operators.splits import hash_sample

        train = hash_sample(train, [row_id], max_train_rows, KNN_SUBSAMPLE_SEED)
    number = F.monotonically_increasing_id()
    return tuple(side.withColumn("__nid", number).checkpoint() for side in (train, test))


def logistic_estimator(n_rows: int) -> LogisticRegression:
    """The protocol's logistic regression (sum of losses, squared weights over 2C)."""
    return LogisticRegression(featuresCol="__features", labelCol="__c", regParam=1.0 / (LOGISTIC_C * max(n_rows, 1)),
                              elasticNetParam=0.0, standardization=False, maxIter=LOGISTIC_MAX_ITER, tol=1e-9)


def _regression_row(scored: DataFrame, pred: str) -> dict:
    r = regression_scores(scored, F.col("__y"), F.col(pred)).first()
    if r["n_missing"]:
        raise ValueError(f"no finite prediction for {r['n_missing']} test rows")
    return {"metric": "r2", "value": r["r2"], "mae": r["mae"]}


def fit_and_score(family: str, task: str, train: DataFrame, test: DataFrame,
                  features: list[str], label: str, row_id: str,
                  tree_rounds: int = TREE_ROUNDS, knn_train_rows: int | None = None) -> dict:
    """Fit ``family`` on ``train``, score ``test``: ``{metric, value[, mae]}``.

    Classification: AUC (binary if the train fold has <= 2 classes, else
    macro one-vs-rest).  Regression: R^2 plus MAE.  All test rows are scored;
    ``knn_train_rows`` bounds the labelled rows a kNN classifier keeps (default:
    all).
    """
    if family not in MODEL_FAMILIES:
        raise ValueError(f"unknown model family: {family!r}")
    if task == "regression":
        y = finite_or_null(F.col(label))
        train = train.where(y.isNotNull())
        if family == "knn":
            trs, tes = _knn_sides(train, test, row_id, None)
            pred = knn_predict(trs, tes, features, "__nid", "__nid", label, task, k=KNN_K)
            scored = tes.select(F.col("__nid").alias("qid"), y.alias("__y")) \
                .join(pred, "qid", "left")
            return _regression_row(scored, "pred")
        if family == "tree":
            forest = fit_trees(train.withColumn("__y", y), features, "__y", task, rounds=tree_rounds,
                               depth=TREE_DEPTH, rate=TREE_STEP)
            return _regression_row(forest.scored(test.withColumn("__y", y), ["__y"], "prediction"), "prediction")
        st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(y).alias("sd")).first()
        reg = RIDGE_ALPHA * (st["sd"] or 0.0) / max(st["n"], 1)
        est = LinearRegression(featuresCol="__features", labelCol="__y", regParam=reg,
                               elasticNetParam=0.0, standardization=False,
                               # the normal equations are for few columns
                               solver="l-bfgs" if _has_vectors(train, features) else "normal")
        tr_v = _assemble(train.withColumn("__y", y), features, st["n"])
        te_v = _assemble(test.withColumn("__y", y), features)
        return _regression_row(est.fit(tr_v).transform(te_v), "prediction")

    coder = fit_label_coder(train, label)
    classes = coder.classes
    code = coder.code(F.col(label))
    train = train.where(code.isNotNull())
    binary = len(classes) <= 2
    if family == "knn":
        trs, tes = _knn_sides(train, test, row_id, knn_train_rows)
        pred = knn_predict(trs, tes, features, "__nid", "__nid", label, task, classes=classes, k=KNN_K)
        scored = tes.select(F.col("__nid").alias("qid"), code.alias("__c")) \
            .join(pred, "qid", "left").withColumn("__probs", F.col("probs"))
    elif family == "tree":
        forest = fit_trees(train.withColumn("__c", code), features, "__c", task, max(len(classes), 2),
                           rounds=tree_rounds, depth=TREE_DEPTH, rate=TREE_STEP)
        scored = forest.scored(test.withColumn("__c", code), ["__c"], "__probs")
    else:
        n = train.count()
        tr_v = _assemble(train.withColumn("__c", code.cast("double")), features, n)
        te_v = _assemble(test.withColumn("__c", code), features)
        out = logistic_estimator(n).fit(tr_v).transform(te_v)
        scored = out.withColumn("__probs", vector_to_array(F.col("probability")))
    scored = scored.where(F.col("__c").isNotNull())
    if binary:
        pos = F.element_at("__probs", 2) if len(classes) == 2 else F.lit(0.0)
        r = auc_frame(scored, F.col("__c") == 1, pos).first()
        return {"metric": "auc", "value": r["auc"]}
    codes = F.array(*[F.lit(i) for i in range(len(classes))])
    per = auc_ovr_frame(scored, F.col("__c"), F.col("__probs"), codes)
    return {"metric": "auc_ovr", "value": per.agg(F.avg("auc")).first()[0]}
