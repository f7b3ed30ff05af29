"""Encoders fitted on the training fold only, applied to any fold.

Every ``fit`` reads the training frame once (per statistic) and keeps its
state either as a handful of literals (medians, means, modes: one value per
column) or as one table of entries for all columns (ordinal codes, target
statistics; see :mod:`.lookup`), of which what fits a byte budget is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite_or_null
from .lookup import BUDGET_BYTES, Lookup, build, entry_key
from .rank import ROWS_PER_BUCKET, cumulative_before, join_on, materialize

CATEGORICAL_TYPES = (T.StringType, T.BooleanType)
UNKNOWN_CODE = -1
MISSING_CODE = -2
N_OOF_FOLDS = 5


def split_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) columns by type; other types are rejected."""
    cat, num = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, CATEGORICAL_TYPES):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
        else:
            raise TypeError(f"column {f.name!r} has type {f.dataType.simpleString()}; "
                            "project it to numbers or strings first")
    return cat, num


def long_form(df: DataFrame, cols: list[str], as_type: str, ids: list[str] | tuple = ()) -> DataFrame:
    """Unpivot ``cols`` into ``(ids..., col, value)`` with one value type."""
    if not cols:
        raise ValueError("no columns to unpivot")
    tmp = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in cols])
    return tmp.unpivot(list(ids), cols, "col", "value")


# --------------------------------------------------------------------------- #
# exact medians and modes (DR based, no single-buffer percentile)
# --------------------------------------------------------------------------- #
MEDIAN_SKETCH_ACCURACY = 10_000


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Exact median (midpoint of the two middle values for even n) per column.

    Finite values only (NaN/inf count as missing).  Two passes over the columns
    alone (persisted), no row is unpivoted.  The first takes each column's count and
    a mergeable quantile sketch just below and above the middle (rank error
    <= n / accuracy).  The second counts, by conditional sums, the values below
    each bracket, and takes out those inside it (about 6 n / accuracy a column),
    which are counted per value, so that a hot value is one row, and ranked.  If a
    bracket misses the middle positions the column falls back to ranking all of
    its distinct values.
    """
    if not cols:
        return {}
    acc = MEDIAN_SKETCH_ACCURACY
    delta = 3.0 / acc
    names = [f"v{i}" for i in range(len(cols))]
    # read by each pass: persisted, so that what df derives its rows from is computed once
    wide = df.select(*[finite_or_null(F.col(c)).alias(v) for c, v in zip(cols, names)]).persist()
    try:
        return _medians_of(wide, cols, names, acc, delta)
    finally:
        wide.unpersist()


def _medians_of(wide: DataFrame, cols: list[str], names: list[str], acc: int,
                delta: float) -> dict[str, float | None]:
    spark = wide.sparkSession
    row = wide.agg(*[F.count(v).alias(f"n_{v}") for v in names],
                   *[F.percentile_approx(v, [max(0.0, 0.5 - delta), min(1.0, 0.5 + delta)], acc).alias(f"q_{v}")
                     for v in names]).first()
    found = {v: (row[f"n_{v}"], *row[f"q_{v}"]) for v in names if row[f"n_{v}"]}
    out: dict[str, float | None] = {c: None for c in cols}
    if not found:
        return out
    below = wide.agg(*[F.sum((F.col(v) < lo).cast("long")).alias(v) for v, (_, lo, _) in found.items()]).first()
    inside = wide.select(F.explode(F.filter(F.array(*[
        F.when((F.col(v) >= lo) & (F.col(v) <= hi), F.struct(F.lit(v).alias("col"), F.col(v).alias("value")))
        for v, (_, lo, hi) in found.items()]), lambda x: x.isNotNull())).alias("x")) \
        .groupBy("x.col", "x.value").agg(F.count(F.lit(1)).alias("cnt"))

    def pick(cum, offsets):
        lo = F.floor((F.col("n") - 1) / 2) - F.col("off")
        hi = F.ceil((F.col("n") - 1) / 2) - F.col("off")
        hit_lo = (F.col("cnt_before") <= lo) & (lo < F.col("cnt_before") + F.col("cnt"))
        hit_hi = (F.col("cnt_before") <= hi) & (hi < F.col("cnt_before") + F.col("cnt"))
        meta = F.broadcast(spark.createDataFrame(
            [(v, int(n), int(offsets.get(v) or 0)) for v, (n, _, _) in found.items()],
            "col string, n long, off long"))
        res = cum.join(meta, "col").where(hit_lo | hit_hi).groupBy("col").agg(
            F.max(F.when(hit_lo, F.col("value"))).alias("v_lo"),
            F.max(F.when(hit_hi, F.col("value"))).alias("v_hi"))
        return {r["col"]: (r["v_lo"], r["v_hi"]) for r in res.collect()}

    # the inside is some thousandths of each column: one window task a column up to a billion rows
    most = 6 * max(n for n, _, _ in found.values()) // acc
    got = pick(cumulative_before(inside, ["col"], "value", ["cnt"],
                                 n_buckets=1 if most <= ROWS_PER_BUCKET // 2 else None), below.asDict())
    missing = [v for v in found if None in got.get(v, (None, None))]
    if missing:   # sketch bracket missed the middle: rank every distinct value
        allv = long_form(wide, missing, "double").where(F.col("value").isNotNull()).groupBy("col", "value") \
            .agg(F.count(F.lit(1)).alias("cnt"))
        got.update(pick(cumulative_before(allv, ["col"], "value", ["cnt"]), {}))
    for c, v in zip(cols, names):
        if None not in got.get(v, (None, None)):
            out[c] = sum(got[v]) / 2.0
    return out


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-missing value per column; ties -> smallest value."""
    if not cols:
        return {}
    lf = long_form(df, cols, "string").where(F.col("value").isNotNull())
    agg = lf.groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = agg.groupBy("col").agg(
        F.min_by("value", F.struct((-F.col("cnt")).alias("k"), F.col("value").alias("v")))
        .alias("mode"))
    got = {r["col"]: r["mode"] for r in best.collect()}
    return {c: got.get(c) for c in cols}


# --------------------------------------------------------------------------- #
# E1 ordinal
# --------------------------------------------------------------------------- #
@dataclass
class OrdinalModel:
    cols: list[str]
    codes: Lookup
    seen_null: dict[str, bool]

    def _code(self, c: str, entry: Column) -> Column:
        missing = F.lit(MISSING_CODE if self.seen_null.get(c) else UNKNOWN_CODE)
        return F.when(F.col(c).isNull(), missing).otherwise(F.coalesce(entry["code"], F.lit(UNKNOWN_CODE)))

    def transform(self, df: DataFrame) -> DataFrame:
        keys = {c: F.when(F.col(c).isNotNull(), entry_key(c, F.col(c))) for c in self.cols}
        return self.codes.apply(df, keys, lambda c, e: [self._code(c, e).cast("long").alias(c)]).select(*df.columns)


def fit_ordinal(train: DataFrame, cols: list[str], budget_bytes: int = BUDGET_BYTES) -> OrdinalModel:
    """Code = position of the value among the sorted distinct train values;
    unseen -> -1; missing -> -2 if missing was seen in train, else -1."""
    lf = long_form(train, cols, "string")
    # small (one row per distinct category) and read by three actions
    agg = lf.groupBy("col", "value").agg(F.count(F.lit(1)).alias("cnt")).persist()
    seen_null = {r["col"]: True for r in agg.where(F.col("value").isNull()).select("col").collect()}
    distinct = agg.where(F.col("value").isNotNull()).withColumn("one", F.lit(1))
    entries = cumulative_before(distinct, ["col"], "value", ["one"]).select(
        entry_key(F.col("col"), F.col("value")).alias("key"), "cnt", F.col("one_before").cast("long").alias("code"))
    codes = build(materialize(entries), ["code"], budget_bytes)
    agg.unpersist()
    return OrdinalModel(list(cols), codes, seen_null)


# --------------------------------------------------------------------------- #
# E2 / E3 imputers, E5 scaler
# --------------------------------------------------------------------------- #
@dataclass
class ImputeModel:
    fill: dict[str, object]
    as_double: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = []
        for c in df.columns:
            if c in self.fill:
                v = self.fill[c]
                if self.as_double:
                    e = F.coalesce(finite_or_null(F.col(c)), F.lit(float(v) if v is not None else 0.0))
                else:
                    e = F.coalesce(F.col(c).cast("string"), F.lit(v))
                exprs.append(e.alias(c))
            else:
                exprs.append(F.col(c))
        return df.select(*exprs)


def fit_median_imputer(train: DataFrame, cols: list[str]) -> ImputeModel:
    """Train median per column; an all-missing column is filled with 0."""
    med = exact_medians(train, cols)
    return ImputeModel({c: (0.0 if v is None else v) for c, v in med.items()}, True)


def fit_mode_imputer(train: DataFrame, cols: list[str]) -> ImputeModel:
    return ImputeModel(modes(train, cols), False)


@dataclass
class ScaleModel:
    stats: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = []
        for c in df.columns:
            if c in self.stats:
                mean, std = self.stats[c]
                scale = std if (std is not None and std > 0) else 1.0
                exprs.append(((finite_or_null(F.col(c)) - F.lit(mean or 0.0)) / F.lit(scale)).alias(c))
            else:
                exprs.append(F.col(c))
        return df.select(*exprs)


def fit_scaler(train: DataFrame, cols: list[str]) -> ScaleModel:
    """Mean and population std (ddof 0) per column; zero std -> divide by 1."""
    if not cols:
        return ScaleModel({})
    aggs = []
    for c in cols:
        aggs += [F.avg(finite_or_null(F.col(c))).alias(f"m_{c}"),
                 F.stddev_pop(finite_or_null(F.col(c))).alias(f"s_{c}")]
    r = train.agg(*aggs).first()
    return ScaleModel({c: (r[f"m_{c}"], r[f"s_{c}"]) for c in cols})


# --------------------------------------------------------------------------- #
# E4 one-hot
# --------------------------------------------------------------------------- #
@dataclass
class OneHotModel:
    categories: dict[str, list[str]]

    def output_columns(self) -> list[str]:
        return [f"{c}__{i}" for c, vals in self.categories.items() for i in range(len(vals))]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(c) for c in df.columns if c not in self.categories]
        hot = []
        for c, vals in self.categories.items():
            s = F.col(c).cast("string")
            for i, v in enumerate(vals):
                hot.append(F.coalesce((s == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}__{i}"))
        return df.select(*keep, *hot)


def fit_one_hot(train: DataFrame, cols: list[str]) -> OneHotModel:
    """All train categories kept (sorted), unseen -> all zeros.  The output is
    as wide as there are categories, and so is what the driver reads."""
    if not cols:
        return OneHotModel({})
    lf = long_form(train, cols, "string").where(F.col("value").isNotNull()).distinct()
    cats: dict[str, list[str]] = {c: [] for c in cols}
    for r in lf.orderBy("col", "value").collect():
        cats[r["col"]].append(r["value"])
    return OneHotModel(cats)


@dataclass
class SparseOneHotModel:
    """One sparse vector column ``<c>__onehot`` per categorical column."""
    cols: list[str]
    codes: Lookup
    sizes: dict[str, int]

    def output_columns(self) -> list[str]:
        return [f"{c}__onehot" for c in self.cols]

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import OneHotEncoder

        def use(c, entry):
            size = self.sizes.get(c, 0)
            # an unseen or missing value has the number after the last: a slot no train row fills
            nominal = {"ml_attr": {"type": "nominal", "name": c, "num_vals": size + 1}}
            return [F.coalesce(entry["code"], F.lit(size)).cast("double").alias(f"__slot_{c}", metadata=nominal)]

        keys = {c: F.when(F.col(c).isNotNull(), entry_key(c, F.col(c))) for c in self.cols}
        slots = self.codes.apply(df, keys, use)
        hot = OneHotEncoder(inputCols=[f"__slot_{c}" for c in self.cols], outputCols=self.output_columns(),
                            dropLast=False).fit(slots)
        return hot.transform(slots).drop(*[f"__slot_{c}" for c in self.cols])


def fit_one_hot_sparse(train: DataFrame, cols: list[str], budget_bytes: int = BUDGET_BYTES) -> SparseOneHotModel:
    """One-hot coding of any number of categories: a category is a position in a
    sparse vector, found by lookup, so no column, expression or driver row is spent
    on it.  All train categories kept; an unseen value fills a position of its own
    that is zero in every train row."""
    model = fit_ordinal(train, cols, budget_bytes)
    entries = model.codes.hot if model.codes.cold is None else model.codes.hot.unionByName(model.codes.cold)
    # a number per column
    name = F.element_at(F.split("key", "\x1f"), 1)
    sizes = {r[0]: r[1] + 1 for r in entries.groupBy(name).agg(F.max("code")).collect()}
    return SparseOneHotModel(list(cols), model.codes, sizes)


# --------------------------------------------------------------------------- #
# E6 target encoding (empirical-Bayes shrinkage to the global mean)
# --------------------------------------------------------------------------- #
def _shrunk(n: Column, mean: Column, var_within: Column, g_mean: Column, g_var: Column) -> Column:
    lam = F.try_divide(g_var * n, g_var * n + var_within)
    enc = lam * mean + (F.lit(1.0) - lam) * g_mean
    return F.when(lam.isNull() | F.isnan(lam), g_mean).otherwise(enc)


def target_columns(df: DataFrame, target: str, task: str,
                   classes: list | None = None) -> tuple[list[Column], list[str]]:
    """Numeric target column(s): regression -> y; binary -> 1{y == 2nd class};
    multiclass -> one indicator per class."""
    if task == "regression":
        return [finite_or_null(F.col(target)).alias("__y0")], ["__y0"]
    if classes is None:
        raise ValueError("classification target encoding needs the train classes")
    if len(classes) <= 2:
        pos = classes[-1]
        return [(F.col(target) == F.lit(pos)).cast("double").alias("__y0")], ["__y0"]
    ys = [(F.col(target) == F.lit(k)).cast("double").alias(f"__y{i}") for i, k in enumerate(classes)]
    return ys, [f"__y{i}" for i in range(len(classes))]


#: classes of a classification; each has an output of its own
MAX_CLASSES = 10_000


def train_classes(train: DataFrame, target: str) -> list:
    """The sorted labels; more than ``MAX_CLASSES`` of them are an error."""
    found = [r[0] for r in train.select(target).where(F.col(target).isNotNull()).distinct()
             .limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target} has more than {MAX_CLASSES} classes")
    return sorted(found)


def _encoded_names(c: str, ynames: list[str]) -> list[str]:
    return [c] if len(ynames) == 1 else [f"{c}__te{y[3:]}" for y in ynames]


@dataclass
class TargetModel:
    cols: list[str]
    ynames: list[str]
    stats: Lookup                      # <y>_enc per (column, value), a missing value too
    globals_: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        def use(c, entry):
            return [F.coalesce(entry[f"{y}_enc"], F.lit(self.globals_[y])).alias(name)
                    for y, name in zip(self.ynames, _encoded_names(c, self.ynames))]

        out = self.stats.apply(df, {c: entry_key(c, F.col(c)) for c in self.cols}, use)
        return out.select(*[x for x in df.columns if x not in self.cols],
                          *[n for c in self.cols for n in _encoded_names(c, self.ynames)])


def fit_target_encoder(train: DataFrame, cols: list[str], target: str, task: str,
                       classes: list | None = None, budget_bytes: int = BUDGET_BYTES) -> TargetModel:
    """Statistics of the rows with a label (for regression: a finite one)."""
    if target not in train.columns:
        raise ValueError("target encoding needs the target column")
    if task != "regression" and classes is None:
        classes = train_classes(train, target)
    ycols, ynames = target_columns(train, target, task, classes)
    base = train.select(*[F.col(c).cast("string").alias(c) for c in cols], *ycols) \
        .where(F.col(ynames[0]).isNotNull()).persist()
    g = base.agg(*[F.avg(y).alias(f"m_{y}") for y in ynames],
                 *[F.var_pop(y).alias(f"v_{y}") for y in ynames]).first()
    globals_ = {y: g[f"m_{y}"] for y in ynames}
    lf = base.unpivot(ynames, cols, "col", "value")
    st = lf.groupBy("col", "value").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(y).alias(f"mean_{y}") for y in ynames],
        *[F.var_pop(y).alias(f"var_{y}") for y in ynames])
    entries = materialize(st.select(entry_key(F.col("col"), F.col("value")).alias("key"), F.col("n").alias("cnt"), *[
        _shrunk(F.col("n"), F.col(f"mean_{y}"), F.col(f"var_{y}"),
                F.lit(g[f"m_{y}"]), F.lit(g[f"v_{y}"])).alias(f"{y}_enc") for y in ynames]))
    stats = build(entries, [f"{y}_enc" for y in ynames], budget_bytes)
    base.unpersist()
    return TargetModel(list(cols), ynames, stats, globals_)


def oof_fold(df: DataFrame, key_cols: list[str], n_folds: int = N_OOF_FOLDS) -> Column:
    """Fold of a row for cross-fitting: first 8 hex of sha256(key text) mod n."""
    from ..functions.scalar import key_text

    return F.pmod(F.conv(F.substring(F.sha2(key_text(df, key_cols), 256), 1, 8), 16, 10).cast("long"),
                  F.lit(n_folds)).cast("int")


def target_encode_oof(train: DataFrame, cols: list[str], target: str, task: str,
                      key_cols: list[str], classes: list | None = None,
                      n_folds: int = N_OOF_FOLDS, budget_bytes: int = BUDGET_BYTES) -> DataFrame:
    """Out-of-fold target encoding of the training rows themselves.

    Each row is encoded with statistics of the other folds only
    (per-fold stats = total stats - the fold's own stats), so a row never
    sees its own label.
    """
    if task != "regression" and classes is None:
        classes = train_classes(train, target)
    ycols, ynames = target_columns(train, target, task, classes)
    base = train.withColumn("__fold", oof_fold(train, key_cols, n_folds))
    yb = base.select("__fold", *[F.col(c).cast("string").alias(c) for c in cols], *ycols) \
        .where(F.col(ynames[0]).isNotNull())
    # sums are taken around the mean, so that a far-off target doesn't cancel
    mean_row = yb.agg(*[F.avg(y).alias(y) for y in ynames]).first()
    centre = {y: float(mean_row[y] or 0.0) for y in ynames}
    yb = yb.withColumns({y: F.col(y) - F.lit(centre[y]) for y in ynames}).persist()

    def sums(df, keys):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     *[F.sum(y).alias(f"s_{y}") for y in ynames],
                                     *[F.sum(F.col(y) * F.col(y)).alias(f"q_{y}") for y in ynames])

    gf = sums(yb, ["__fold"])
    gt = gf.agg(F.sum("n").alias("n"), *[F.sum(f"s_{y}").alias(f"s_{y}") for y in ynames],
                *[F.sum(f"q_{y}").alias(f"q_{y}") for y in ynames]).first()
    glob = {r["__fold"]: r for r in gf.collect()}
    lf = yb.unpivot(["__fold", *ynames], cols, "col", "value")
    per_fold = sums(lf, ["col", "value", "__fold"])
    tot = sums(lf, ["col", "value"])
    per_fold = materialize(per_fold, likely_large=True)   # joined back to its own totals
    stats = join_on(tot, per_fold.select("col", "value", "__fold", *[
        F.col(x).alias(f"f_{x}") for x in ["n", *[f"s_{y}" for y in ynames], *[f"q_{y}" for y in ynames]]]),
        ["col", "value"], "left")
    # out-of-fold totals per fold for the global statistics (n_folds literals)
    folds = list(range(n_folds))

    def g_of(name: str, f: Column) -> Column:
        e = F.lit(None).cast("double")
        for k in folds:
            r = glob.get(k)
            v = float(gt[name] - (r[name] if r is not None else 0))
            e = F.when(f == k, F.lit(v)).otherwise(e)
        return e

    out_cols = []
    for y in ynames:
        n = F.col("n") - F.col("f_n")
        s = F.col(f"s_{y}") - F.col(f"f_s_{y}")
        q = F.col(f"q_{y}") - F.col(f"f_q_{y}")
        mean = F.try_divide(s, n)
        var_w = F.try_divide(q, n) - mean * mean
        gn = g_of("n", F.col("__fold"))
        gm = F.try_divide(g_of(f"s_{y}", F.col("__fold")), gn)
        gv = F.try_divide(g_of(f"q_{y}", F.col("__fold")), gn) - gm * gm
        enc = F.when(n > 0, _shrunk(n, mean, var_w, gm, gv)).otherwise(gm)
        out_cols.append((enc + F.lit(centre[y])).alias(f"{y}_enc"))
    entries = materialize(stats.select(
        entry_key(F.col("col"), F.col("value"), F.col("__fold")).alias("key"), F.col("f_n").alias("cnt"), *out_cols))
    table = build(entries, [f"{y}_enc" for y in ynames], budget_bytes)
    yb.unpersist()
    unseen = {y: F.try_divide(g_of(f"s_{y}", F.col("__fold")), g_of("n", F.col("__fold"))) + F.lit(centre[y])
              for y in ynames}

    def use(c, entry):
        return [F.coalesce(entry[f"{y}_enc"], unseen[y]).alias(name)
                for y, name in zip(ynames, _encoded_names(c, ynames))]

    out = table.apply(base, {c: entry_key(c, F.col(c), F.col("__fold")) for c in cols}, use)
    return out.select(*[x for x in train.columns if x not in cols],
                      *[n for c in cols for n in _encoded_names(c, ynames)])


# --------------------------------------------------------------------------- #
# E7-E10 composites
# --------------------------------------------------------------------------- #
@dataclass
class CrossFitted:
    """Target codes: those of the training rows come from the other folds, all other
    rows' from the whole training fold."""
    model: TargetModel
    target: str
    task: str
    key_cols: list[str]
    classes: list | None

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def transform_train(self, df: DataFrame) -> DataFrame:
        return target_encode_oof(df, self.model.cols, self.target, self.task, self.key_cols, self.classes)


def _target_step(train: DataFrame, cat: list[str], target: str | None, task: str, encoding: str,
                 key_cols: list[str] | None):
    if target is None:
        raise ValueError(f"{encoding} encoding needs the target")
    classes = None if task == "regression" else train_classes(train, target)
    model = fit_target_encoder(train, cat, target, task, classes)
    if encoding == "target":
        return model
    if not key_cols:
        raise ValueError("cross-fitted target encoding needs the row key")
    return CrossFitted(model, target, task, list(key_cols), classes)


@dataclass
class Chain:
    steps: list = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def transform_train(self, df: DataFrame) -> DataFrame:
        """The training rows themselves: as ``transform``, but for cross-fitted codes."""
        for s in self.steps:
            df = getattr(s, "transform_train", s.transform)(df)
        return df

    @property
    def categorical_columns(self) -> tuple[str, ...]:
        return tuple(self.categorical)


class _CastDouble:
    def __init__(self, cols):
        self.cols = set(cols)

    def transform(self, df):
        return df.select(*[F.col(c).cast("double").alias(c) if c in self.cols else F.col(c)
                           for c in df.columns])


class _CleanInf:
    def __init__(self, cols):
        self.cols = set(cols)

    def transform(self, df):
        return df.select(*[finite_or_null(F.col(c)).alias(c) if c in self.cols else F.col(c)
                           for c in df.columns])


def fit_prep_for_generation(train: DataFrame, features: list[str], categorical: list[str]) -> Chain:
    """Ordinal-code categoricals + median-impute numerics, then all double."""
    num = [c for c in features if c not in categorical]
    steps = []
    if categorical:
        steps.append(fit_ordinal(train, categorical))
    if num:
        steps.append(fit_median_imputer(train, num))
    steps.append(_CastDouble(features))
    return Chain(steps, list(categorical))


def fit_tree_encoder(train: DataFrame, features: list[str], target: str | None = None,
                     task: str = "classification", categorical_encoding: str = "ordinal",
                     key_cols: list[str] | None = None) -> Chain:
    """``categorical_encoding``: ordinal, target or target_oof."""
    cat, _ = split_columns(train.select(*features))
    if categorical_encoding == "ordinal":
        return Chain([fit_ordinal(train, cat)] if cat else [], cat)
    if categorical_encoding not in ("target", "target_oof"):
        raise ValueError(f"unknown categorical encoding {categorical_encoding!r}")
    if target is None:
        raise ValueError(f"{categorical_encoding} encoding needs the target")
    return Chain([_target_step(train, cat, target, task, categorical_encoding, key_cols)] if cat else [], cat)


def fit_linear_encoder(train: DataFrame, features: list[str], target: str | None = None,
                       task: str = "classification", categorical_encoding: str = "onehot",
                       key_cols: list[str] | None = None) -> Chain:
    """``categorical_encoding``: onehot (a column per category), onehot_sparse (a sparse
    vector per column), target or target_oof."""
    cat, num = split_columns(train.select(*features))
    steps = []
    if num:
        imp = fit_median_imputer(train, num)
        steps.append(imp)
        steps.append(fit_scaler(imp.transform(train.select(*num)), num))
    if cat:
        mode = fit_mode_imputer(train, cat)
        steps.append(mode)
        filled = mode.transform(train.select(*cat, *([target] if target else [])))
        if categorical_encoding == "onehot":
            steps.append(fit_one_hot(filled, cat))
        elif categorical_encoding == "onehot_sparse":
            steps.append(fit_one_hot_sparse(filled, cat))
        elif categorical_encoding in ("target", "target_oof"):
            steps.append(_target_step(filled, cat, target, task, categorical_encoding, key_cols))
        else:
            raise ValueError(f"unknown categorical encoding {categorical_encoding!r}")
    return Chain(steps, cat)


def fit_family_input(family: str, train: DataFrame, features: list[str]) -> Chain:
    """tree: +-inf -> missing; linear/knn: that, then median impute and scale."""
    steps = [_CleanInf(features)]
    if family == "tree":
        return Chain(steps)
    clean = _CleanInf(features).transform(train.select(*features)).persist()
    imp = fit_median_imputer(clean, features)
    steps.append(imp)
    steps.append(fit_scaler(imp.transform(clean), features))
    clean.unpersist()
    return Chain(steps)


@dataclass
class LabelCoder:
    classes: list

    def code(self, c: Column) -> Column:
        """Position of the label among the classes, NULL if it is none of them."""
        at = F.array_position(F.array(*[F.lit(k) for k in self.classes]), c) if self.classes else F.lit(0)
        return F.when(at > 0, (at - 1).cast("int"))


def fit_label_coder(train: DataFrame, target: str) -> LabelCoder:
    """Class codes by sorted train label (unseen test labels -> NULL)."""
    return LabelCoder(train_classes(train, target))
