"""Registered workloads: each library operator run over the given tables.

``SPARK[name](spark, sf_dir) -> DataFrame`` runs the operator through the
library; ``SQL[name]`` is an independent ANSI-SQL statement of the same
result (DuckDB dialect) over the raw tables.  Doubles are rounded to 6
decimals on both sides.  Datasets used below:

* ``lineitem`` -- regression on ``l_extendedprice``, row key of six columns;
* ``orders ⋈ customer`` -- 3-class ``o_orderstatus``, key ``o_orderkey``;
* ``documents ⋈ labels`` -- binary ``quality``, key ``doc_id``;
* ``embeddings`` -- 10-class ``label``, 64 positional features;
* ``part`` -- regression on ``p_retailprice``;
* a result-shaped table derived row by row from ``events``.
Missing values are injected by fixed rules on key columns (same rule in both).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import initials
from ..operators import association as A
from ..operators import encoders as E
from ..operators.knn import knn_neighbors, knn_predict
from ..operators.metrics import auc_frame, auc_ovr_frame, regression_scores
from ..operators.rank import materialize
from ..operators.splits import add_split, class_counts, hash_sample, overlap_check, train_test
from ..sources import catalog as C
from ..sources.tables import (Dataset, assemble_on_shared, attach_labels, column_profile, densify,
                              duplicate_fingerprints, fingerprint, flatten_arrays,
                              infer_task_columns, profile, read_table, union_parts)
from . import report as R

SPARK: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------- #
# shared datasets (Spark side)
# --------------------------------------------------------------------------- #
LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LI_OUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def li_nulls(spark, sf) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    return li.withColumn("l_quantity", F.when(F.col("l_linenumber") % 7 == 0, F.lit(None))
                         .otherwise(F.col("l_quantity"))) \
             .withColumn("l_discount", F.when(F.col("l_orderkey") % 5 == 0, F.lit(None))
                         .otherwise(F.col("l_discount")))


def li_split(spark, sf, nulls=False) -> DataFrame:
    li = li_nulls(spark, sf) if nulls else read_table(spark, sf, "lineitem")
    return add_split(li, LI_KEYS, "lineitem")


def orders_customer(spark, sf) -> DataFrame:
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                               "o_totalprice", "o_orderpriority")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal",
                                                 "c_mktsegment")
    oc = o.join(c, o.o_custkey == c.c_custkey, "left").drop("c_custkey")
    return oc.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 11 == 0, F.lit(None))
                         .otherwise(F.col("o_orderpriority"))) \
             .withColumn("c_acctbal", F.when(F.col("o_orderkey") % 13 == 0, F.lit(None))
                         .otherwise(F.col("c_acctbal")))


def oc_split(spark, sf) -> DataFrame:
    return add_split(orders_customer(spark, sf), ["o_orderkey"], "orders", "o_orderstatus", True)


def docs_labels(spark, sf) -> DataFrame:
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    return attach_labels(d, lab, ["doc_id"]).withColumn("text_len", F.length("text").cast("long"))


def dl_split(spark, sf) -> DataFrame:
    return add_split(docs_labels(spark, sf), ["doc_id"], "documents", "quality", True)


def emb_split(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    flat = flatten_arrays(e, "embedding", 64, keep=["vec_id", "label"])
    return add_split(flat, ["vec_id"], "embeddings", "label", True)


# --------------------------------------------------------------------------- #
# shared datasets (SQL side)
# --------------------------------------------------------------------------- #
def seed_sql(key: str) -> str:
    return f"((20260101 + ('0x' || substr(sha256('{key}'), 1, 8))::BIGINT) % 4294967295)"


def key_sql(*parts: tuple[str, str]) -> str:
    """The lossless key text of (type tag, column) parts."""
    texts = {"c": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"}
    out = []
    for tag, c in parts:
        text = texts.get(tag, "CAST({c} AS VARCHAR)").format(c=c)
        out.append(f"coalesce('{tag}' || length({text}) || ':' || {text}, 'n')")
    return " || ".join(out)


LI_KEYTXT = key_sql(("i", "l_orderkey"), ("i", "l_linenumber"), ("i", "l_partkey"), ("i", "l_suppkey"),
                    ("c", "l_shipdate"), ("d", "l_extendedprice"))
LI_NULLS_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    l_extendedprice, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem"""
OC_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    c_nationkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
DL_SQL = """SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
    length(d.text)::BIGINT AS text_len FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def holdout_sql(src: str, key: str, keytxt: str) -> str:
    return f"""(SELECT *, rn <= round(n * 0.2) AS is_test FROM (
        SELECT *, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM (
        SELECT *, sha256(concat_ws(':', {seed_sql(key)}, {keytxt})) AS h FROM ({src}) s0) s1) s2)"""


def strat_sql(src: str, key: str, keytxt: str, label: str) -> str:
    return f"""(SELECT *, CASE WHEN {label} IS NULL THEN false ELSE rn <= round(n * 0.2) END AS is_test FROM (
        SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY h) AS rn,
               count(*) OVER (PARTITION BY {label}) AS n FROM (
        SELECT *, sha256(concat_ws(':', {seed_sql(key)}, {keytxt})) AS h FROM ({src}) s0) s1) s2)"""


LI_SPLIT = holdout_sql("SELECT * FROM lineitem", "lineitem", LI_KEYTXT)
LI_NULL_SPLIT = holdout_sql(LI_NULLS_SQL, "lineitem", LI_KEYTXT)
OC_SPLIT = strat_sql(OC_SQL, "orders", key_sql(("i", "o_orderkey")), "o_orderstatus")
DL_SPLIT = strat_sql(DL_SQL, "documents", key_sql(("i", "doc_id")), "quality")
EMB_FLAT = "SELECT vec_id, label, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS f{i}" for i in range(64)) + " FROM embeddings"
EMB_SPLIT = strat_sql(EMB_FLAT, "embeddings", key_sql(("i", "vec_id")), "label")
PART_SPLIT = holdout_sql("SELECT * FROM part", "part", key_sql(("i", "p_partkey")))


# --------------------------------------------------------------------------- #
# Phase 1: data
# --------------------------------------------------------------------------- #
@register("dataset_profile", """
SELECT 'lineitem' AS name, count(*) AS n_rows, 10::BIGINT AS n_features, 2::BIGINT AS n_categorical,
       'l_extendedprice' AS target,
       CASE WHEN count(DISTINCT l_extendedprice) <= 2 THEN 'classification' ELSE 'regression' END AS task
FROM lineitem""")
def q_dataset_profile(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return profile(Dataset("lineitem", li, "l_extendedprice", LI_KEYS))


_PROF_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus"]
SQL["column_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{'categorical' if c in ('l_returnflag', 'l_linestatus') else 'numeric'}' AS kind, "
    f"count(DISTINCT {c}) AS n_distinct, sum(({c} IS NULL)::BIGINT)::BIGINT AS n_missing, "
    f"count(DISTINCT {c}) <= 1 AS is_constant FROM ({LI_NULLS_SQL}) t" for c in _PROF_COLS)


@register("column_profile")
def q_column_profile(spark, sf):
    return column_profile(li_nulls(spark, sf), _PROF_COLS)


_TASK_COLS = {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float",
              "o_orderpriority": "str", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "str"}


def _task_case(c, kind):
    if kind == "str":
        return "'classification'"
    if kind == "float":
        return f"CASE WHEN count(DISTINCT {c}) <= 2 THEN 'classification' ELSE 'regression' END"
    return (f"CASE WHEN count(DISTINCT {c}) <= least(20, greatest(2, count(*) // 20)) "
            "THEN 'classification' ELSE 'regression' END")


SQL["infer_task_cols"] = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, {_task_case(c, k)} AS task "
    f"FROM ({OC_SQL}) t" for c, k in _TASK_COLS.items())


@register("infer_task_cols")
def q_infer_task_cols(spark, sf):
    return infer_task_columns(orders_customer(spark, sf), list(_TASK_COLS))


@register("assemble_left", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderpriority,
       c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name, n.n_regionkey
FROM orders o
LEFT JOIN customer c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey
LEFT JOIN nation n ON c.c_nationkey IS NOT DISTINCT FROM n.n_nationkey""")
def q_assemble_left(spark, sf):
    o = read_table(spark, sf, "orders").drop("o_orderdate")
    c = read_table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = read_table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return assemble_on_shared([c, o, n], "o_orderstatus")


SQL["flatten_array"] = EMB_FLAT


@register("flatten_array")
def q_flatten_array(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return flatten_arrays(e, "embedding", 64, keep=["vec_id", "label"])


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
SQL["densify_pivot"] = "SELECT user_id, " + ", ".join(
    f"round(coalesce(sum(CASE WHEN event_type = '{t}' THEN value END), 0), 6) AS {t}"
    for t in _EVENT_TYPES) + " FROM events GROUP BY user_id"


@register("densify_pivot")
def q_densify_pivot(spark, sf):
    ev = read_table(spark, sf, "events")
    wide = densify(ev, "user_id", "event_type", "value")
    return wide.select("user_id", *[r6(F.col(c)).alias(c) for c in wide.columns if c != "user_id"])


@register("union_parts", """
SELECT doc_id, lang, n_chars, CASE WHEN lang = 'en' THEN NULL ELSE source END AS source FROM documents""")
def q_union_parts(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    langs = [r[0] for r in d.select("lang").distinct().orderBy("lang").collect()]
    parts = [d.where(F.col("lang") == lg).drop("source") if lg == "en" else d.where(F.col("lang") == lg)
             for lg in langs]
    return union_parts(parts)


@register("label_join", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_label_join(spark, sf):
    return docs_labels(spark, sf).select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


# fixed values: the schema text of the fingerprinted tables, as Spark names the types
_FP_SCHEMAS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
}


def _schema_json(cols):
    import json

    return json.dumps({"columns": sorted(c for c, _ in cols),
                       "dtypes": sorted(f"{c}:{t}" for c, t in cols)}, separators=(",", ":"))


def _fp_sql():
    parts = []
    for name, cols in list(_FP_SCHEMAS.items()) + [("region_copy", _FP_SCHEMAS["region"])]:
        src = "region" if name == "region_copy" else name
        txt = _schema_json(cols).replace("'", "''")
        parts.append(f"SELECT '{name}' AS name, count(*) AS n_rows, {len(cols)}::BIGINT AS n_cols, "
                     f"substr(sha256(concat(count(*)::VARCHAR, ':{len(cols)}:', '{txt}')), 1, 16) AS fingerprint "
                     f"FROM {src}")
    return " UNION ALL ".join(parts)


SQL["fingerprint"] = _fp_sql()


def _fingerprints(spark, sf):
    fps = [fingerprint(read_table(spark, sf, n), n) for n in _FP_SCHEMAS]
    fps.append(fingerprint(read_table(spark, sf, "region"), "region_copy"))
    return union_parts(fps)


@register("fingerprint")
def q_fingerprint(spark, sf):
    return _fingerprints(spark, sf)


SQL["duplicate_tables"] = f"""
SELECT fingerprint, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names
FROM ({_fp_sql()}) t GROUP BY fingerprint HAVING count(*) > 1"""


@register("duplicate_tables")
def q_duplicate_tables(spark, sf):
    d = duplicate_fingerprints(_fingerprints(spark, sf))
    return d.select("fingerprint", "n", F.array_join("names", ",").alias("names"))


# --------------------------------------------------------------------------- #
# Phase 2: splits
# --------------------------------------------------------------------------- #
@register("split_holdout", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, is_test FROM {LI_SPLIT} t""")
def q_split_holdout(spark, sf):
    return li_split(spark, sf).select(*LI_OUT, "is_test")


@register("split_stratified", f"SELECT o_orderkey, o_orderstatus, is_test FROM {OC_SPLIT} t")
def q_split_stratified(spark, sf):
    return oc_split(spark, sf).select("o_orderkey", "o_orderstatus", "is_test")


@register("split_stratified_multiclass", f"SELECT vec_id, label, is_test FROM {EMB_SPLIT} t")
def q_split_stratified_multiclass(spark, sf):
    return emb_split(spark, sf).select("vec_id", "label", "is_test")


@register("split_class_counts", f"""
SELECT o_orderstatus, count(*) AS n, sum(is_test::BIGINT)::BIGINT AS n_test,
       sum((NOT is_test)::BIGINT)::BIGINT AS n_train
FROM {OC_SPLIT} t GROUP BY o_orderstatus""")
def q_split_class_counts(spark, sf):
    return class_counts(oc_split(spark, sf), "o_orderstatus")


@register("split_overlap_check", f"""
SELECT 0::BIGINT AS n_overlap, sum((NOT is_test)::BIGINT)::BIGINT AS n_train,
       sum(is_test::BIGINT)::BIGINT AS n_test,
       count(*) AS n_total, 0::BIGINT AS n_uncovered FROM {LI_SPLIT} t""")
def q_split_overlap_check(spark, sf):
    return overlap_check(li_split(spark, sf), LI_KEYS)


@register("fit_sample_topk", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (ORDER BY sha256(concat_ws(':', '0', {LI_KEYTXT}))) AS rk
  FROM {LI_SPLIT} t WHERE NOT is_test) u WHERE rk <= 20000""")
def q_fit_sample_topk(spark, sf):
    tr, _ = train_test(li_split(spark, sf))
    return hash_sample(tr, LI_KEYS, 20_000, seed=0).select(*LI_OUT)


# --------------------------------------------------------------------------- #
# result-shaped table and registry derived from events
# --------------------------------------------------------------------------- #
TASK_RULE = ("CASE ascii(event_type) % 3 WHEN 0 THEN 'classification' WHEN 1 THEN 'multiclass' "
             "ELSE 'regression' END")
SECTOR_RULE = ("CASE ascii(event_type) % 4 WHEN 0 THEN 'finance' WHEN 1 THEN 'healthcare' "
               "WHEN 2 THEN 'retail' ELSE 'web' END")
STATUS_RULE = ("CASE WHEN event_id % 17 = 0 THEN 'error' WHEN event_id % 29 = 0 THEN 'timeout' "
               "ELSE 'ok' END")
RESULT_EXPRS = [
    "event_type AS key",
    "CASE user_id % 3 WHEN 0 THEN 'baseline' ELSE concat('m', CAST(user_id % 3 AS STRING)) END AS method",
    "concat('split', CAST(event_id % 2 AS STRING)) AS fold_id",
    "'holdout' AS protocol",
    f"{TASK_RULE} AS task",
    f"{STATUS_RULE} AS status",
    f"CASE WHEN {STATUS_RULE} = 'ok' THEN value * 2 END AS gen_elapsed_s",
    f"CASE WHEN {STATUS_RULE} = 'ok' THEN CASE event_id % 3 WHEN 0 THEN 'tree' WHEN 1 THEN 'linear' "
    "ELSE 'knn' END END AS model_family",
    f"CASE WHEN {STATUS_RULE} = 'ok' THEN user_id % 5 END AS n_features_generated",
    f"CASE WHEN {STATUS_RULE} = 'ok' THEN 8 + user_id % 5 END AS n_features_final",
    f"CASE WHEN {STATUS_RULE} = 'ok' THEN CASE {TASK_RULE} WHEN 'regression' THEN 'r2' "
    "WHEN 'multiclass' THEN 'auc_ovr' ELSE 'auc' END END AS metric",
    f"CASE WHEN {STATUS_RULE} = 'ok' THEN value / 500 END AS value",
    f"CASE WHEN {STATUS_RULE} <> 'ok' THEN concat('failed at event ', CAST(event_id AS STRING)) END AS error",
]
RES_SQL = "SELECT " + ", ".join(RESULT_EXPRS) + " FROM events"
REGISTRY_EXPRS = [
    "event_type AS key",
    "concat(upper(substr(event_type, 1, 1)), substr(event_type, 2)) AS display",
    f"{TASK_RULE} AS task",
    f"{SECTOR_RULE} AS sector",
    "CASE WHEN count(*) < 1990 THEN 'small' WHEN count(*) < 2010 THEN 'medium' ELSE 'large' END AS scale",
    "'events' AS source",
    "concat(event_type, '-v1') AS fetch_key",
    "concat(upper(event_type), ',', event_type, 's') AS aliases_txt",
    "count(*) AS n_rows",
]
REG_SQL = "SELECT " + ", ".join(REGISTRY_EXPRS) + " FROM events GROUP BY event_type"


def results_table(spark, sf) -> DataFrame:
    from ..sources.results import RESULT_SCHEMA

    ev = read_table(spark, sf, "events").selectExpr(*RESULT_EXPRS)
    cols = []
    for f in RESULT_SCHEMA.fields:
        cols.append(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in ev.columns
                    else F.lit(None).cast(f.dataType).alias(f.name))
    return ev.select(*cols)


def registry_table(spark, sf) -> DataFrame:
    ev = read_table(spark, sf, "events")
    reg = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("__n")) \
        .selectExpr(*[e.replace("count(*)", "__n") for e in REGISTRY_EXPRS])
    return reg.withColumn("aliases", F.split("aliases_txt", ",")) \
        .withColumn("pos", F.row_number().over(Window.orderBy("key")) - 1)


# --------------------------------------------------------------------------- #
# Phase 2b: split plan
# --------------------------------------------------------------------------- #
SQL["split_plan"] = f"""
SELECT key, 'holdout' AS protocol,
       ((20260101 + ('0x' || substr(sha256(key), 1, 8))::BIGINT) % 4294967295) AS seed,
       0.2::DOUBLE AS test_size, task <> 'regression' AS stratify FROM ({REG_SQL}) r"""


@register("split_plan")
def q_split_plan(spark, sf):
    return C.split_plan(registry_table(spark, sf))


# --------------------------------------------------------------------------- #
# Phase 3: encoders
# --------------------------------------------------------------------------- #
def _ord_sql(col, slice_pred):
    return f"""
  d_{col} AS (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code FROM (
      SELECT DISTINCT {col} AS v FROM s WHERE NOT is_test AND {slice_pred} AND {col} IS NOT NULL) x),
  n_{col} AS (SELECT count(*) > 0 AS seen FROM s WHERE NOT is_test AND {slice_pred} AND {col} IS NULL)"""


def _ord_expr(col):
    return (f"CASE WHEN s.{col} IS NULL THEN (CASE WHEN (SELECT seen FROM n_{col}) THEN -2 ELSE -1 END) "
            f"ELSE coalesce((SELECT code FROM d_{col} WHERE v = s.{col}), -1) END::BIGINT")


_SLICE = "o_orderpriority IS DISTINCT FROM '5-LOW'"
SQL["ordinal_encode"] = f"""
WITH s AS {OC_SPLIT},{_ord_sql('o_orderpriority', _SLICE)},{_ord_sql('c_mktsegment', _SLICE)}
SELECT o_orderkey, is_test, {_ord_expr('o_orderpriority')} AS o_orderpriority,
       {_ord_expr('c_mktsegment')} AS c_mktsegment FROM s"""


@register("ordinal_encode")
def q_ordinal_encode(spark, sf):
    s = oc_split(spark, sf)
    tr = s.where(~F.col("is_test") & ~F.col("o_orderpriority").eqNullSafe("5-LOW"))
    m = E.fit_ordinal(tr, ["o_orderpriority", "c_mktsegment"])
    return m.transform(s).select("o_orderkey", "is_test", "o_orderpriority", "c_mktsegment")


SQL["median_impute"] = f"""
WITH s AS {LI_NULL_SPLIT},
  m AS (SELECT median(l_quantity) AS mq, median(l_discount) AS md FROM s WHERE NOT is_test)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, is_test,
       round(coalesce(l_quantity, (SELECT mq FROM m)), 6) AS l_quantity,
       round(coalesce(l_discount, (SELECT md FROM m)), 6) AS l_discount FROM s"""


@register("median_impute")
def q_median_impute(spark, sf):
    s = li_split(spark, sf, nulls=True)
    tr, _ = train_test(s)
    m = E.fit_median_imputer(tr, ["l_quantity", "l_discount"])
    out = m.transform(s.select(*LI_OUT, "is_test", "l_quantity", "l_discount"))
    return out.select(*LI_OUT, "is_test", r6(F.col("l_quantity")).alias("l_quantity"),
                      r6(F.col("l_discount")).alias("l_discount"))


SQL["mode_impute"] = f"""
WITH s AS {OC_SPLIT},
  m AS (SELECT o_orderpriority AS v FROM s WHERE NOT is_test AND o_orderpriority IS NOT NULL
        GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1)
SELECT o_orderkey, is_test, coalesce(o_orderpriority, (SELECT v FROM m)) AS o_orderpriority FROM s"""


@register("mode_impute")
def q_mode_impute(spark, sf):
    s = oc_split(spark, sf)
    tr, _ = train_test(s)
    m = E.fit_mode_imputer(tr, ["o_orderpriority"])
    return m.transform(s.select("o_orderkey", "is_test", "o_orderpriority"))


_Z = ["l_quantity", "l_discount", "l_tax"]
SQL["standardize"] = f"""
WITH s AS {LI_SPLIT},
  m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _Z)} FROM s WHERE NOT is_test)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, is_test,
  {', '.join(f'round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}' for c in _Z)}
FROM s, m"""


@register("standardize")
def q_standardize(spark, sf):
    s = li_split(spark, sf)
    tr, _ = train_test(s)
    m = E.fit_scaler(tr, _Z)
    out = m.transform(s.select(*LI_OUT, "is_test", *_Z))
    return out.select(*LI_OUT, "is_test", *[r6(F.col(c)).alias(c) for c in _Z])


SQL["one_hot"] = f"""
WITH s AS {OC_SPLIT},
  c AS (SELECT v, (row_number() OVER (ORDER BY v) - 1) AS i FROM (
        SELECT DISTINCT c_mktsegment AS v FROM s WHERE NOT is_test AND c_mktsegment <> 'MACHINERY') x)
SELECT o_orderkey, is_test,
  {', '.join(f"coalesce((c_mktsegment = (SELECT v FROM c WHERE i = {i}))::DOUBLE, 0.0) AS c_mktsegment__{i}"
             for i in range(4))}
FROM s"""


@register("one_hot")
def q_one_hot(spark, sf):
    s = oc_split(spark, sf)
    tr = s.where(~F.col("is_test") & (F.col("c_mktsegment") != "MACHINERY"))
    m = E.fit_one_hot(tr, ["c_mktsegment"])
    return m.transform(s.select("o_orderkey", "is_test", "c_mktsegment"))


def _te_sql(split, key, y, cats):
    blocks = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, count(*) AS n, avg(y) AS m, var_pop(y) AS vw "
        f"FROM tr GROUP BY {c}" for c in cats)
    enc = ("CASE WHEN g.gv * st.n + st.vw = 0 THEN g.gm ELSE "
           "(g.gv * st.n / (g.gv * st.n + st.vw)) * st.m + (1 - g.gv * st.n / (g.gv * st.n + st.vw)) * g.gm END")
    sel = ", ".join(
        f"round(coalesce((SELECT {enc} FROM st, g WHERE st.col = '{c}' AND st.v IS NOT DISTINCT FROM "
        f"CAST(s.{c} AS VARCHAR)), (SELECT gm FROM g)), 6) AS {c}" for c in cats)
    return f"""
WITH s AS {split},
  tr AS (SELECT *, {y} AS y FROM s WHERE NOT is_test AND ({y}) IS NOT NULL),
  g AS (SELECT avg(y) AS gm, var_pop(y) AS gv FROM tr),
  st AS ({blocks})
SELECT {key}, is_test, {sel} FROM s"""


SQL["target_encode_bin"] = _te_sql(DL_SPLIT, "doc_id", "(quality = 1)::DOUBLE", ["lang", "source"])


@register("target_encode_bin")
def q_target_encode_bin(spark, sf):
    s = dl_split(spark, sf)
    tr, _ = train_test(s)
    m = E.fit_target_encoder(tr, ["lang", "source"], "quality", "classification")
    out = m.transform(s.select("doc_id", "is_test", "lang", "source"))
    return out.select("doc_id", "is_test", r6(F.col("lang")).alias("lang"),
                      r6(F.col("source")).alias("source"))


SQL["target_encode_reg"] = _te_sql(PART_SPLIT, "p_partkey", "p_retailprice", ["p_brand", "p_type"])


@register("target_encode_reg")
def q_target_encode_reg(spark, sf):
    s = add_split(read_table(spark, sf, "part"), ["p_partkey"], "part")
    tr, _ = train_test(s)
    m = E.fit_target_encoder(tr, ["p_brand", "p_type"], "p_retailprice", "regression")
    out = m.transform(s.select("p_partkey", "is_test", "p_brand", "p_type", "p_retailprice"))
    return out.select("p_partkey", "is_test", r6(F.col("p_brand")).alias("p_brand"),
                      r6(F.col("p_type")).alias("p_type"))


def _oof_sql():
    cats = ["lang", "source"]
    blocks_t = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v, count(*) AS n, sum(y) AS sy, sum(y * y) AS qy FROM ty GROUP BY {c}"
        for c in cats)
    blocks_f = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v, fold, count(*) AS n, sum(y) AS sy, sum(y * y) AS qy "
        f"FROM ty GROUP BY {c}, fold" for c in cats)
    sel = []
    for c in cats:
        sel.append(f"round(coalesce((SELECT enc FROM e WHERE e.col = '{c}' AND e.v = tr.{c} "
                   f"AND e.fold = tr.fold), (SELECT gm FROM go WHERE go.fold = tr.fold)), 6) AS {c}")
    return f"""
WITH s AS {DL_SPLIT},
  tr AS (SELECT *, (quality = 1)::DOUBLE AS y,
         (('0x' || substr(sha256({key_sql(("i", "doc_id"))}), 1, 8))::BIGINT % 5)::INTEGER AS fold
         FROM s WHERE NOT is_test),
  ty AS (SELECT * FROM tr WHERE y IS NOT NULL),
  gt AS (SELECT count(*) AS n, sum(y) AS sy, sum(y * y) AS qy FROM ty),
  gf AS (SELECT fold, count(*) AS n, sum(y) AS sy, sum(y * y) AS qy FROM ty GROUP BY fold),
  go AS (SELECT gf.fold, (gt.sy - gf.sy) / (gt.n - gf.n) AS gm,
                (gt.qy - gf.qy) / (gt.n - gf.n) - ((gt.sy - gf.sy) / (gt.n - gf.n)) ^ 2 AS gv
         FROM gf, gt),
  t AS ({blocks_t}),
  f AS ({blocks_f}),
  o AS (SELECT t.col, t.v, f.fold, t.n - f.n AS n, t.sy - f.sy AS sy, t.qy - f.qy AS qy
        FROM t JOIN f ON t.col = f.col AND t.v = f.v),
  e AS (SELECT o.col, o.v, o.fold,
          CASE WHEN o.n > 0 THEN
            CASE WHEN go.gv * o.n + (o.qy / o.n - (o.sy / o.n) ^ 2) = 0 THEN go.gm ELSE
              (go.gv * o.n / (go.gv * o.n + (o.qy / o.n - (o.sy / o.n) ^ 2))) * (o.sy / o.n)
              + (1 - go.gv * o.n / (go.gv * o.n + (o.qy / o.n - (o.sy / o.n) ^ 2))) * go.gm END
          ELSE go.gm END AS enc
        FROM o JOIN go ON o.fold = go.fold)
SELECT doc_id, {', '.join(sel)} FROM tr"""


SQL["target_encode_oof"] = _oof_sql()


@register("target_encode_oof")
def q_target_encode_oof(spark, sf):
    s = dl_split(spark, sf)
    tr, _ = train_test(s)
    out = E.target_encode_oof(tr.select("doc_id", "lang", "source", "quality"), ["lang", "source"],
                              "quality", "classification", ["doc_id"])
    return out.select("doc_id", r6(F.col("lang")).alias("lang"), r6(F.col("source")).alias("source"))


_PREP_NUM = ["o_totalprice", "c_acctbal", "c_nationkey"]
SQL["prep_for_generation"] = f"""
WITH s AS {OC_SPLIT},{_ord_sql('o_orderpriority', 'true')},{_ord_sql('c_mktsegment', 'true')},
  m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in _PREP_NUM)} FROM s WHERE NOT is_test)
SELECT o_orderkey, is_test,
  ({_ord_expr('o_orderpriority')})::DOUBLE AS o_orderpriority, ({_ord_expr('c_mktsegment')})::DOUBLE AS c_mktsegment,
  {', '.join(f'round(coalesce({c}, (SELECT m_{c} FROM m))::DOUBLE, 6) AS {c}' for c in _PREP_NUM)}
FROM s"""


def _prep_oc(spark, sf):
    s = oc_split(spark, sf)
    tr, _ = train_test(s)
    feats = ["o_orderpriority", "c_mktsegment", *_PREP_NUM]
    prep = E.fit_prep_for_generation(tr, feats, ["o_orderpriority", "c_mktsegment"])
    return prep.transform(s.select("o_orderkey", "is_test", "o_orderstatus", *feats)), feats


@register("prep_for_generation")
def q_prep_for_generation(spark, sf):
    out, feats = _prep_oc(spark, sf)
    return out.select("o_orderkey", "is_test", "o_orderpriority", "c_mktsegment",
                      *[r6(F.col(c)).alias(c) for c in _PREP_NUM])


RATIO_SQL = "CASE WHEN l_discount = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_discount END"


def _ratio_col():
    return F.when(F.col("l_discount") == 0, F.lit(float("inf"))) \
        .otherwise(F.try_divide(F.col("l_extendedprice"), F.col("l_discount")))


SQL["clean_inf"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  round(CASE WHEN isinf(r) OR isnan(r) THEN NULL ELSE r END, 6) AS ratio
FROM (SELECT *, {RATIO_SQL} AS r FROM lineitem) t"""


@register("clean_inf")
def q_clean_inf(spark, sf):
    from ..functions.scalar import finite_or_null

    li = read_table(spark, sf, "lineitem")
    return li.select(*LI_OUT, r6(finite_or_null(_ratio_col())).alias("ratio"))


_FAM = ["l_quantity", "l_discount", "ratio"]
SQL["family_input_linear"] = f"""
WITH s0 AS {LI_NULL_SPLIT},
  s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, is_test, l_quantity,
          l_discount, CASE WHEN isinf(r) OR isnan(r) THEN NULL ELSE r END AS ratio
        FROM (SELECT *, {RATIO_SQL.replace('l_discount = 0', 'coalesce(l_discount, 1) = 0')} AS r FROM s0) x),
  m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in _FAM)} FROM s WHERE NOT is_test),
  f AS (SELECT s.*, {', '.join(f'coalesce({c}, m_{c}) AS z_{c}' for c in _FAM)} FROM s, m),
  st AS (SELECT {', '.join(f'avg(z_{c}) AS a_{c}, stddev_pop(z_{c}) AS d_{c}' for c in _FAM)}
         FROM f WHERE NOT is_test)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, is_test,
  {', '.join(f'round((z_{c} - a_{c}) / CASE WHEN d_{c} > 0 THEN d_{c} ELSE 1 END, 6) AS {c}' for c in _FAM)}
FROM f, st"""


@register("family_input_linear")
def q_family_input_linear(spark, sf):
    s = li_split(spark, sf, nulls=True).withColumn("ratio", _ratio_col())
    tr, _ = train_test(s)
    fam = E.fit_family_input("linear", tr, _FAM)
    out = fam.transform(s.select(*LI_OUT, "is_test", *_FAM))
    return out.select(*LI_OUT, "is_test", *[r6(F.col(c)).alias(c) for c in _FAM])


# --------------------------------------------------------------------------- #
# Phase 4: statistics
# --------------------------------------------------------------------------- #
def _assoc_out(df):
    return df.select("col", "pos", r6(F.col("association")).alias("association"))


_PCOLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
SQL["pearson_cols"] = f"WITH tr AS (SELECT * FROM {LI_SPLIT} t WHERE NOT is_test) " + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {i} AS pos, round(abs(covar_pop({c}, l_extendedprice) / "
    f"(stddev_pop({c}) * stddev_pop(l_extendedprice))), 6) AS association FROM tr"
    for i, c in enumerate(_PCOLS))


@register("pearson_cols")
def q_pearson_cols(spark, sf):
    tr, _ = train_test(li_split(spark, sf))
    return _assoc_out(A.pearson_abs(tr, _PCOLS, F.col("l_extendedprice")))


def _rank0(x, part=""):
    p = f"PARTITION BY {part} " if part else ""
    p2 = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"((rank() OVER ({p}ORDER BY {x}) - 1) + (count(*) OVER ({p2}) - 1) / 2.0)"


def _spearman_block(src, c, i, y):
    return f"""SELECT '{c}' AS col, {i} AS pos, round(CASE WHEN count(*) < 3
        OR stddev_pop(rx) / greatest(count(*) - 1, 1) < 1e-9 OR stddev_pop(ry) / greatest(count(*) - 1, 1) < 1e-9
        THEN 0.0 ELSE least(abs(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry))), 1.0) END, 6) AS association
      FROM (SELECT {_rank0('x')} AS rx, {_rank0('y')} AS ry FROM (
            SELECT {c} AS x, {y} AS y FROM {src} WHERE {c} IS NOT NULL AND {y} IS NOT NULL) a) b"""


SQL["spearman_cols"] = f"WITH tr AS (SELECT * FROM {LI_SPLIT} t WHERE NOT is_test) " + " UNION ALL ".join(
    _spearman_block("tr", c, i, "l_extendedprice") for i, c in enumerate(_PCOLS))


@register("spearman_cols")
def q_spearman_cols(spark, sf):
    tr, _ = train_test(li_split(spark, sf))
    return _assoc_out(A.spearman_abs(tr, _PCOLS, "l_extendedprice"))


def _eta_block(src, c, i, cls):
    return f"""SELECT '{c}' AS col, {i} AS pos, round(CASE WHEN max(n) < 3 OR max(sst) < 1e-9 THEN 0.0
        ELSE least(sqrt(greatest(sum(nk * (mk - grand) ^ 2), 0) / max(sst)), 1.0) END, 6) AS association
      FROM (SELECT cls, count(*) AS nk, avg(r) AS mk, max(grand) AS grand, max(sst) AS sst, max(n) AS n
            FROM (SELECT cls, r, avg(r) OVER () AS grand, count(*) OVER () AS n,
                         sum(r * r) OVER () - count(*) OVER () * avg(r) OVER () * avg(r) OVER () AS sst
                  FROM (SELECT cls, {_rank0('x')} / greatest(count(*) OVER () - 1, 1) AS r FROM (
                        SELECT {c} AS x, CAST({cls} AS VARCHAR) AS cls FROM {src} WHERE {c} IS NOT NULL) a) b) c
            GROUP BY cls) d"""


_ECOLS = ["o_totalprice", "c_acctbal", "c_nationkey"]
SQL["eta_cols"] = f"WITH tr AS (SELECT * FROM {OC_SPLIT} t WHERE NOT is_test) " + " UNION ALL ".join(
    _eta_block("tr", c, i, "o_orderstatus") for i, c in enumerate(_ECOLS))


@register("eta_cols")
def q_eta_cols(spark, sf):
    tr, _ = train_test(oc_split(spark, sf))
    return _assoc_out(A.eta_ranks(tr, _ECOLS, "o_orderstatus"))


_RCOLS = ["l_quantity", "l_discount", "l_tax", "const_one"]
SQL["target_association_reg"] = (
    f"WITH tr AS (SELECT *, 1.0::DOUBLE AS const_one FROM {LI_NULL_SPLIT} t WHERE NOT is_test) "
    + " UNION ALL ".join(_spearman_block("tr", c, i, "l_extendedprice") for i, c in enumerate(_RCOLS)))


@register("target_association_reg")
def q_target_association_reg(spark, sf):
    tr, _ = train_test(li_split(spark, sf, nulls=True))
    tr = tr.withColumn("const_one", F.lit(1.0))
    return _assoc_out(A.target_association(tr, _RCOLS, "l_extendedprice", "regression"))


_CCOLS = ["n_chars", "text_len", "toxic"]
SQL["target_association_cls"] = f"WITH tr AS (SELECT * FROM {DL_SPLIT} t WHERE NOT is_test) " + \
    " UNION ALL ".join(_eta_block("tr", c, i, "quality") for i, c in enumerate(_CCOLS))


@register("target_association_cls")
def q_target_association_cls(spark, sf):
    tr, _ = train_test(dl_split(spark, sf))
    return _assoc_out(A.target_association(tr, _CCOLS, "quality", "classification"))


_CAP = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"]
SQL["cap_columns"] = f"""
WITH tr AS (SELECT * FROM {LI_SPLIT} t WHERE NOT is_test),
  p AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS col, {i} AS pos, abs(covar_pop({c}, l_extendedprice) / "
    f"(stddev_pop({c}) * stddev_pop(l_extendedprice))) AS a FROM tr" for i, c in enumerate(_CAP))})
SELECT col, pos, round(a, 6) AS association,
       row_number() OVER (ORDER BY a DESC NULLS LAST, pos) <= 3 AS kept FROM p"""


@register("cap_columns")
def q_cap_columns(spark, sf):
    tr, _ = train_test(li_split(spark, sf))
    scores = A.cap_scores(tr, _CAP, "l_extendedprice", "regression", 3)
    return scores.select("col", "pos", r6(F.col("association")).alias("association"), "kept")


_GEN = {"f_qt": "l_quantity * l_tax", "f_dt": "l_discount + l_tax", "f_ln": "l_linenumber * 1.0"}
SQL["feature_efficiency"] = f"""
WITH tr AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _GEN.items())} FROM {LI_SPLIT} t WHERE NOT is_test),
  a AS ({' UNION ALL '.join(_spearman_block('tr', n, i, 'l_extendedprice') for i, n in enumerate(_GEN))})
SELECT {len(_GEN)}::BIGINT AS n_new, avg((association >= 0.1)::DOUBLE) AS efficiency FROM a"""


@register("feature_efficiency")
def q_feature_efficiency(spark, sf):
    tr, _ = train_test(li_split(spark, sf))
    gen = tr.select(*[F.col(c) for c in tr.columns], *[F.expr(e).alias(n) for n, e in _GEN.items()])
    base = ["l_quantity", "l_discount"]
    eff = A.feature_efficiency(gen, base, base + list(_GEN), "l_extendedprice", "regression")
    return spark.range(1).select(F.lit(len(_GEN)).cast("long").alias("n_new"),
                                 F.lit(eff).cast("double").alias("efficiency"))


SQL["flagship_association"] = f"""
WITH s AS {OC_SPLIT},{_ord_sql('o_orderpriority', 'true')},{_ord_sql('c_mktsegment', 'true')},
  m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in _PREP_NUM)} FROM s WHERE NOT is_test),
  tr AS (SELECT o_orderstatus, ({_ord_expr('o_orderpriority')})::DOUBLE AS o_orderpriority,
           ({_ord_expr('c_mktsegment')})::DOUBLE AS c_mktsegment,
           {', '.join(f'coalesce({c}, (SELECT m_{c} FROM m))::DOUBLE AS {c}' for c in _PREP_NUM)}
         FROM s WHERE NOT is_test)
""" + " UNION ALL ".join(_eta_block("tr", c, i, "o_orderstatus") for i, c in enumerate(
    ["o_orderpriority", "c_mktsegment", *_PREP_NUM]))


@register("flagship_association")
def q_flagship_association(spark, sf):
    out, feats = _prep_oc(spark, sf)
    tr = out.where(~F.col("is_test"))
    return _assoc_out(A.target_association(tr, feats, "o_orderstatus", "classification"))


# --------------------------------------------------------------------------- #
# Phase 5: methods
# --------------------------------------------------------------------------- #
SQL["method_baseline"] = SQL["prep_for_generation"]


@register("method_baseline")
def q_method_baseline(spark, sf):
    from .methods import BaselineMethod

    out, feats = _prep_oc(spark, sf)
    tr = out.where(~F.col("is_test"))
    fitted = BaselineMethod().fit(tr, "o_orderstatus", "classification")
    g = fitted.transform(out)
    return g.select("o_orderkey", "is_test", "o_orderpriority", "c_mktsegment",
                    *[r6(F.col(c)).alias(c) for c in _PREP_NUM])


def ratio_log_groupmean(train: DataFrame, test: DataFrame, target: str, task: str):
    """Example user method: group mean of the target by return flag (from
    train), a ratio and a log feature."""
    # few groups: broadcast, so that the rows of a flag aren't sent to one task
    gm = materialize(train.groupBy("l_returnflag").agg(F.avg(target).alias("grp_mean")))

    def add(df):
        return df.join(gm, "l_returnflag", "left").select(
            *df.columns, "grp_mean",
            F.try_divide(F.col("l_quantity"), F.col("l_discount")).alias("qty_per_disc"),
            F.ln(F.col("l_quantity")).alias("log_qty"))
    return add(train), add(test)


SQL["method_function"] = f"""
WITH s AS {LI_SPLIT},
  g AS (SELECT l_returnflag, avg(l_extendedprice) AS grp_mean FROM s WHERE NOT is_test GROUP BY l_returnflag)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, is_test,
  round(g.grp_mean, 6) AS grp_mean,
  round(CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity / l_discount END, 6) AS qty_per_disc,
  round(ln(l_quantity), 6) AS log_qty
FROM s LEFT JOIN g ON s.l_returnflag = g.l_returnflag"""


@register("method_function")
def q_method_function(spark, sf):
    from .methods import function_method

    s = li_split(spark, sf)
    tr, _ = train_test(s)
    fitted = function_method(ratio_log_groupmean).fit(tr, "l_extendedprice", "regression")
    out = fitted.transform(s)
    return out.select(*LI_OUT, "is_test", *[r6(F.col(c)).alias(c)
                                            for c in ["grp_mean", "qty_per_disc", "log_qty"]])


class FailingMethod:
    name = "raises"

    def fit(self, train, target, task):
        raise RuntimeError("boom")


def _doc_dataset(spark, sf):
    d = docs_labels(spark, sf).select("doc_id", "lang", "source", "n_chars", "text_len", "quality")
    return Dataset("documents", d, "quality", ["doc_id"], task="classification", sector="text")


SQL["method_error_rows"] = """
SELECT 'documents' AS key, r.* FROM (VALUES ('baseline', 'ok', 'linear', NULL), ('raises', 'error', NULL, 'boom'))
  r(method, status, model_family, error) WHERE EXISTS (SELECT 1 FROM documents)"""


@register("method_error_rows")
def q_method_error_rows(spark, sf):
    from ..sources.results import rows_to_frame
    from .run import run_dataset

    rows = run_dataset(spark, _doc_dataset(spark, sf), ["baseline", FailingMethod()], ["linear"],
                       budget_seconds=None)
    return rows_to_frame(spark, rows).select("key", "method", "status", "model_family", "error")


# --------------------------------------------------------------------------- #
# Phase 6: metrics and kNN
# --------------------------------------------------------------------------- #
SQL["auc_binary"] = f"""
SELECT lang, CASE WHEN P > 0 AND N > 0 THEN
         round((sum(CASE WHEN pos THEN rk END) - P * (P + 1) / 2.0) / (P * N), 6) END AS auc,
       P AS n_pos, N AS n_neg
FROM (SELECT lang, pos, rk, sum(pos::BIGINT) OVER (PARTITION BY lang)::BIGINT AS P,
             sum((NOT pos)::BIGINT) OVER (PARTITION BY lang)::BIGINT AS N
      FROM (SELECT lang, quality = 1 AS pos, rank() OVER (PARTITION BY lang ORDER BY n_chars)
                   + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk FROM ({DL_SQL}) d
      WHERE quality IS NOT NULL) a) b
GROUP BY lang, P, N"""


@register("auc_binary")
def q_auc_binary(spark, sf):
    d = docs_labels(spark, sf)
    a = auc_frame(d, F.col("quality") == 1, F.col("n_chars"), ["lang"])
    return a.select("lang", r6(F.col("auc")).alias("auc"), "n_pos", "n_neg")


SQL["auc_ovr_macro"] = """
SELECT round(avg(auc), 6) AS macro_auc, count(*) AS n_classes FROM (
  SELECT c, (sum(CASE WHEN pos THEN rk END) - max(P) * (max(P) + 1) / 2.0) / (max(P) * max(N)) AS auc FROM (
    SELECT c, pos, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS rk,
           sum(pos::BIGINT) OVER (PARTITION BY c) AS P, sum((NOT pos)::BIGINT) OVER (PARTITION BY c) AS N
    FROM (SELECT r.range AS c, label = r.range AS pos, embedding[r.range + 1]::DOUBLE AS s
          FROM embeddings, range(10) r) a) b GROUP BY c) z"""


@register("auc_ovr_macro")
def q_auc_ovr_macro(spark, sf):
    e = read_table(spark, sf, "embeddings")
    scores = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    per = auc_ovr_frame(e, F.col("label"), scores, F.array(*[F.lit(i) for i in range(10)]))
    return per.agg(r6(F.avg("auc")).alias("macro_auc"), F.count(F.lit(1)).alias("n_classes"))


SQL["r2_mae"] = """
SELECT l_returnflag, count(*) AS n,
  round(1 - sum((l_extendedprice - p) ^ 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2,
  round(avg(abs(l_extendedprice - p)), 6) AS mae
FROM (SELECT *, 950 * l_quantity + 1000 * l_tax AS p FROM lineitem) t GROUP BY l_returnflag"""


@register("r2_mae")
def q_r2_mae(spark, sf):
    li = read_table(spark, sf, "lineitem")
    pred = 950 * F.col("l_quantity") + 1000 * F.col("l_tax")
    r = regression_scores(li, F.col("l_extendedprice"), pred, ["l_returnflag"])
    return r.select("l_returnflag", "n", r6(F.col("r2")).alias("r2"), r6(F.col("mae")).alias("mae"))


_FS = [f"f{i}" for i in range(64)]
KNN_SQL_CTE = f"""
  s AS {EMB_SPLIT},
  d AS (SELECT q.vec_id AS qid, r.vec_id AS rid,
          sqrt({' + '.join(f'(q.f{i} - r.f{i}) ^ 2' for i in range(64))}) AS dist
        FROM s q JOIN s r ON q.is_test AND NOT r.is_test),
  nb AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS nn_rank, rid, dist FROM d)"""
SQL["knn_topk"] = f"WITH {KNN_SQL_CTE} SELECT qid, nn_rank, rid, round(dist, 6) AS dist FROM nb WHERE nn_rank <= 10"


@register("knn_topk")
def q_knn_topk(spark, sf):
    tr, te = train_test(emb_split(spark, sf))
    nb = knn_neighbors(tr, te, _FS, "vec_id", "vec_id", k=10)
    return nb.select("qid", F.col("nn_rank").cast("long").alias("nn_rank"), "rid",
                     r6(F.col("dist")).alias("dist"))


SQL["knn_predict"] = f"""
WITH {KNN_SQL_CTE},
  lab AS (SELECT vec_id, label FROM s),
  cnt AS (SELECT nb.qid, lab.label AS cls, count(*) AS c FROM nb JOIN lab ON nb.rid = lab.vec_id
          WHERE nn_rank <= 10 GROUP BY nb.qid, lab.label),
  best AS (SELECT qid, cls AS pred FROM (SELECT qid, cls, row_number() OVER (PARTITION BY qid ORDER BY c DESC, cls) AS k
           FROM cnt) x WHERE k = 1)
SELECT t.vec_id AS qid, t.label, round(coalesce((SELECT c FROM cnt WHERE cnt.qid = t.vec_id AND cnt.cls = t.label), 0)
       / 10.0, 6) AS p_true, best.pred
FROM s t JOIN best ON best.qid = t.vec_id WHERE t.is_test"""


@register("knn_predict")
def q_knn_predict(spark, sf):
    tr, te = train_test(emb_split(spark, sf))
    classes = E.train_classes(tr, "label")
    pr = knn_predict(tr, te, _FS, "vec_id", "vec_id", "label", "classification", classes=classes, k=10)
    cls = F.array(*[F.lit(c) for c in classes])
    j = te.select(F.col("vec_id").alias("qid"), "label").join(pr, "qid")
    idx = F.array_position(cls, F.col("label"))
    p_true = F.when(idx > 0, F.element_at("probs", idx.cast("int"))).otherwise(F.lit(0.0))
    pred = F.element_at(cls, F.array_position("probs", F.array_max("probs")).cast("int"))
    return j.select("qid", "label", r6(p_true).alias("p_true"), pred.alias("pred"))


SQL["knn_regression"] = f"""
WITH {KNN_SQL_CTE}
SELECT nb.qid, round(avg(s.label::DOUBLE), 6) AS pred FROM nb JOIN s ON s.vec_id = nb.rid
WHERE nn_rank <= 10 GROUP BY nb.qid"""


@register("knn_regression")
def q_knn_regression(spark, sf):
    tr, te = train_test(emb_split(spark, sf))
    pr = knn_predict(tr, te, _FS, "vec_id", "vec_id", "label", "regression", k=10)
    return pr.select("qid", r6(F.col("pred")).alias("pred"))


# --------------------------------------------------------------------------- #
# Phase 7: models
# --------------------------------------------------------------------------- #
SQL["linear_ridge_coeffs"] = f"""
WITH tr AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y FROM {PART_SPLIT} t WHERE NOT is_test),
  m AS (SELECT avg(x) AS mx, avg(y) AS my FROM tr),
  c AS (SELECT sum((x - mx) * (y - my)) AS sxy, sum((x - mx) ^ 2) AS sxx, max(mx) AS mx, max(my) AS my
        FROM tr, m)
SELECT round(sxy / (sxx + 1.0), 6) AS coef, round(my - sxy / (sxx + 1.0) * mx, 6) AS intercept FROM c"""


@register("linear_ridge_coeffs")
def q_linear_ridge_coeffs(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from ..operators.models import RIDGE_ALPHA

    s = add_split(read_table(spark, sf, "part"), ["p_partkey"], "part")
    tr, _ = train_test(s)
    st = tr.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("p_retailprice").alias("sd")).first()
    v = VectorAssembler(inputCols=["p_size"], outputCol="features").transform(tr)
    lr = LinearRegression(labelCol="p_retailprice", regParam=RIDGE_ALPHA * st["sd"] / st["n"],
                          elasticNetParam=0.0, standardization=False, solver="normal").fit(v)
    return spark.range(1).select(F.round(F.lit(float(lr.coefficients[0])), 6).alias("coef"),
                                 F.round(F.lit(float(lr.intercept)), 6).alias("intercept"))


@register("panel_scores")
def q_panel_scores(spark, sf):
    from ..sources.results import rows_to_frame
    from .run import run_dataset

    rows = run_dataset(spark, _doc_dataset(spark, sf), ["baseline"], budget_seconds=None)
    return rows_to_frame(spark, rows).select("key", "method", "model_family", "status", "metric",
                                             r6(F.col("value")).alias("value"))


# --------------------------------------------------------------------------- #
# Phase 8: result tables (report)
# --------------------------------------------------------------------------- #
OK = "status = 'ok' AND value IS NOT NULL"
FAM_SQL = f"SELECT key, method, model_family, avg(value) AS value FROM res WHERE {OK} GROUP BY key, method, model_family"
OV_SQL = f"SELECT key, method, avg(value) AS score FROM ({FAM_SQL}) f GROUP BY key, method"
INFO_SQL = f"""SELECT i.key, i.task, i.metric, coalesce(r.sector, '?') AS sector FROM (
   SELECT key, coalesce(max(task), '?') AS task, coalesce(max(metric), '?') AS metric FROM res WHERE {OK} GROUP BY key) i
   LEFT JOIN ({REG_SQL}) r ON i.key = r.key"""
INITIALS_SQL = "upper(array_to_string(list_transform(string_split({k}, '-'), lambda w: substr(w, 1, 1)), ''))"
LEGEND_SQL = f"""SELECT pos, CASE WHEN n = 1 THEN base ELSE base || CAST(n AS VARCHAR) END AS abbrev, key, task, sector, metric
  FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY pos) AS n FROM (
        SELECT *, row_number() OVER (ORDER BY task, sector, key) AS pos, {INITIALS_SQL.format(k='key')} AS base
        FROM ({INFO_SQL}) i) a) b"""


def _res(spark, sf):
    return results_table(spark, sf)


SQL["family_scores"] = f"WITH res AS ({RES_SQL}) SELECT key, method, model_family, round(value, 6) AS value FROM ({FAM_SQL}) f"


@register("family_scores")
def q_family_scores(spark, sf):
    f = R.family_scores(_res(spark, sf))
    return f.select("key", "method", "model_family", r6(F.col("value")).alias("value"))


SQL["overview"] = f"""WITH res AS ({RES_SQL})
SELECT key, method, round(score, 6) AS score, score = max(score) OVER (PARTITION BY key) AS is_best FROM ({OV_SQL}) o"""


@register("overview")
def q_overview(spark, sf):
    o = R.overview(_res(spark, sf))
    return o.select("key", "method", r6(F.col("score")).alias("score"), "is_best")


_ABBR = {"click": "C", "error": "E", "purchase": "P", "signup": "S", "view": "V"}
_FMT3 = "CASE WHEN abs({v}) >= 1000 THEN printf('%.2e', {v}) ELSE printf('%.3f', {v}) END"
SQL["overview_pivot"] = f"""WITH res AS ({RES_SQL}),
  o AS (SELECT key, method, score, score = max(score) OVER (PARTITION BY key) AS b FROM ({OV_SQL}) x),
  c AS (SELECT key, method, CASE WHEN b THEN '**' || {_FMT3.format(v='score')} || '**'
                            ELSE {_FMT3.format(v='score')} END AS cell FROM o)
SELECT method, {', '.join(f"coalesce(max(CASE WHEN key = '{k}' THEN cell END), '—') AS {a}" for k, a in _ABBR.items())}
FROM c GROUP BY method"""


@register("overview_pivot")
def q_overview_pivot(spark, sf):
    return R.overview_table(_res(spark, sf), registry_table(spark, sf))


SQL["speed_median"] = f"""WITH res AS ({RES_SQL})
SELECT method, round(median(gen_s), 6) AS median_s,
  CASE WHEN median(gen_s) >= 120 THEN printf('%.1f min', median(gen_s) / 60) ELSE printf('%.1f s', median(gen_s)) END
    AS median_txt
FROM (SELECT key, method, avg(gen_elapsed_s) AS gen_s FROM res WHERE {OK} AND gen_elapsed_s IS NOT NULL
      GROUP BY key, method) g GROUP BY method"""


@register("speed_median")
def q_speed_median(spark, sf):
    s = R.speed_median(_res(spark, sf))
    return s.select("method", r6(F.col("median_s")).alias("median_s"), "median_txt")


SQL["feature_counts"] = f"""WITH res AS ({RES_SQL})
SELECT key, method, round(n_before, 6) AS n_before, round(n_after, 6) AS n_after,
       printf('%.0f -> %.0f', n_before, n_after) AS cell
FROM (SELECT key, method, avg(n_features_final - n_features_generated) AS n_before, avg(n_features_final) AS n_after
      FROM res WHERE {OK} AND n_features_final IS NOT NULL AND n_features_generated IS NOT NULL
      GROUP BY key, method) c"""


@register("feature_counts")
def q_feature_counts(spark, sf):
    c = R.feature_counts(_res(spark, sf))
    return c.select("key", "method", r6(F.col("n_before")).alias("n_before"),
                    r6(F.col("n_after")).alias("n_after"), "cell")


SQL["by_task_sector"] = f"""WITH res AS ({RES_SQL}),
  cells AS (SELECT o.key, o.method, o.score, i.task, i.sector FROM ({OV_SQL}) o JOIN ({INFO_SQL}) i ON o.key = i.key),
  g AS (SELECT method, CASE WHEN grouping(task) = 0 THEN 'task' ELSE 'sector' END AS grouping_kind,
               coalesce(task, sector) AS grp, avg(score) AS score
        FROM cells GROUP BY GROUPING SETS ((method, task), (method, sector)))
SELECT method, grouping_kind, grp, round(score, 6) AS score,
       score = max(score) OVER (PARTITION BY grouping_kind, grp) AS is_best FROM g"""


@register("by_task_sector")
def q_by_task_sector(spark, sf):
    g = R.grouped_scores(_res(spark, sf), registry_table(spark, sf))
    return g.select("method", "grouping_kind", "grp", r6(F.col("score")).alias("score"), "is_best")


SQL["best_per_dataset"] = f"""WITH res AS ({RES_SQL}),
  o AS ({OV_SQL})
SELECT key, round(max(score), 6) AS best_score,
       sum((score = (SELECT max(score) FROM o o2 WHERE o2.key = o.key))::BIGINT)::BIGINT AS n_best
FROM o GROUP BY key"""


@register("best_per_dataset")
def q_best_per_dataset(spark, sf):
    o = R.overview(_res(spark, sf))
    return o.groupBy("key").agg(r6(F.max("score")).alias("best_score"),
                                F.sum(F.col("is_best").cast("long")).alias("n_best"))


SQL["failure_counts"] = f"""WITH res AS ({RES_SQL})
SELECT key, method, status, count(*) AS count FROM res WHERE status IS NULL OR status <> 'ok'
GROUP BY key, method, status"""


@register("failure_counts")
def q_failure_counts(spark, sf):
    return R.failure_counts(_res(spark, sf))


SQL["run_status"] = f"""WITH res AS ({RES_SQL})
SELECT CASE WHEN grouping(status) = 1 THEN '*' ELSE status END AS status, count(*) AS count,
       count(DISTINCT concat(key, '|', method)) AS n_pairs
FROM (SELECT coalesce(status, '?') AS status, key, method FROM res) r GROUP BY GROUPING SETS ((status), ())"""


@register("run_status")
def q_run_status(spark, sf):
    return R.run_status(_res(spark, sf))


_REQ_METHODS = ["baseline", "m1", "m2", "m3"]
SQL["pending_pairs"] = f"""WITH res AS ({RES_SQL})
SELECT r.key, m.method FROM ({REG_SQL}) r CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in _REQ_METHODS)}) m(method)
WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.key = r.key AND res.method = m.method)"""


@register("pending_pairs")
def q_pending_pairs(spark, sf):
    from ..sources.results import pending_pairs

    req = registry_table(spark, sf).select(
        "key", F.explode(F.array(*[F.lit(m) for m in _REQ_METHODS])).alias("method"))
    return pending_pairs(req, _res(spark, sf))


# nation names, and keys whose numbered labels clash with other keys' initials
_ABBREV_KEYS_SQL = """SELECT lower(replace(n_name, '_', '-')) AS key, n_nationkey * 2 AS pos FROM nation
  UNION ALL SELECT lower(substr(n_name, 1, 1)) || '-2' || n_nationkey, n_nationkey * 2 + 1 FROM nation"""
SQL["abbreviate"] = f"""
WITH RECURSIVE o AS (SELECT key, {INITIALS_SQL.format(k="key")} AS base, row_number() OVER (ORDER BY pos) AS i
                     FROM ({_ABBREV_KEYS_SQL}) a),
r AS (SELECT 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS used, '' AS key, '' AS abbrev
  UNION ALL
  SELECT x.i, list_append(x.used, x.abbrev), x.key, x.abbrev FROM (
    SELECT o.i, r.used, o.key, list_filter(
             list_concat([o.base], list_transform(range(2, len(r.used) + 3), lambda n: o.base || n::VARCHAR)),
             lambda c: NOT list_contains(r.used, c))[1] AS abbrev
    FROM r JOIN o ON o.i = r.i + 1) x)
SELECT key, abbrev FROM r WHERE i > 0"""


@register("abbreviate")
def q_abbreviate(spark, sf):
    n = read_table(spark, sf, "nation")
    keys = n.select(F.lower(F.regexp_replace("n_name", "_", "-")).alias("key"),
                    (F.col("n_nationkey") * 2).alias("pos"))
    clash = n.select(F.concat(F.lower(F.substring("n_name", 1, 1)), F.lit("-2"),
                              F.col("n_nationkey").cast("string")).alias("key"),
                     (F.col("n_nationkey") * 2 + 1).alias("pos"))
    return R.abbreviations(keys.unionAll(clash))


SQL["summary_mean"] = f"""WITH res AS ({RES_SQL}),
  per AS (SELECT model_family, key, method, avg(value) AS value FROM res WHERE {OK} GROUP BY model_family, key, method)
SELECT model_family, key, method, round(avg(value), 6) AS value FROM per
GROUP BY GROUPING SETS ((model_family, key, method), (model_family, method))"""


@register("summary_mean")
def q_summary_mean(spark, sf):
    s = R.summary_table(_res(spark, sf))
    return s.select("model_family", "key", "method", r6(F.col("value")).alias("value"))


SQL["legend"] = f"WITH res AS ({RES_SQL}) {LEGEND_SQL}"


@register("legend")
def q_legend(spark, sf):
    return R.legend(_res(spark, sf), registry_table(spark, sf)).select(
        F.col("pos").cast("long").alias("pos"), "abbrev", "key", "task", "sector", "metric")


# --------------------------------------------------------------------------- #
# Phase 9: catalogue
# --------------------------------------------------------------------------- #
SQL["registry"] = REG_SQL


@register("registry")
def q_registry(spark, sf):
    return registry_table(spark, sf).select("key", "display", "task", "sector", "scale", "source",
                                            "fetch_key", "aliases_txt", "n_rows")


SQL["exclusion_names"] = f"""
SELECT DISTINCT name FROM (
  SELECT lower(key) AS name FROM ({REG_SQL}) r UNION ALL SELECT lower(fetch_key) FROM ({REG_SQL}) r
  UNION ALL SELECT lower(display) FROM ({REG_SQL}) r
  UNION ALL SELECT lower(unnest(string_split(aliases_txt, ','))) FROM ({REG_SQL}) r) x"""


@register("exclusion_names")
def q_exclusion_names(spark, sf):
    return C.exclusion_names(registry_table(spark, sf))


SQL["corpus_dedupe"] = """
WITH m AS (SELECT CAST(substr(source, 4) AS INTEGER) AS suite_pos, doc_id AS pos, source, lang,
                  lower(text) AS lname FROM documents),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lname ORDER BY suite_pos, pos) AS rn FROM m) x
        WHERE rn = 1),
  k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(b.text) = f.lname))
SELECT suite_pos, pos, source, lang FROM k"""


@register("corpus_dedupe")
def q_corpus_dedupe(spark, sf):
    d = read_table(spark, sf, "documents")
    members = d.select(F.substring("source", 4, 12).cast("int").alias("suite_pos"),
                       F.col("doc_id").alias("pos"), "source", "lang", F.col("text").alias("name"))
    excl = read_table(spark, sf, "benchmark").select(F.col("text").alias("name"))
    return C.build_corpus(members, excl, "name").select("suite_pos", "pos", "source", "lang")


_SF_SQL = """CASE WHEN contains(lower(sector), 'finance') OR contains(lower(sector), 'telco') THEN 'finance'
  WHEN contains(lower(sector), 'health') THEN 'healthcare'
  WHEN contains(lower(sector), 'material') OR contains(lower(sector), 'physical') OR contains(lower(sector), 'chem')
       OR contains(lower(sector), 'energy') THEN 'physical-science'
  ELSE 'general' END"""
SQL["coverage_matrix"] = f"""
SELECT {_SF_SQL} AS sector_family, task, count(*) AS n_datasets, string_agg(key, ',' ORDER BY key) AS keys
FROM ({REG_SQL}) r GROUP BY ALL"""


@register("coverage_matrix")
def q_coverage_matrix(spark, sf):
    cm = C.coverage_matrix(registry_table(spark, sf))
    return cm.select("sector_family", "task", "n_datasets", F.array_join("keys", ",").alias("keys"))


SQL["dataset_order"] = f"""
SELECT key, scale, CASE scale WHEN 'small' THEN 0 WHEN 'medium' THEN 1 WHEN 'large' THEN 2 ELSE 3 END AS scale_rank,
  row_number() OVER (ORDER BY CASE scale WHEN 'small' THEN 0 WHEN 'medium' THEN 1 WHEN 'large' THEN 2 ELSE 3 END, key)
    AS order_pos
FROM ({REG_SQL}) r"""


@register("dataset_order")
def q_dataset_order(spark, sf):
    o = C.dataset_order(registry_table(spark, sf))
    return o.select("key", "scale", "scale_rank",
                    F.row_number().over(Window.orderBy("scale_rank", "pos")).cast("long").alias("order_pos"))


SQL["key_duplicates"] = """
SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""


@register("key_duplicates")
def q_key_duplicates(spark, sf):
    return C.key_duplicates(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --------------------------------------------------------------------------- #
# Phase 10: end to end
# --------------------------------------------------------------------------- #
@register("leaderboard")
def q_leaderboard(spark, sf):
    from ..sources.results import rows_to_frame
    from .methods import function_method
    from .run import run_dataset

    def relative_length(train, test, target, task):
        """Length relative to the mean length of the document's language on
        the training fold (languages coded by the prep step)."""
        means = materialize(train.groupBy("lang").agg(F.avg("n_chars").alias("__mean")))

        def add(df):
            return df.join(means, "lang", "left").select(
                *df.columns, F.try_divide(F.col("n_chars"), F.col("__mean")).alias("rel_len"))
        return add(train), add(test)

    rows = run_dataset(spark, _doc_dataset(spark, sf), ["baseline", function_method(relative_length)],
                       budget_seconds=None)
    res = rows_to_frame(spark, rows)
    return R.overview(res).select("key", "method", r6(F.col("score")).alias("score"), "is_best")


# --------------------------------------------------------------------------- #
# additions: multiclass target encoding, per-method pivot
# --------------------------------------------------------------------------- #
_CLS = ["F", "O", "P"]     # fixed values: sorted order statuses of the train fold


def _te_multi_sql():
    ys = ", ".join(f"(o_orderstatus = '{k}')::DOUBLE AS y{i}" for i, k in enumerate(_CLS))
    gs = ", ".join(f"avg(y{i}) AS gm{i}, var_pop(y{i}) AS gv{i}" for i in range(len(_CLS)))
    sts = ", ".join(f"avg(y{i}) AS m{i}, var_pop(y{i}) AS vw{i}" for i in range(len(_CLS)))
    sel = []
    for i in range(len(_CLS)):
        lam = f"(g.gv{i} * st.n / (g.gv{i} * st.n + st.vw{i}))"
        enc = (f"CASE WHEN g.gv{i} * st.n + st.vw{i} = 0 THEN g.gm{i} "
               f"ELSE {lam} * st.m{i} + (1 - {lam}) * g.gm{i} END")
        sel.append(f"round(coalesce((SELECT {enc} FROM st, g WHERE st.v IS NOT DISTINCT FROM s.c_mktsegment), "
                   f"(SELECT gm{i} FROM g)), 6) AS c_mktsegment__te{i}")
    return f"""
WITH s AS {OC_SPLIT},
  tr AS (SELECT *, {ys} FROM s WHERE NOT is_test),
  g AS (SELECT {gs} FROM tr),
  st AS (SELECT c_mktsegment AS v, count(*) AS n, {sts} FROM tr GROUP BY c_mktsegment)
SELECT o_orderkey, is_test, {', '.join(sel)} FROM s"""


SQL["target_encode_multiclass"] = _te_multi_sql()


@register("target_encode_multiclass")
def q_target_encode_multiclass(spark, sf):
    s = oc_split(spark, sf)
    tr, _ = train_test(s)
    m = E.fit_target_encoder(tr, ["c_mktsegment"], "o_orderstatus", "classification")
    out = m.transform(s.select("o_orderkey", "is_test", "c_mktsegment"))
    encs = [c for c in out.columns if c.startswith("c_mktsegment__te")]
    return out.select("o_orderkey", "is_test", *[r6(F.col(c)).alias(c) for c in encs])


SQL["per_method_pivot"] = f"""WITH res AS ({RES_SQL}),
  f AS ({FAM_SQL})
SELECT method, model_family,
  {', '.join(f"coalesce(max(CASE WHEN key = '{k}' THEN {_FMT3.format(v='value')} END), '—') AS {a}"
             for k, a in _ABBR.items())}
FROM f GROUP BY method, model_family"""


@register("per_method_pivot")
def q_per_method_pivot(spark, sf):
    return R.per_method_table(_res(spark, sf), registry_table(spark, sf))


_LIN_NUM = ["o_totalprice", "c_acctbal"]
_LIN_CAT = ["o_orderpriority", "c_mktsegment"]
SQL["linear_profile"] = f"""
WITH s AS {OC_SPLIT},
  m AS (SELECT median(o_totalprice) AS mt, median(c_acctbal) AS ma FROM s WHERE NOT is_test),
  f AS (SELECT s.*, coalesce(o_totalprice, mt) AS zt, coalesce(c_acctbal, ma) AS za FROM s, m),
  st AS (SELECT avg(zt) AS avg_t, stddev_pop(zt) AS sd_t, avg(za) AS avg_a, stddev_pop(za) AS sd_a FROM f WHERE NOT is_test),
  mo AS (SELECT o_orderpriority AS v FROM s WHERE NOT is_test AND o_orderpriority IS NOT NULL
         GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1),
  f2 AS (SELECT f.*, coalesce(o_orderpriority, (SELECT v FROM mo)) AS prio FROM f),
  cp AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT prio AS v FROM f2 WHERE NOT is_test) x),
  cs AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (
         SELECT DISTINCT c_mktsegment AS v FROM f2 WHERE NOT is_test) x)
SELECT o_orderkey, is_test,
  round((zt - avg_t) / CASE WHEN sd_t > 0 THEN sd_t ELSE 1 END, 6) AS o_totalprice,
  round((za - avg_a) / CASE WHEN sd_a > 0 THEN sd_a ELSE 1 END, 6) AS c_acctbal,
  {', '.join(f"coalesce((prio = (SELECT v FROM cp WHERE i = {i}))::DOUBLE, 0.0) AS o_orderpriority__{i}" for i in range(5))},
  {', '.join(f"coalesce((c_mktsegment = (SELECT v FROM cs WHERE i = {i}))::DOUBLE, 0.0) AS c_mktsegment__{i}"
             for i in range(5))}
FROM f2, st"""


@register("linear_profile")
def q_linear_profile(spark, sf):
    s = oc_split(spark, sf)
    tr, _ = train_test(s)
    feats = _LIN_NUM + _LIN_CAT
    enc = E.fit_linear_encoder(tr.select(*feats, "o_orderstatus"), feats, "o_orderstatus", "classification")
    out = enc.transform(s.select("o_orderkey", "is_test", *feats))
    return out.select("o_orderkey", "is_test", *[r6(F.col(c)).alias(c) for c in _LIN_NUM],
                      *[c for c in out.columns if "__" in c])


SQL["tree_profile"] = f"""
WITH s AS {OC_SPLIT},{_ord_sql('o_orderpriority', 'TRUE')},{_ord_sql('c_mktsegment', 'TRUE')}
SELECT o_orderkey, is_test, round(o_totalprice, 6) AS o_totalprice, round(c_acctbal, 6) AS c_acctbal,
       {_ord_expr('o_orderpriority')} AS o_orderpriority, {_ord_expr('c_mktsegment')} AS c_mktsegment FROM s"""


@register("tree_profile")
def q_tree_profile(spark, sf):
    s = oc_split(spark, sf)
    feats = _LIN_NUM + _LIN_CAT
    enc = E.fit_tree_encoder(train_test(s)[0], feats)
    out = enc.transform(s.select("o_orderkey", "is_test", *feats))
    return out.select("o_orderkey", "is_test", *[r6(F.col(c)).alias(c) for c in _LIN_NUM], *_LIN_CAT)


_TE_OC = _te_sql(OC_SPLIT, "o_orderkey", "o_totalprice", _LIN_CAT)
SQL["tree_profile_target"] = f"""
SELECT e.*, round(a.c_acctbal, 6) AS c_acctbal
FROM ({_TE_OC}) e JOIN ({OC_SQL}) a USING (o_orderkey)"""


@register("tree_profile_target")
def q_tree_profile_target(spark, sf):
    s = oc_split(spark, sf)
    feats = ["c_acctbal", *_LIN_CAT]
    enc = E.fit_tree_encoder(train_test(s)[0].select("o_totalprice", *feats), feats, "o_totalprice",
                             "regression", "target")
    out = enc.transform(s.select("o_orderkey", "is_test", *feats))
    return out.select("o_orderkey", "is_test", *[r6(F.col(c)).alias(c) for c in feats])


SQL["family_input_tree"] = f"""
WITH s AS {LI_NULL_SPLIT}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, is_test, round(l_quantity, 6) AS l_quantity,
  round(l_discount, 6) AS l_discount, round(CASE WHEN isinf(r) OR isnan(r) THEN NULL ELSE r END, 6) AS ratio
FROM (SELECT *, {RATIO_SQL.replace('l_discount = 0', 'coalesce(l_discount, 1) = 0')} AS r FROM s) x"""


@register("family_input_tree")
def q_family_input_tree(spark, sf):
    s = li_split(spark, sf, nulls=True).withColumn("ratio", _ratio_col())
    fam = E.fit_family_input("tree", train_test(s)[0], _FAM)
    out = fam.transform(s.select(*LI_OUT, "is_test", *_FAM))
    return out.select(*LI_OUT, "is_test", *[r6(F.col(c)).alias(c) for c in _FAM])


SQL["label_coder"] = f"""
WITH s AS {OC_SPLIT},
  c AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INTEGER AS code FROM (
        SELECT DISTINCT o_orderpriority AS v FROM s
        WHERE NOT is_test AND o_orderpriority IS NOT NULL AND {_SLICE}) x)
SELECT o_orderkey, is_test, c.code FROM s LEFT JOIN c ON s.o_orderpriority = c.v"""


@register("label_coder")
def q_label_coder(spark, sf):
    s = oc_split(spark, sf)
    tr = train_test(s)[0].where(~F.col("o_orderpriority").eqNullSafe("5-LOW"))
    coder = E.fit_label_coder(tr, "o_orderpriority")
    return s.select("o_orderkey", "is_test", coder.code(F.col("o_orderpriority")).alias("code"))


SQL["knn_topk_pivots"] = SQL["knn_topk"]


@register("knn_topk_pivots")
def q_knn_topk_pivots(spark, sf):
    """The search past the broadcast bound: by pivots, units and distance bounds."""
    tr, te = train_test(emb_split(spark, sf))
    nb = knn_neighbors(tr, te, _FS, "vec_id", "vec_id", k=10, block_rows=64, broadcast_bytes=0)
    return nb.select("qid", F.col("nn_rank").cast("long").alias("nn_rank"), "rid",
                     r6(F.col("dist")).alias("dist"))


# --------------------------------------------------------------------------- #
# Missing values as NaN: the results of NULLs
# --------------------------------------------------------------------------- #
_NAN_COLS = ["flag", "few", "l_discount", "l_linenumber"]
_LI_NAN_SQL = """SELECT CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE (l_linenumber % 2)::DOUBLE END AS flag,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE (l_orderkey % 3)::DOUBLE END AS few, l_discount, l_linenumber FROM lineitem"""
SQL["infer_task_nan"] = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, "
    f"{_task_case(c, 'int' if c == 'l_linenumber' else 'float')} AS task FROM ({_LI_NAN_SQL}) t" for c in _NAN_COLS)


@register("infer_task_nan")
def q_infer_task_nan(spark, sf):
    nan = F.lit(float("nan"))
    li = read_table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") % 7 == 0, nan).otherwise((F.col("l_linenumber") % 2).cast("double")).alias("flag"),
        F.when(F.col("l_orderkey") % 5 == 0, nan).otherwise((F.col("l_orderkey") % 3).cast("double")).alias("few"),
        "l_discount", "l_linenumber")
    return infer_task_columns(li, _NAN_COLS)


_PRICE_GAPS = "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END"
SQL["target_encode_nan"] = _te_sql(PART_SPLIT, "p_partkey", _PRICE_GAPS, ["p_brand", "p_type"])


@register("target_encode_nan")
def q_target_encode_nan(spark, sf):
    s = add_split(read_table(spark, sf, "part"), ["p_partkey"], "part")
    s = s.withColumn("p_retailprice", F.when(F.col("p_partkey") % 9 == 0, F.lit(float("nan")))
                     .otherwise(F.col("p_retailprice")))
    m = E.fit_target_encoder(train_test(s)[0], ["p_brand", "p_type"], "p_retailprice", "regression")
    out = m.transform(s.select("p_partkey", "is_test", "p_brand", "p_type"))
    return out.select("p_partkey", "is_test", r6(F.col("p_brand")).alias("p_brand"), r6(F.col("p_type")).alias("p_type"))


SQL["r2_mae_nan"] = """
SELECT l_returnflag, count(p) AS n, count(*) - count(p) AS n_missing,
  round(1 - sum((y - p) ^ 2) / (var_pop(y) FILTER (p IS NOT NULL) * count(p)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae
FROM (SELECT l_returnflag, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS y,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE 950 * l_quantity + 1000 * l_tax END AS p FROM lineitem) t
WHERE y IS NOT NULL GROUP BY l_returnflag"""


@register("r2_mae_nan")
def q_r2_mae_nan(spark, sf):
    nan = F.lit(float("nan"))
    y = F.when(F.col("l_orderkey") % 11 == 0, nan).otherwise(F.col("l_extendedprice"))
    pred = F.when(F.col("l_linenumber") == 3, nan).otherwise(950 * F.col("l_quantity") + 1000 * F.col("l_tax"))
    r = regression_scores(read_table(spark, sf, "lineitem"), y, pred, ["l_returnflag"])
    return r.select("l_returnflag", "n", "n_missing", r6(F.col("r2")).alias("r2"), r6(F.col("mae")).alias("mae"))


# --------------------------------------------------------------------------- #
# Catalogue keys, metadata, failures by message, the result store
# --------------------------------------------------------------------------- #
SQL["registry_lookup"] = f"SELECT key, display, task, n_rows FROM ({REG_SQL}) r ORDER BY key LIMIT 1"


@register("registry_lookup")
def q_registry_lookup(spark, sf):
    reg = registry_table(spark, sf)
    return C.lookup(reg, C.list_keys(reg)[0]).select("key", "display", "task", "n_rows")


SQL["dataset_metadata"] = """
SELECT 'part' AS name, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE part)) AS n_cols,
  (SELECT count(*) FROM (DESCRIBE part)) - 1 AS n_features, 'p_retailprice' AS target,
  CASE WHEN count(DISTINCT p_retailprice) <= 2 THEN 'classification' ELSE 'regression' END AS task,
  'retail' AS sector, 'Parts' AS display, 'files' AS source, 'part.parquet' AS fetch_key, 'small' AS scale,
  'synthetic' AS license FROM part"""


@register("dataset_metadata")
def q_dataset_metadata(spark, sf):
    from ..sources.tables import metadata

    ds = Dataset("part", read_table(spark, sf, "part"), "p_retailprice", ["p_partkey"], sector="retail", meta=dict(
        display="Parts", source="files", fetch_key="part.parquet", scale="small", license="synthetic"))
    return metadata(ds).select("name", "n_rows", "n_cols", "n_features", "target", "task", "sector", "display",
                               "source", "fetch_key", "scale", "license")


SQL["failure_details"] = f"""WITH res AS ({RES_SQL})
SELECT status, substr(string_split(error, chr(10))[1], 1, 120) AS message, count(*) AS count,
  count(DISTINCT (key, method)) AS n_pairs
FROM res WHERE status IS NULL OR status <> 'ok' GROUP BY 1, 2"""


@register("failure_details")
def q_failure_details(spark, sf):
    return R.failure_details(_res(spark, sf))


SQL["store_round_trip"] = SQL["family_scores"]


@register("store_round_trip")
def q_store_round_trip(spark, sf):
    """Scores per pair, stored twice and compacted in between: every row is there once."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.results import append_results, compact_results, read_results

    scores = R.family_scores(_res(spark, sf)).select("key", "method", "model_family", "value")
    folder = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    append_results(scores, folder)
    compact_results(spark, folder)
    append_results(scores, folder)
    return read_results(spark, folder).select("key", "method", "model_family", r6(F.col("value")).alias("value"))


SQL["timeout_rows"] = """
SELECT 'documents' AS key, 'sleeps' AS method, 'timeout' AS status, 1.0::DOUBLE AS gen_elapsed_s
WHERE EXISTS (SELECT 1 FROM documents)"""


class SleepingMethod:
    name = "sleeps"

    def fit(self, train, target, task):
        import time

        time.sleep(20)


@register("timeout_rows")
def q_timeout_rows(spark, sf):
    from ..sources.results import rows_to_frame
    from .run import run_dataset

    rows = run_dataset(spark, _doc_dataset(spark, sf), [SleepingMethod()], ["linear"], budget_seconds=1)
    return rows_to_frame(spark, rows).select("key", "method", "status", "gen_elapsed_s")


# --------------------------------------------------------------------------- #
# Ready-to-train folds, logistic optimum
# --------------------------------------------------------------------------- #
SQL["ready_folds"] = SQL["tree_profile"]


@register("ready_folds")
def q_ready_folds(spark, sf):
    from .run import iter_folds

    oc = orders_customer(spark, sf).select("o_orderkey", "o_orderstatus", *_LIN_NUM, *_LIN_CAT)
    ds = Dataset("orders", oc, "o_orderstatus", ["o_orderkey"], task="classification")
    (fold,) = iter_folds(ds, "tree")
    both = fold.train.withColumn("is_test", F.lit(False)).unionByName(fold.test.withColumn("is_test", F.lit(True)))
    return both.select("o_orderkey", "is_test", *[r6(F.col(c)).alias(c) for c in _LIN_NUM], *_LIN_CAT)


def _newton_sql(steps: int = 12) -> str:
    """Newton's steps to the logistic optimum of one column, each a query over all rows."""
    parts = [f"""tr AS MATERIALIZED (SELECT n_chars / 1000.0 AS x, (quality = 1)::DOUBLE AS y FROM {DL_SPLIT} t
  WHERE NOT is_test AND quality IS NOT NULL)""", "b0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS w)"]
    for i in range(steps):
        parts.append(f"""b{i + 1} AS MATERIALIZED (
  SELECT a - (hww * ga - haw * gw) / (haa * hww - haw * haw) AS a, w - (haa * gw - haw * ga) / (haa * hww - haw * haw) AS w
  FROM (SELECT any_value(a) AS a, any_value(w) AS w, sum(p - y) AS ga, sum((p - y) * x) + any_value(w) AS gw,
          sum(p * (1 - p)) AS haa, sum(p * (1 - p) * x) AS haw, sum(p * (1 - p) * x * x) + 1 AS hww
        FROM (SELECT x, y, a, w, 1 / (1 + exp(-(a + w * x))) AS p FROM tr, b{i}) q) h)""")
    return f"WITH {', '.join(parts)} SELECT round(w, 4) AS coef, round(a, 4) AS intercept FROM b{steps}"


SQL["logistic_coeffs"] = _newton_sql()


@register("logistic_coeffs")
def q_logistic_coeffs(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    from ..operators.models import logistic_estimator

    tr, _ = train_test(dl_split(spark, sf))
    tr = tr.where("quality IS NOT NULL").select((F.col("n_chars") / 1000.0).alias("x"),
                                                F.col("quality").cast("double").alias("__c"))
    v = VectorAssembler(inputCols=["x"], outputCol="__features").transform(tr)
    model = logistic_estimator(v.count()).fit(v)
    return spark.range(1).select(F.round(F.lit(float(model.coefficients[0])), 4).alias("coef"),
                                 F.round(F.lit(float(model.intercept)), 4).alias("intercept"))
