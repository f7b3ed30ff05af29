"""The result store: a folder of JSON lines, one file per (dataset, method) pair,
read back with a fixed schema.

A pair's file has a fixed name and is put in place by one rename, so storing a
pair again (after a failure between writing and the answer, or to retry it)
replaces its rows instead of adding to them.  ``compact_results`` turns all files
into one; whatever of it a failure leaves undone, each pair's rows are read from
one file, the latest.  Resume is an anti-join of the requested pairs against the
stored ones.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import json_row
from . import files

RESULT_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("fold_id", T.StringType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("gen_elapsed_s", T.DoubleType()),
    T.StructField("fit_elapsed_s", T.DoubleType()),
    T.StructField("transform_elapsed_s", T.DoubleType()),
    T.StructField("peak_mem_mb", T.DoubleType()),
    T.StructField("n_candidates", T.LongType()),
    T.StructField("feature_efficiency", T.DoubleType()),
    T.StructField("model_family", T.StringType()),
    T.StructField("n_features_generated", T.LongType()),
    T.StructField("n_features_final", T.LongType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("mae", T.DoubleType()),
    T.StructField("error", T.StringType()),
])
STATUSES = ("ok", "timeout", "oom", "crashed", "error", "model_error")


def rows_to_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Result dicts (missing fields -> NULL) as a DataFrame of the fixed schema."""
    names = RESULT_SCHEMA.fieldNames()
    fixed = []
    for r in rows:
        vals = []
        for f in RESULT_SCHEMA.fields:
            v = r.get(f.name)
            if v is not None and isinstance(f.dataType, T.DoubleType):
                v = float(v)
            elif v is not None and isinstance(f.dataType, T.LongType):
                v = int(v)
            elif v is not None and isinstance(f.dataType, T.StringType):
                v = str(v)
            vals.append(v)
        fixed.append(tuple(vals))
    return spark.createDataFrame(fixed, RESULT_SCHEMA).select(*names)


def pair_file(key: str | None, method: str | None) -> str:
    text = "\0".join("n" if x is None else f"v{x}" for x in (key, method))
    return f"pair-{hashlib.sha256(text.encode()).hexdigest()[:32]}.json"


def append_results(df: DataFrame, out_dir: str) -> None:
    """Store the rows of whole pairs (a few rows each), a file per pair."""
    lines: dict[str, list[str]] = {}
    for r in df.select("key", "method", json_row(*df.columns).alias("line")).collect():
        lines.setdefault(pair_file(r["key"], r["method"]), []).append(r["line"])
    for name, found in lines.items():
        files.write_text(df.sparkSession, f"{out_dir}/{name}", "\n".join(found) + "\n")


def compact_results(spark: SparkSession, out_dir: str) -> int:
    """All files of the store as one; returns how many there were.  Files written
    meanwhile stay beside it."""
    old = files.list_files(spark, out_dir)
    old = [f for f in old if f[0].endswith(".json") and not f[0].startswith(("_", "."))]
    last = max([int(m[1]) for name, *_ in old if (m := re.match(r"all-(\d+)\.json", name))], default=0)
    # only the listed files: one that arrives now isn't absorbed
    rows = _latest(spark.read.schema(RESULT_SCHEMA).json([path for _, path, _, _ in old]))
    lines = [r[0] for r in rows.select(json_row(*RESULT_SCHEMA.fieldNames())).collect()]
    files.write_text(spark, f"{out_dir}/all-{last + 1:08d}.json", "\n".join(lines) + "\n")
    for name, path, size, time in old:
        if (name, path, size, time) in files.list_files(spark, path):  # not replaced since
            files.remove(spark, path)
    return len(old)


def _latest(rows: DataFrame) -> DataFrame:
    """The rows of each pair's latest file: its own, else of the latest compaction,
    else of any other file."""
    name = F.col("_metadata.file_name")
    named = rows.select("*", F.when(name.rlike("^(pair|all)-"), name).otherwise("").alias("__file"))
    newest = F.max("__file").over(Window.partitionBy("key", "method"))
    return named.withColumn("__newest", newest).where("__file = __newest").select(*rows.columns)


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """All stored rows; narrower rows (fewer fields) read as NULLs."""
    if not files.exists(spark, out_dir):
        return spark.createDataFrame([], RESULT_SCHEMA)
    return _latest(spark.read.schema(RESULT_SCHEMA).json(out_dir))


def done_pairs(results: DataFrame) -> DataFrame:
    return results.select("key", "method").distinct()


def pending_pairs(requested: DataFrame, results: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Requested (key, method) pairs with no stored row.  With
    ``retry_failed`` a pair whose rows all failed is pending again."""
    done = results
    if retry_failed:
        done = results.where(F.col("status") == "ok")
    return requested.join(done_pairs(done), ["key", "method"], "left_anti")
