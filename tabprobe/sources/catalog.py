"""Dataset catalogue as tables: registry, exclusion names, split plan,
corpus building and coverage -- small tables, but ordinary DataFrames so
they join with result tables and grow with whatever feeds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import HOLDOUT_TEST_SIZE, seed_for, sector_family
from ..operators.splits import PROTOCOL

REGISTRY_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("display", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("scale", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("fetch_key", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("pos", T.IntegerType()),
])
SPLIT_PLAN_SCHEMA = "key string, protocol string, seed long, test_size double, stratify boolean"
SCALE_ORDER = {"small": 0, "medium": 1, "large": 2}


def registry_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    data = [tuple([r.get(f.name) if f.name != "pos" else i for f in REGISTRY_SCHEMA.fields])
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, REGISTRY_SCHEMA)


def list_keys(registry: DataFrame) -> list[str]:
    """All keys, sorted; an empty key is an error."""
    keys = [r[0] for r in registry.select("key").orderBy("key").collect()]
    if any(not k for k in keys):
        raise ValueError("the registry has an entry without a key")
    return keys


def lookup(registry: DataFrame, key: str) -> DataFrame:
    """The entry of a key; an unknown one is an error."""
    keys = list_keys(registry)
    if key not in keys:
        raise KeyError(f"unknown dataset {key!r}; known are {keys}")
    return registry.where(F.col("key") == F.lit(key))


def exclusion_names(registry: DataFrame) -> DataFrame:
    """Every lower-cased name a dataset is known by: key, fetch key, display, aliases."""
    names = F.concat(F.array(F.lower("key"), F.lower("fetch_key"), F.lower("display")),
                     F.transform(F.coalesce(F.col("aliases"), F.array().cast("array<string>")),
                                 lambda a: F.lower(a)))
    return registry.select(F.explode(names).alias("name")).where(F.col("name").isNotNull()).distinct()


def split_plan(registry: DataFrame, test_size: float = HOLDOUT_TEST_SIZE) -> DataFrame:
    """The frozen split recipe per dataset: seed from the key only."""
    return registry.select(
        "key", F.lit(PROTOCOL).alias("protocol"), seed_for(F.col("key")).alias("seed"),
        F.lit(float(test_size)).alias("test_size"),
        (F.col("task") != F.lit("regression")).alias("stratify"))


def write_split_plan(plan: DataFrame, path: str) -> None:
    plan.coalesce(1).write.mode("overwrite").json(path)


def load_split_plan(spark: SparkSession, path: str, registry: DataFrame | None = None) -> DataFrame:
    """Read the frozen plan; fall back to computing it from the registry."""
    from .files import exists

    if exists(spark, path):
        return spark.read.schema(SPLIT_PLAN_SCHEMA).json(path)
    if registry is None:
        raise FileNotFoundError(path)
    return split_plan(registry)


def key_duplicates(table: DataFrame, key: list[str] = ("key",)) -> DataFrame:
    """Keys that occur more than once (none in a registry)."""
    return table.groupBy(*key).count().where(F.col("count") > 1)


def dataset_order(registry: DataFrame) -> DataFrame:
    """Small -> medium -> large, stable by registry position."""
    rank = F.coalesce(*[F.when(F.col("scale") == F.lit(s), F.lit(i)) for s, i in SCALE_ORDER.items()],
                      F.lit(len(SCALE_ORDER)))
    return registry.withColumn("scale_rank", rank).orderBy("scale_rank", "pos")


def coverage_matrix(registry: DataFrame) -> DataFrame:
    """Sector family x task: number of datasets and their keys."""
    return registry.groupBy(sector_family(F.col("sector")).alias("sector_family"), "task").agg(
        F.count(F.lit(1)).alias("n_datasets"), F.sort_array(F.collect_set("key")).alias("keys"))


def build_corpus(members: DataFrame, exclusion: DataFrame, name: Column | str = "name",
                 cap: int | None = None, stubs: DataFrame | None = None) -> DataFrame:
    """Suites -> first-seen dedupe by lower-cased name (suite order, then
    position) -> minus the exclusion names -> all, or the first ``cap`` in
    order if a cap is asked for -> then the error stubs.

    ``members`` has ``suite_pos, pos`` and the name column; dedupe is an
    aggregation (min of the order key), so a name repeated in a third of
    all rows is still one partial-aggregated group.  Members without a name aren't
    duplicates of each other: all of them stay.
    """
    nm = F.col(name) if isinstance(name, str) else name
    others = [c for c in members.columns if c not in ("suite_pos", "pos")]
    keyed = members.withColumn("__lname", F.lower(nm)).withColumn("__k", F.sha2(F.col("__lname"), 256))
    named = keyed.where(F.col("__k").isNotNull())
    # the order key alone is aggregated; names and bodies join back by it
    first = named.groupBy("__k").agg(F.min(F.struct("suite_pos", "pos")).alias("__r")) \
        .select("__k", F.col("__r.suite_pos").alias("suite_pos"), F.col("__r.pos").alias("pos"))
    first = named.join(first, ["__k", "suite_pos", "pos"]).dropDuplicates(["__k", "suite_pos", "pos"])
    # left-anti on the exclusion names; AQE broadcasts it when it is small
    kept = first.join(exclusion.select(F.lower("name").alias("__lname")), "__lname", "left_anti")
    out = kept.unionByName(keyed.where(F.col("__k").isNull())).select("suite_pos", "pos", *others)
    out = out.orderBy("suite_pos", "pos") if cap is None else out.orderBy("suite_pos", "pos").limit(cap)
    if stubs is not None:
        out = out.unionByName(stubs, allowMissingColumns=True)
    return out
