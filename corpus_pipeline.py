"""Training-corpus pipeline: the stages, in order, over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; between stages the documents are written as Parquet in the
shared checkpoint folder and read again.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabprobe.llm import decontaminate, language_gru, pack_squares, pseudonyms, simhash
from tabprobe.llm.common import read
from tabprobe.session import ensure_checkpoint_dir

#: the key of the pseudonyms in this demonstration; real runs set a secret of their own
PSEUDONYM_KEY = b"demonstration key, not a secret"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those without a letter, and those whose evidence
    (pooled probability of the best language times the share of letters) is below
    0.1.  The network learns from the documents' own language marks; without marks
    the share of letters decides alone."""
    return language_gru.in_a_language(docs, language_gru.trained(docs), min_evidence=0.1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 3-word shingles,
    fingerprints linked at 3 bits."""
    return simhash.one_per_component(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat half of a test item or more go; items of one word take
    none away, and without items all stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms."""
    return pseudonyms.pseudonymised(docs, key=PSEUDONYM_KEY).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; a row per piece."""
    return pack_squares.digest(pack_squares.pack(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Models and hashes of the stages aren't expressible in SQL; the tests hold
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
