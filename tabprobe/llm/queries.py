"""The registered queries of this subpackage: each operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.llm import (bpe_merge, decontaminate, fill_middle, language_gru, line_frequency, pack_bestfit,
                          pack_squares, pseudonyms, quality_ftrl, secrets_grammar, simhash, suffix_dedup, va_file)
from tabprobe.llm.common import read

#: the key of the registered query; real runs pass a secret of their own
DEMO_KEY = b"demonstration key, not a secret"


def op1_pack_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_squares.digest(pack_squares.pack(read(spark, sf_dir, "documents")))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.verdicts(read(spark, sf_dir, "documents"))


def op3_pack_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_bestfit.packed_matrix(read(spark, sf_dir, "documents"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, key=DEMO_KEY)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contaminated(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_grammar.digest(secrets_grammar.find_secrets(read(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_gru.report(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.without_repeats(read(spark, sf_dir, "documents")))


def op11_bpe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_merge.digest(bpe_merge.decoded(bpe_merge.encoded(read(spark, sf_dir, "documents"))))


def op12_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.digest(va_file.cluster(read(spark, sf_dir, "embeddings")))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.restored(fill_middle.transform(read(spark, sf_dir, "documents"))))


SPARK = {f.__name__: f for f in (
    op1_pack_squares, op2_line_frequency, op3_pack_bestfit, op4_pseudonyms, op5_simhash, op6_decontaminate,
    op7_secrets, op8_language, op9_quality, op10_suffix_dedup, op11_bpe_merge, op12_va_file, op13_fill_middle)}
SQL = {"op2_line_frequency": line_frequency.ORACLE_SQL, "op12_va_file": va_file.ORACLE_SQL,
       "op13_fill_middle": fill_middle.ORACLE_SQL}
