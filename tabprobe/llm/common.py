"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that
    later jobs neither recompute it nor depend on an executor's disk."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores as it takes to differ from all of ``taken``."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


#: text (in characters or bytes) after which rows leave a task
FLUSH = 8 << 20


def in_chunks(batches: Iterator[pa.RecordBatch], one: Callable, schema: pa.Schema,
              flush: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """``one(*row)`` gives a result row and its size; results leave the task as
    soon as they reach ``flush`` together."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            done, weight = one(*(cell.as_py() for cell in row))
            held.append(done)
            size += weight
            if size > flush:
                yield as_batch(held, schema)
                held, size = [], 0
    if held:
        yield as_batch(held, schema)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def text_key(text: str = "text") -> Column:
    """64-bit content key; a null text has a key of its own."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))
