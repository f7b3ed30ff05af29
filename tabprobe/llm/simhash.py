"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: XXH64 (seed 42) of every word shingle, one bit per position set
where over half of the hashes have it.  Linking at up to ``max_bits``
differing bits: the fingerprint is cut into ``max_bits // 2 + 1`` segments, so
two linked fingerprints have a segment that differs in one bit at most.  Each
segment is indexed as itself and once per bit with that bit left out; linked
fingerprints share one of these variants, which an equality join finds, and
the whole distance is then checked.  A variant with a bit left out pairs only
fingerprints that do differ in it, so no pair is found twice in a segment.

Only distinct fingerprints are joined, so copies of a text cost one row however
many they are.  The join's output is verified links alone, and a fingerprint
has at most C(64,1) + C(64,2) + C(64,3) = 43,744 others within three bits, so
the output grows with the number of distinct fingerprints and not with the
square of a group.

Edge cases: a null text, an empty one, or one of white space has fingerprint
zero and is linked like any other; fewer words than the shingle length make
one shingle; rows without an id get the least id of their component (null if
it has none); repeated rows are each returned; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import free_name, text_key, written
from tabprobe.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in
                          zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())),
                         np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 1 << 15):
        part = hashes[s:s + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a long), a row per document."""
    source = docs.select(*keep, F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(len(keep))),
                              np.uint64, batch.num_rows).view(np.int64)
            names = list(batch.schema.names[:len(keep)]) + ["fp"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(fps)], names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, fp bigint")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """(key, fp, side) per segment: as it is (side null), and with each of its
    bits left out (side: that bit)."""
    parts = max_bits // 2 + 1
    width = 64 // parts
    sizes = [width] * (parts - 1) + [64 - width * (parts - 1)]
    segments = F.array(*[
        F.struct(F.lit(p).alias("part"), F.lit(size).alias("size"),
                 F.shiftrightunsigned("fp", p * width).bitwiseAND(
                     (1 << size) - 1 if size < 64 else -1).alias("value"))
        for p, size in enumerate(sizes)])
    out = fps.select("fp", F.explode(segments).alias("s")).select("fp", "s.*")
    out = out.select("*", F.explode(F.expr("sequence(0, size)")).alias("bit"))
    masked = F.expr("value & ~(CASE WHEN bit < size THEN shiftleft(1L, bit) ELSE 0L END)")
    side = F.expr("CASE WHEN bit < size THEN shiftright(value, bit) & 1L END")
    if max(sizes) <= 48:  # part, bit and value fit in one long
        key = F.expr("shiftleft(CAST(part AS BIGINT), 56) | shiftleft(CAST(bit AS BIGINT), 48)") \
            .bitwiseOR(masked)
    else:
        key = F.struct("part", "bit", masked.alias("masked"))
    return out.select(key.alias("key"), "fp", side.alias("side"))


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """All links ``(a, b)`` of two different fingerprints of the column ``fp``
    (distinct values) with at most ``max_bits`` differing bits."""
    keyed = _variants(fps, max_bits)
    low = keyed.where("side IS NULL OR side = 0").select("key", F.col("fp").alias("a"), "side")
    high = keyed.where("side IS NULL OR side = 1").select(
        F.col("key").alias("key_b"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return low.join(high, (F.col("key") == F.col("key_b")) & near
                    & (F.col("side").isNotNull() | (F.col("a") < F.col("b")))) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """``doc_id``, ``text_key`` (content key), ``fp``, ``root`` (the
    component's least fingerprint) and ``component_id`` (the least doc_id that
    links reach), a row per document."""
    marked = written(fingerprints(docs.select("doc_id", text_key().alias("text_key"), "text"),
                                  shingle, keep=("doc_id", "text_key")))
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(distinct.select("fp"), max_bits), "a", "b")
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = classes.join(classes.groupBy("root").agg(F.min("least_id").alias("component_id")),
                         "root").select("fp", "root", "component_id")
    # one fingerprint may be that of a third of all documents: spread its rows
    salts = 16
    salt = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)).cast("int")
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return marked.withColumn("salt", salt).join(spread, ["fp", "salt"]) \
        .select("doc_id", "text_key", "fp", "root", "component_id")


def one_per_component(docs: DataFrame, *, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The documents that stay: of each component the one with the least id
    (of equal ids, the least content key; of equal rows, one).  Columns as in ``docs``."""
    found = near_duplicates(docs, shingle=shingle, max_bits=max_bits)
    # by root: components of rows without an id share a null component_id
    first = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"))
    # one key, never null, for the join and for equal rows: texts are shuffled once
    key = free_name(docs.columns, "__key")
    row_key = lambda doc_id, text: F.struct(doc_id.isNull().alias("n"), F.coalesce(doc_id, F.lit(0)).alias("d"),
                                            text.alias("t"))
    chosen = first.select(row_key(F.col("first.doc_id"), F.col("first.text_key")).alias(key))
    return docs.withColumn(key, row_key(F.col("doc_id"), text_key())).join(chosen, key, "left_semi") \
        .dropDuplicates([key]).drop(key)
