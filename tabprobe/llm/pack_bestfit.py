"""Best-fit-decreasing packing into rows of token ids ready for training.

Documents longer than a row are cut into full rows and one remainder, so no
token is lost.  Within a block of ``block_docs`` remainders (bounded memory, one
block after another in each input partition, no shuffle) remainders are taken
by decreasing length, and each goes into the open row whose free room fits it
best.  That row is found in a segment tree over free capacities, in
O(log row length).

Each output row is one line of the packed matrix: ``ids`` (``width``
little-endian token ids, padded with ``pad_id``), ``cu_lengths`` (cumulative
segment lengths, from 0 to the row's fill), ``positions`` (unsigned 16- or 32-bit positions
that restart at 0 with each segment and in the padding), and which document
tokens the segments are (``doc_ids``, ``doc_starts``).

Edge cases: a null or empty text is its end token alone; repeated rows and rows
without an id are packed like any other; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.tokens import encoder

SCHEMA = ("row_id bigint, n_tokens int, ids binary, cu_lengths array<int>, positions binary, "
          "doc_ids array<bigint>, doc_starts array<bigint>")
_ARROW = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                    ("cu_lengths", pa.list_(pa.int32())), ("positions", pa.binary()),
                    ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64()))])


class CapacityTree:
    """Open rows by free capacity, with the least sufficient capacity found by
    walking a segment tree of counts."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The (row, capacity) with the least capacity of at least ``size``."""
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Indices of ``sizes`` by row; sizes lie in 1..width."""
    tree, rows = CapacityTree(width), []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[i])
        if found is None:
            rows.append([])
            found = len(rows) - 1, width
        row, capacity = found
        rows[row].append(i)
        if capacity > sizes[i]:
            tree.put(capacity - sizes[i], row)
    return rows


def _rows(batches, first_id: int, width: int, end_id: int, pad_id: int, dtype: str,
          tokenizer: str, block_docs: int, flush_rows: int) -> Iterator[pa.RecordBatch]:
    enc, out, rest = encoder(tokenizer), [], []
    next_id = first_id
    position_type = "<u2" if width <= 1 << 16 else "<u4"
    ramp = np.arange(width, dtype=position_type)

    def line(segments):
        nonlocal next_id
        ids, positions = np.full(width, pad_id, dtype), np.zeros(width, position_type)
        cu = [0]
        for _, _, tokens in segments:
            a, b = cu[-1], cu[-1] + len(tokens)
            ids[a:b], positions[a:b] = tokens, ramp[:b - a]
            cu.append(b)
        positions[cu[-1]:] = ramp[:width - cu[-1]]
        out.append((next_id, cu[-1], ids.tobytes(), cu, positions.tobytes(),
                    [s[0] for s in segments], [s[1] for s in segments]))
        next_id += 1

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)
        out.clear()
        return batch

    def close_block():
        for group in best_fit_decreasing([len(r[2]) for r in rest], width):
            line([rest[i] for i in group])
            if len(out) >= flush_rows:
                yield flush()
        rest.clear()

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(enc.ids(text.as_py()), np.uint32(end_id))
            if ids.max() > np.iinfo(dtype).max:
                raise ValueError(f"id {ids.max()} doesn't fit {dtype}; use <u4")
            ids = ids.astype(dtype)
            full = len(ids) - len(ids) % width
            for s in range(0, full, width):
                line([(doc_id, s, ids[s:s + width])])
                if len(out) >= flush_rows:
                    yield flush()
            if full < len(ids):
                rest.append((doc_id, full, ids[full:].copy()))
            if len(rest) >= block_docs:
                yield from close_block()
    yield from close_block()
    if out:
        yield flush()


def packed_matrix(docs: DataFrame, *, width: int = 2048, end_id: int = 50256, pad_id: int = 0,
                  dtype: str = "<u2", tokenizer: str = "byte_bpe_50k.json",
                  block_docs: int = 16384, flush_rows: int = 1024) -> DataFrame:
    """The packed matrix of all documents, a row per line (see module text).
    ``dtype`` must hold the vocabulary: ``<u2`` up to 65,536 ids, else ``<u4``."""
    def run(batches):
        first = TaskContext.get().partitionId() << 36
        return _rows(batches, first, width, end_id, pad_id, dtype, tokenizer, block_docs,
                     flush_rows)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .mapInArrow(run, SCHEMA)


def write_matrix(docs: DataFrame, path: str, **options) -> None:
    """Write the packed matrix as Parquet files; fixed-width ``ids`` and
    ``positions`` cells can be read back with ``numpy.frombuffer``."""
    packed_matrix(docs, **options).write.mode("errorifexists").parquet(path)
