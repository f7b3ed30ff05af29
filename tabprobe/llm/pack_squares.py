"""Sum-of-squares online packing of documents into fixed windows.

A document's tokens are cut into full windows and one remainder.  Each
remainder is placed, in arrival order, into the open window level h that
minimises the sum of squared counts of open windows per level: moving a window
from level h to h+s changes the sum by ``2(N[h+s] - N[h]) + 2``; opening one
costs ``2N[s] + 1`` and completing one ``-2N[h] + 1``.  ``N`` is one array of
``window`` counters.

Every input partition is a stream of its own, so nothing is shuffled and a
lost task is repeated from the same file split.  When a stream ends, its open
windows are closed: the emptiest are taken apart and their pieces, cut where
needed, fill the fullest; the one window left over is cut into lengths that are
powers of two, which need no padding.

Input partitions must come back alike when they are computed again (files, a
written table); write a shuffled frame first.

Edge cases: a null or empty text is its end token alone; repeated rows and rows
without an id are packed like any other; an empty table gives no row; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.tokens import encoder

SCHEMA = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, ids binary")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64()), ("ids", pa.binary())])
#: token bytes gathered before a batch of pieces leaves the task
FLUSH_BYTES = 16 << 20


class SquaresPacker:
    """Pieces are ``(doc_id, start, doc_tokens, ids)``; ``emit`` gets each
    finished window as a list of pieces."""

    def __init__(self, window: int, emit):
        self.window, self.emit = window, emit
        # N[h] for "from" (levels without an open window can't be chosen) and "to";
        # the halves make opening and completing a window cost what the sum of squares says
        self.source = np.full(window + 1, -np.inf)
        self.target = np.zeros(window + 1)
        self.source[0], self.target[window] = 0.5, -0.5
        self.open: list[list] = [[] for _ in range(window)]

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        full = n - n % w
        for s in range(0, full, w):
            self.emit([(doc_id, s, n, ids[s:s + w])])
        if full < n:
            self._place((doc_id, full, n, ids[full:]), n - full)

    def _place(self, piece, size: int) -> None:
        w = self.window
        change = self.target[size:] - self.source[:w + 1 - size]
        h = len(change) - 1 - int(change[::-1].argmin())  # of equal changes, the fullest level
        if h == 0:
            window = [piece]
        else:
            window = self.open[h].pop()
            window.append(piece)
            self._count(h)
        if h + size == w:
            self.emit(window)
        else:
            self.open[h + size].append(window)
            self._count(h + size)

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        self.target[level] = n
        self.source[level] = n if n else -np.inf

    def close(self) -> None:
        windows = [[x, lv] for lv in range(self.window - 1, 0, -1) for x in self.open[lv]]
        self.open = [[] for _ in range(self.window)]
        i, j = 0, len(windows) - 1
        while i < j:
            into, level = windows[i]
            source, held = windows[j]
            piece = source.pop()
            take = min(self.window - level, len(piece[3]))
            into.append((piece[0], piece[1], piece[2], piece[3][:take]))
            if take < len(piece[3]):
                source.append((piece[0], piece[1] + take, piece[2], piece[3][take:]))
            windows[i][1], windows[j][1] = level + take, held - take
            if windows[i][1] == self.window:
                self.emit(into)
                i += 1
            if not source:
                j -= 1
        if i == j:
            self._powers(*windows[i])

    def _powers(self, pieces: list, level: int) -> None:
        pieces = pieces[::-1]
        while level:
            room = 1 << (level.bit_length() - 1)
            level -= room
            window = []
            while room:
                d, s, n, ids = pieces.pop()
                window.append((d, s, n, ids[:room]))
                if len(ids) > room:
                    pieces.append((d, s + room, n, ids[room:]))
                room -= len(window[-1][3])
            self.emit(window)


def _pack_stream(batches: Iterator[pa.RecordBatch], first_id: int, window: int, end_id: int,
                 tokenizer: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    state = {"id": first_id, "bytes": 0}

    def emit(pieces):
        offset = 0
        for d, s, n, ids in pieces:
            rows.append((d, s, len(ids), n, state["id"], offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        state["id"] += 1
        state["bytes"] += 4 * offset

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
        rows.clear()
        state["bytes"] = 0
        return out

    packer, enc = SquaresPacker(window, emit), encoder(tokenizer)
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            packer.add(doc_id, np.append(enc.ids(text.as_py()), np.uint32(end_id)))
            if state["bytes"] >= FLUSH_BYTES:
                yield flush()
    packer.close()
    if rows:
        yield flush()


def pack(docs: DataFrame, *, window: int = 1024, end_id: int = 0,
         tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece: which tokens of which document (``start``, ``length``,
    ``doc_tokens``) lie where (``sequence_id``, ``offset``), and the token ids
    themselves as little-endian unsigned 32-bit integers (``ids``)."""
    def run(batches):
        first = TaskContext.get().partitionId() << 36
        return _pack_stream(batches, first, window, end_id, tokenizer)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")) \
        .mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
