"""Fill-in-middle transformation by block rotation in place.

A text is cut at two places between its units (runs of the letters A-Z and a-z;
any other character is a unit of its own) into prefix, middle and suffix.  The
cuts and the form come from a hash of the seed and the document's id, so every
run gives the same.  A bytearray holds the text; a sentinel is inserted before
each part, and the parts change places where they lie: two neighbouring blocks
are exchanged by reversing each of them and then both together.

========  ============================================
``psm``   ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
``spm``   ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
``plain`` the text as it is
========  ============================================

``restored`` finds the sentinels of an output, turns the blocks back and takes
the sentinels out, which gives the text exactly: no sentinel can arise where a
part meets one, as each begins with ``<``, ends with ``>`` and has neither inside.

Cuts are found by scanning the text's bytes in blocks; a task holds a few
times the largest text, and nothing is shuffled.

Edge cases: a null text is empty; empty texts and texts that contain a sentinel
are ``plain``, as is the share of texts that stay untransformed; a document
without an id is hashed with an empty id; repeated rows get equal results; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import in_chunks

P, S, M = b"<P>", b"<S>", b"<M>"
#: bytes that are scanned at once
SCAN_BYTES = 1 << 20


def _starts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where units begin in bytes ``a`` to ``b`` of the UTF-8 text ``data``."""
    lo = max(a - 1, 0)
    part = data[lo:b]
    letter = ((part | 0x20) - np.uint8(97)) < 26
    first = (part & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first[a - lo:]) + a


class Units:
    """Units of a text, counted block by block."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        self.counts = [len(_starts(self.data, a, min(a + SCAN_BYTES, len(data))))
                       for a in range(0, len(data), SCAN_BYTES)]
        self.n = sum(self.counts)

    def offset(self, k: int) -> int:
        """Byte offset after the first ``k`` units."""
        if k >= self.n:
            return len(self.data)
        block = 0
        while k >= self.counts[block]:
            k -= self.counts[block]
            block += 1
        a = block * SCAN_BYTES
        return int(_starts(self.data, a, min(a + SCAN_BYTES, len(self.data)))[k])


def exchange(buffer: bytearray, a: int, b: int, c: int) -> None:
    """Blocks [a, b) and [b, c) of the buffer change places: three reversals."""
    for x, y in ((a, b), (b, c), (a, c)):
        buffer[x:y] = buffer[x:y][::-1]


def code_points(data: bytes | bytearray, a: int, b: int) -> int:
    part = np.frombuffer(data, np.uint8, b - a, a) if b > a else np.empty(0, np.uint8)
    return int(np.count_nonzero((part & 0xC0) != 0x80))


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers of 32 bits for a document."""
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(text[i:i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str | None, doc_id, *, seed: int = 1, percent: int = 90, spm_percent: int = 20):
    """(units, form, prefix_chars, middle_chars, output as bytes) of one text."""
    data = (text or "").encode()
    units = Units(data)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or h3 % 100 >= percent or any(x in data for x in (P, S, M)):
        return units.n, "plain", None, None, data
    cuts = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = (units.offset(k) for k in cuts)
    sizes = code_points(data, 0, a), code_points(data, a, b)
    buffer = bytearray(data)
    for at, mark in ((b, S), (a, M), (0, P)):  # from the back, so that offsets hold
        buffer[at:at] = mark
    a, b = a + len(P), b + len(P) + len(M)
    if h4 % 100 < spm_percent:
        exchange(buffer, 0, b, len(buffer))
        return units.n, "spm", *sizes, bytes(buffer)
    exchange(buffer, a, b, len(buffer))
    return units.n, "psm", *sizes, bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "spm":
        exchange(buffer, 0, buffer.index(P), len(buffer))
    else:
        exchange(buffer, buffer.index(S), buffer.index(M), len(buffer))
    for mark in (S, M, P):
        at = buffer.index(mark)
        del buffer[at:at + len(mark)]
    return bytes(buffer)


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                  ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_BACK = pa.schema([*_OUT, ("restored", pa.string())])


def transform(docs: DataFrame, *, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_chars and middle_chars (code points; null
    if plain) and output, for every document.  ``percent`` of the texts are
    transformed, ``spm_percent`` of these with the suffix first."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(doc_id, text):
            n, form, prefix, middle, output = transformed(
                text, doc_id, seed=seed, percent=percent, spm_percent=spm_percent)
            return (doc_id, n, form, prefix, middle, output.decode()), len(output)
        return in_chunks(batches, one, _OUT)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        rows, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(found: DataFrame) -> DataFrame:
    """``found`` (rows of ``transform``) with ``restored``, the text rebuilt from
    output and form alone."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(*row):
            text = restore(row[5].encode(), row[2])
            return (*row, text.decode()), 2 * len(text)
        return in_chunks(batches, one, _BACK)

    return found.select(*_OUT.names).mapInArrow(
        rows, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
              "output string, restored string")


def digest(found: DataFrame) -> DataFrame:
    """Rows of ``restored`` with hashes in place of the texts."""
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                        F.sha2("output", 256).alias("output_sha256"),
                        F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents),
drawn AS (
  SELECT doc_id, t, units, len(units) AS n,
         CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (len(units) + 1) AS c1,
         CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (len(units) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
cut AS (
  SELECT doc_id, t, n, form,
         array_to_string(units[1:least(c1, c2)], '') AS p,
         array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(units[greatest(c1, c2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
