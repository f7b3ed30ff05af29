"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if it lies in a ``match``-byte string that also starts in a
document with a smaller id.  The corpus' suffixes are dealt to buckets by
content, and each bucket keeps its own index family: batches of documents in id
order get a suffix array, are merge-scanned against the arrays of the levels
built so far, and enter level 0; two arrays of a level merge into one of the
next, so sizes grow geometrically and a suffix is merged a logarithmic number
of times.

Dealing.  Every ``match``-byte window chooses an anchor inside itself from its
content alone (the position of its least hashed 9-byte string, taken modulo the
number of possible anchors: a mod-minimizer), so equal windows choose equal
anchors, and the ``anchor`` bytes there name a bucket.  About one position in
19 is an anchor.

1. Documents are dealt into blocks.  Each block sends its different anchors, as
   32-bit codes within their bucket, and learns which occur in another block.
2. Each block sends the contexts (all windows that contain it) of the anchors
   that repeat there or in another block, and the buckets' index families
   answer with spans.  A block sends equal contexts once, with its least id; its
   other holders are covered at once, so a passage that a third of all documents
   share reaches its bucket once per block.  Equal contexts of one document are one
   row with the stretches where it lies.  Of equal contexts in a bucket, again
   only those of the least id need their windows looked up.
   An anchor that occurs more than ``HOT`` times in all (a title or a rule of
   dashes between differing texts) would bring one bucket a context per document:
   its contexts are taken apart, and each window goes to a bucket of its own
   content, where equal windows meet; again a block sends each once.
3. Each block cuts its texts.

The three steps read one shuffle of the documents by block.  The arrays compare
bytes; codes only choose candidates, and equal contexts are recognised by 64-bit
hashes.

Edge cases: null and empty texts have no bytes; rows of one id never clean each
other; rows without an id come after all others and don't clean each other;
repeated rows are each returned; an empty table gives no row; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, ANCHOR, MINIMISER = 50, 30, 9
CHOICES = MATCH - ANCHOR + 1          # anchors a window can choose from
LEFT = CHOICES - 1                    # bytes of context before an anchor
WIDTH = LEFT + MATCH                  # context bytes
NO_ID = (1 << 63) - 1
CHUNK_ANCHORS, TILE = 400_000, 1 << 16
#: occurrences beyond which an anchor's windows are dealt one by one, and how many
#: contexts are taken apart at once
HOT, HOT_AT_ONCE = 1 << 14, 1 << 13
#: bytes are kept plus one, so that 0 can stand for "outside the document"
#: (UTF-8 has no byte 255)
_PLUS = bytes(range(1, 256)) + b"\xff"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_POSITION = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Sorted anchor positions of the windows that start where ``valid`` holds
    (``valid`` has an entry for each of the ``len(data) - MATCH + 1`` windows)."""
    chosen = np.zeros(len(data), bool)
    for s in range(0, len(valid), TILE):
        ok = valid[s:s + TILE]
        if not ok.any():
            continue
        n = len(ok)
        tile = data[s:s + n + MATCH - 1]
        grams = n + MATCH - MINIMISER
        eight = np.ndarray((grams,), "<u8", tile.tobytes(), strides=(1,))
        h = (eight ^ (tile[8:8 + grams].astype(np.uint64) << np.uint64(55))) * _M1
        h ^= h >> np.uint64(31)
        h *= _M2
        h &= ~_POSITION
        h |= np.arange(grams, dtype=np.uint64)
        span = 1
        while 2 * span <= MATCH - MINIMISER + 1:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        rest = MATCH - MINIMISER + 1 - span
        if rest:
            h = np.minimum(h[:-rest], h[rest:])
        start = np.arange(n, dtype=np.int64)
        at = (h & _POSITION).astype(np.int64) - start
        for _ in range((MATCH - MINIMISER) // CHOICES):
            at -= CHOICES * (at >= CHOICES)
        chosen[(s + start + at)[ok]] = True
    return np.flatnonzero(chosen)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    h = np.full(n, 0x243F6A8885A308D3, np.uint64)
    for column in padded.view("<u8").T:
        h = (h ^ column) * _M1
        h ^= h >> np.uint64(29)
        h *= _M2
        h ^= h >> np.uint64(32)
    return h


def merged_spans(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching spans of the same document as one."""
    if not len(doc):
        return doc, key, start, end
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    group = np.cumsum(new_doc) - 1
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step) - group * step
    new = new_doc.copy()
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], key[first], start[first], reach[last]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed cell; ``_unpack`` knows their types."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8").tobytes()
    body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(cell: bytes) -> list[bytes]:
    body = zstandard.ZstdDecompressor().decompress(cell)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    sizes = np.frombuffer(body, "<i8", n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for size in sizes:
        out.append(body[at:at + size])
        at += size
    return out


class Block:
    """The documents of a block in order of id and text, and their anchors."""

    def __init__(self, table: pa.Table, buckets: int):
        ids, cells = table["doc_id"].to_pylist(), table["text"].to_pylist()
        texts = [c or b"" for c in cells]
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.doc = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        gap = bytes(LEFT)
        joined = gap + b"".join(t.translate(_PLUS) + gap for t in self.texts) + bytes(WIDTH)
        self.data = np.frombuffer(joined, np.uint8)
        self.buckets = buckets

    def find_anchors(self) -> None:
        """``at`` and ``row`` of every anchor; ``codes``, the different (bucket,
        32-bit) codes, and ``code_of`` the anchors."""
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.begin = LEFT + np.concatenate(([0], np.cumsum(sizes + LEFT)[:-1]))
        windows = len(self.data) - MATCH + 1
        edge = np.zeros(windows + 1, np.int8)
        long = sizes >= MATCH
        edge[self.begin[long]] += 1
        edge[(self.begin + sizes - MATCH + 1)[long]] -= 1
        self.at = anchors(self.data, np.cumsum(edge[:windows], dtype=np.int8).astype(bool))
        self.row = np.searchsorted(self.begin, self.at, side="right") - 1
        view = np.lib.stride_tricks.sliding_window_view(self.data, ANCHOR)
        code = np.empty(len(self.at), np.uint64)
        for s in range(0, len(self.at), CHUNK_ANCHORS):
            h = _hash_rows(view[self.at[s:s + CHUNK_ANCHORS]])
            bucket = (h & np.uint64(0xFFFFFFFF)) % np.uint64(self.buckets)
            code[s:s + CHUNK_ANCHORS] = bucket << np.uint64(32) | h >> np.uint64(32)
        self.codes, self.code_of = np.unique(code, return_inverse=True)

    def bucket_slices(self) -> list[tuple[int, int, int]]:
        """(bucket, first, end) of ``codes``."""
        bucket = (self.codes >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist()))

    def several_documents(self) -> np.ndarray:
        """Which codes occur in documents of different ids here."""
        order = np.argsort(self.code_of, kind="stable")  # rows, and so ids, ascend within
        first = np.flatnonzero(np.diff(self.code_of[order], prepend=-1))
        last = np.append(first[1:], len(order)) - 1
        doc = self.doc[self.row[order]]
        return doc[first] != doc[last]


_CODES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("cell", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _send_codes(table: pa.Table, buckets: int) -> pa.Table:
    block = Block(table, buckets)
    block.find_anchors()
    number = table["block"][0].as_py()
    times = np.minimum(np.bincount(block.code_of, minlength=len(block.codes)), 65535).astype(np.uint16)
    return _table([(b, number, _pack(block.codes[i:j].astype(np.uint32), times[i:j]))
                   for b, i, j in block.bucket_slices()], _CODES)


def _shared_codes(table: pa.Table) -> pa.Table:
    """For each block, two bits for each of its codes: whether another block has
    it, and whether it occurs more than ``HOT`` times."""
    cells = [_unpack(c.as_py()) for c in table["cell"]]
    codes = [np.frombuffer(c, np.uint32) for c, _ in cells]
    counts = np.concatenate([np.frombuffer(n, np.uint16) for _, n in cells])
    _, which, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    shared, hot = times[which] > 1, (np.bincount(which, weights=counts) > HOT)[which]
    rows, at = [], 0
    for bucket, block, c in zip(table["bucket"].to_pylist(), table["block"].to_pylist(), codes):
        own, often = shared[at:at + len(c)], hot[at:at + len(c)]
        at += len(c)
        if own.any() or often.any():
            rows.append((bucket, block, np.packbits(own).tobytes() + np.packbits(often).tobytes()))
    return _table(rows, _CODES)


_DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("spans", pa.bool_()), ("cell", pa.binary())])


def _deal(number: int, bucket: np.ndarray, context: np.ndarray, doc: np.ndarray, of: np.ndarray,
          row: np.ndarray, pos: np.ndarray, last: np.ndarray) -> list[tuple]:
    """Cells of contexts by bucket; stretch k lies in ``row`` and has context
    ``of`` at every position from ``pos`` to ``last`` or within ``MATCH`` of the
    one before."""
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    to = place[of]
    stretch = np.argsort(to, kind="stable")
    to, bucket = to[stretch], bucket[by]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    end = np.append(first[1:], len(by))
    out = []
    for i, j, a, b in zip(first.tolist(), end.tolist(), np.searchsorted(to, first).tolist(),
                          np.searchsorted(to, end).tolist()):
        some, which = by[i:j], stretch[a:b]
        out.append((int(bucket[i]), number, False, _pack(
            context[some], doc[some], (to[a:b] - i).astype(np.uint32), row[which].astype(np.uint32),
            pos[which].astype(np.uint32), last[which].astype(np.uint32))))
    return out


def _windows_apart(context: np.ndarray, doc: np.ndarray, of: np.ndarray, row: np.ndarray, pos: np.ndarray,
                   last: np.ndarray):
    """The different windows of contexts, as contexts that begin with them,
    with their hashes, documents and stretches; and the spans (row, start, end)
    of windows that a smaller document here has too."""
    left, right = _sides(context)
    offsets = np.arange(CHOICES)
    r, o = np.nonzero((offsets <= left[:, None]) & (MATCH - offsets <= right[:, None]))
    window = np.zeros((len(r), WIDTH), np.uint8)
    window[:, LEFT:] = np.lib.stride_tricks.sliding_window_view(context, MATCH, axis=1)[r, LEFT - o]
    h = _hash_rows(window)
    order = np.lexsort((doc[r], h))
    head = np.diff(h[order], prepend=h[order][:1] + np.uint64(1)) != 0
    name = np.empty(len(r), np.int64)
    name[order] = np.cumsum(head) - 1
    first = order[head]
    least = doc[r][first]
    # every stretch of a context is one of each of its windows
    times = np.bincount(r, minlength=len(context))
    begin = np.cumsum(times) - times
    each = np.repeat(np.arange(len(of)), times[of])
    at = begin[of][each] + np.arange(len(each)) - np.repeat(np.cumsum(times[of]) - times[of], times[of])
    start, end, row = pos[each] - o[at], last[each] - o[at] + MATCH, row[each]
    late = doc[r][at] > least[name[at]]
    of, own_row, start_own, end_own = merged_spans(name[at][~late], row[~late], start[~late], end[~late])
    return (window[first], h[first], least, of, own_row, start_own, end_own - MATCH,
            (row[late], start[late], end[late]))


def _send_contexts(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """Contexts for the buckets, and spans known already."""
    if not table.num_rows:
        return _table([], _DEALT)
    block = Block(table, buckets)
    block.find_anchors()
    number = table["block"][0].as_py()
    wanted, hot = block.several_documents(), np.zeros(len(block.codes), bool)
    cells = dict(zip(replies["bucket"].to_pylist(), replies["cell"].to_pylist()))
    for b, i, j in block.bucket_slices():
        if b in cells:
            bits, size = np.frombuffer(cells[b], np.uint8), -(-(j - i) // 8)
            wanted[i:j] |= np.unpackbits(bits[:size], count=j - i).astype(bool)
            hot[i:j] = np.unpackbits(bits[size:], count=j - i).astype(bool)
    chosen = np.flatnonzero(wanted[block.code_of])
    view = np.lib.stride_tricks.sliding_window_view(block.data, WIDTH)
    out = []

    def known(row, start, end):
        if len(row):
            _, key, start, end = merged_spans(row, row, start, end)
            out.append((number % buckets, number, True, _pack(key, start, end)))

    for s in range(0, len(chosen), CHUNK_ANCHORS):
        some = chosen[s:s + CHUNK_ANCHORS]
        at, row = block.at[some], block.row[some]
        context, doc = view[at - LEFT], block.doc[row]
        pos = at - block.begin[row]
        h = _hash_rows(context)
        order = np.argsort(h, kind="stable")  # rows, and so ids, ascend within, and positions
        head = np.diff(h[order], prepend=h[order][:1] + np.uint64(1)) != 0
        group, one = np.cumsum(head) - 1, order[head]
        late = doc[order] > doc[one][group]
        later, own, of = order[late], order[~late], group[~late]
        left, right = _sides(context[later])
        known(row[later], pos[later] - left, pos[later] + right)
        new = np.ones(len(own), bool)
        new[1:] = (of[1:] != of[:-1]) | (row[own][1:] != row[own][:-1]) | (np.diff(pos[own]) > MATCH)
        first = np.flatnonzero(new)
        of, rows, last = of[first], row[own[first]], pos[own[np.append(first[1:], len(own)) - 1]]
        pos = pos[own[first]]
        code = block.code_of[some[one]]
        often = hot[code]
        bucket = (block.codes[code] >> np.uint64(32)).astype(np.int64)
        for apart, groups in [(False, np.flatnonzero(~often))] + [
                (True, part) for part in np.split(np.flatnonzero(often), range(
                    HOT_AT_ONCE, np.count_nonzero(often), HOT_AT_ONCE))]:
            if not len(groups):
                continue
            place = np.full(len(one), -1, np.int64)
            place[groups] = np.arange(len(groups))
            here = np.flatnonzero(place[of] >= 0)
            given = (context[one[groups]], doc[one[groups]], place[of[here]], rows[here], pos[here], last[here])
            if apart:
                window, name, least, *stretches, spans = _windows_apart(*given)
                known(*spans)
                out += _deal(number, (name % np.uint64(buckets)).astype(np.int64), window, least, *stretches)
            else:
                out += _deal(number, bucket[groups], *given)
    return _table(out, _DEALT)


def _sides(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the document before the anchor, and from it on."""
    return np.count_nonzero(context[:, :LEFT], axis=1), np.count_nonzero(context[:, LEFT:], axis=1)


class SuffixLevels:
    """Suffix arrays (cut off at ``MATCH`` bytes) with the least document of
    each string, level k holding about ``batch * 2**k`` suffixes.  Batches must
    come in document order."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray] | None] = []

    @staticmethod
    def _array(suffixes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(suffixes, kind="stable")
        suffixes, docs = suffixes[order], docs[order]
        head = np.ones(len(suffixes), bool)
        head[1:] = suffixes[1:] != suffixes[:-1]
        return suffixes[head], np.minimum.reduceat(docs, np.flatnonzero(head))

    def add(self, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which of the batch's suffixes start in a smaller document; the batch
        enters the family."""
        array = self._array(suffixes, docs)
        least = array[1].copy()
        for level in filter(None, self.levels):
            at = np.searchsorted(level[0], array[0])
            at[at == len(level[0])] = 0
            found = level[0][at] == array[0]
            least[found] = np.minimum(least[found], level[1][at[found]])
        repeated = least[np.searchsorted(array[0], suffixes)] < docs
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            other, self.levels[k] = self.levels[k], None
            array = self._array(np.concatenate((other[0], array[0])),
                                np.concatenate((other[1], array[1])))
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = array
        return repeated


def bucket_spans(context: np.ndarray, doc: np.ndarray, of: np.ndarray, key: np.ndarray, pos: np.ndarray,
                 last: np.ndarray, batch: int = 4096):
    """Spans to remove that the contexts of one bucket show; stretches (``of``,
    ``key``, ``pos``, ``last``) as in ``_deal``."""
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    if not len(doc):
        return none
    # anchors that only one document has can't repeat
    anchor = _hash_rows(context[:, LEFT:LEFT + ANCHOR])
    order = np.lexsort((doc, anchor))
    anchor = anchor[order]
    head = np.ones(len(order), bool)
    head[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(head)
    final = np.append(first[1:], len(order)) - 1
    shared = (doc[order[first]] != doc[order[final]])[np.cumsum(head) - 1]
    rows = order[shared]
    if not len(rows):
        return none
    place = np.full(len(doc), -1, np.int64)
    place[rows] = np.arange(len(rows))
    here = place[of] >= 0
    of, key, pos, last = place[of[here]], key[here], pos[here].astype(np.int64), last[here].astype(np.int64)
    context, doc = context[rows], doc[rows]
    left, right = _sides(context)
    # of equal contexts, those after the least document are covered whole
    same, which = np.unique(_hash_rows(context), return_inverse=True)
    least = np.full(len(same), NO_ID, np.int64)
    np.minimum.at(least, which, doc)
    later = doc > least[which]
    covered = later[of]
    whole = of[covered]
    spans = [(doc[whole], key[covered], pos[covered] - left[whole], last[covered] + right[whole])]
    # the windows of each different context, once, in document order; an anchor
    # with one context has no window elsewhere
    own = np.flatnonzero(~later)
    _, one = np.unique(which[own], return_index=True)
    one = own[one]
    _, name, contexts = np.unique(anchor[shared][one], return_inverse=True, return_counts=True)
    one = one[contexts[name] > 1]
    one = one[np.argsort(doc[one], kind="stable")]
    family, repeated = SuffixLevels(), np.zeros((len(same), CHOICES), bool)
    offsets = np.arange(CHOICES)
    step = max(1, batch // CHOICES)
    for s in range(0, len(one), step):
        some = one[s:s + step]
        r, o = np.nonzero((offsets <= left[some][:, None]) & (MATCH - offsets <= right[some][:, None]))
        windows = np.lib.stride_tricks.sliding_window_view(context[some], MATCH, axis=1)[r, LEFT - o]
        suffixes = np.ascontiguousarray(windows).view(f"S{MATCH}").ravel()
        hit = family.add(suffixes, doc[some][r])
        repeated[which[some][r[hit]], o[hit]] = True
    rest = np.flatnonzero(~covered)
    r, o = np.nonzero(repeated[which[of[rest]]])
    r = rest[r]
    spans.append((doc[of[r]], key[r], pos[r] - o, last[r] - o + MATCH))
    return merged_spans(*(np.concatenate(c) for c in zip(*spans)))


_SPANS = pa.schema([("block", pa.int64()), ("cell", pa.binary())])


def _bucket(table: pa.Table) -> pa.Table:
    """Per block, the (row, start, end) spans that a bucket finds."""
    rows, found, numbers, n = [], [], [], 0
    for block, is_spans, cell in zip(table["block"].to_pylist(), table["spans"].to_pylist(), table["cell"]):
        if is_spans:
            rows.append((block, cell.as_py()))
            continue
        context, doc, of, key, pos, last = _unpack(cell.as_py())
        key = np.frombuffer(key, np.uint32).astype(np.int64) | len(numbers) << 32
        numbers.append(block)
        found.append((np.frombuffer(context, np.uint8).reshape(-1, WIDTH), np.frombuffer(doc, np.int64),
                      np.frombuffer(of, np.uint32).astype(np.int64) + n, key, np.frombuffer(pos, np.uint32),
                      np.frombuffer(last, np.uint32)))
        n += len(found[-1][1])
    if found:
        _, key, start, end = bucket_spans(*(np.concatenate(c) for c in zip(*found)))
        order = np.argsort(key, kind="stable")
        key, start, end = key[order], start[order], end[order]
        for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key >> 32)) + 1):
            if len(part):
                rows.append((numbers[int(key[part[0]] >> 32)],
                             _pack(key[part] & 0xFFFFFFFF, start[part], end[part])))
    return _table(rows, _SPANS)


_CLEAN = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                    ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(table: pa.Table, spans: pa.Table) -> pa.Table:
    block = Block(table, 1)
    cells = [[np.frombuffer(x, np.int64) for x in _unpack(c.as_py())] for c in spans["cell"]]
    by_row: dict[int, list[tuple[int, int]]] = {}
    if cells:
        row, start, end = (np.concatenate(c) for c in zip(*cells))
        row, _, start, end = merged_spans(row, row, start, end)
        for r, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
            by_row.setdefault(r, []).append((a, b))
    rows = []
    for r, (doc_id, raw) in enumerate(zip(block.ids, block.texts)):
        cuts = by_row.get(r, [])
        ends = [0, *(b for _, b in cuts)]
        starts = [*(a for a, _ in cuts), len(raw)]
        kept = b"".join(raw[a:b] for a, b in zip(ends, starts))
        rows.append((doc_id, len(raw), len(raw) - len(kept), len(cuts), kept))
    return _table(rows, _CLEAN)


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """Blocks of about ``block_bytes`` of text, and at least one per shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))


def without_repeats(docs: DataFrame, *, buckets: int | None = None, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes ``kept`` of each
    document.  ``buckets``: how many blocks, and how many index families
    (default: counted from the texts, so that a block has about ``block_bytes``
    at most, whatever the session's shuffle partitions are); a task holds one at
    a time, in about ten times its bytes."""
    if buckets is None:
        buckets = block_count(docs, block_bytes)
    text = F.col("text").cast("binary")
    blocks = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                         F.pmod(F.xxhash64("doc_id", F.xxhash64(text)), F.lit(buckets)).alias("block"))
    by_block = blocks.groupBy("block")
    codes = by_block.applyInArrow(lambda t: _send_codes(t, buckets), "bucket int, block bigint, cell binary")
    replies = codes.groupBy("bucket").applyInArrow(_shared_codes, "bucket int, block bigint, cell binary")
    dealt = by_block.cogroup(replies.groupBy("block")).applyInArrow(
        lambda t, r: _send_contexts(t, r, buckets), "bucket int, block bigint, spans boolean, cell binary")
    spans = dealt.groupBy("bucket").applyInArrow(_bucket, "block bigint, cell binary")
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans",
                          F.sha2("kept", 256).alias("kept_sha256"))
