"""Byte-pair encoding and decoding by batched merge rounds in numpy.

A text is split into words by the vocabulary's pattern (special tokens first,
these stay whole).  The different words of a batch that haven't been met yet lie
as byte symbols in one flat array.  A round looks up all neighbouring pairs at
once, by binary search over the sorted pair keys of the vocabulary, finds the
lowest rank within each word and merges every occurrence of that pair; words
without a known pair leave the array.  The ids of all words then form one flat
table, from which a text's ids are gathered.

Merging all occurrences of a pair at once is exact since every merge is listed
after those that make its parts (checked when a vocabulary is loaded): a symbol
that a merge makes can only take part in later ones.  Words of more than
``LONG_WORD`` bytes go through rounds over ranks instead of over the array
(ranks ascending, each with the places where its pair stands), so that a long
run without spaces takes n log n steps; the ids are the same.

A task holds a batch of text of bounded size (a longer text is cut only where
its words end), the ids of one text, and the met words up to ``KEEP_BYTES``.
Nothing is shuffled.

Edge cases: a null text is empty and has no ids; empty texts too; repeated rows
get equal results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import FLUSH, as_batch
from tabprobe.llm.tokens import vocabulary_path

#: words of more bytes are merged rank by rank
LONG_WORD = 256
#: characters that are split into words at once
SPLIT_CHARS = 1 << 20
#: words of a batch
BATCH_WORDS = 1 << 18
#: bytes of met words after which a task forgets them
KEEP_BYTES = 16 << 20
_NONE = np.iinfo(np.int64).max
_SHIFT = 32

# fixed values: how a byte-level vocabulary splits texts into words
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: one space between other characters ends a word and begins the next
_CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
_NOT_LATIN = re.compile("[^\x00-˿]")


def byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: printable
    ones stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Code points without a class in Python's tables: libraries of different
    Unicode versions may split at them differently."""
    runs: list[list[int]] = []
    for cp in range(0x300, sys.maxunicode + 1):
        if unicodedata.category(chr(cp)) == "Cn":
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]")


class Vocabulary:
    """A byte-level vocabulary: pair keys in order with rank and result, the
    bytes of each id, and its special tokens."""

    def __init__(self, name: str):
        import regex

        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) \
                or spec["normalizer"] or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{name}: only plain byte-level vocabularies are supported")
        self.words = regex.compile(WORDS)
        letters = byte_letters()
        ids = model["vocab"]
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs))
        latest = np.full(max(ids.values()) + 1, -1, np.int64)
        np.maximum.at(latest, made, rank)
        if (np.maximum(latest[left], latest[right]) >= rank).any():
            raise ValueError(f"{name}: a merge is listed before one that makes its parts")
        key = left << _SHIFT | right
        self.rank = np.argsort(key, kind="stable")
        self.keys = key[self.rank]
        self.made = made
        self.pair_of_rank = key
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"{name}: added token {t['content']!r} with options")
            self.special[t["content"]] = t["id"]
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        to_byte = {c: b for b, c in enumerate(letters)}
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in ids.items()}
        tokens |= {i: t.encode() for t, i in self.special.items()}
        size = max(tokens) + 1
        self.token_length = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self._exact_split = None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, by binary search over the sorted keys."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def split(self, text: str) -> Iterator[list[str]]:
        """Lists of words of a text without special tokens."""
        if _NOT_LATIN.search(text) and _unassigned().search(text):
            yield self._split_by_library(text)
            return
        a = 0
        while len(text) - a > SPLIT_CHARS:
            cut = _CUT.search(text, a + SPLIT_CHARS)
            if cut is None:
                break
            yield self.words.findall(text, a, cut.start())
            a = cut.start()
        yield self.words.findall(text, a)

    def _split_by_library(self, text: str) -> list[str]:
        if self._exact_split is None:
            from tokenizers import pre_tokenizers

            self._exact_split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._exact_split.pre_tokenize_str(text)]


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


def gathered(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the runs (start, length), one after another."""
    total = int(length.sum())
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(total)


def _every_second(follows: np.ndarray) -> np.ndarray:
    """For places in order, where ``follows`` tells that a place overlaps the one
    before: the first, third, fifth ... of each chain of overlapping places."""
    at = np.arange(len(follows))
    chain = np.maximum.accumulate(np.where(follows, 0, at))
    return (at - chain) % 2 == 0


def merge_rounds(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words: ``symbols`` of all words in a row, ``lengths`` of each
    word (1 or more).  Returns ids in a row and the new lengths."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    ready: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        rank = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = v.ranks(symbols[inside], symbols[inside + 1])
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(word)]))
        going = least != _NONE
        if not going.all():
            ready.append((symbols[~going], word[~going]))
            symbols, word, rank, least = symbols[going], word[going], rank[going], least[going]
        at = np.flatnonzero(rank == least) if len(symbols) else np.empty(0, np.int64)
        if not len(at):
            continue
        at = at[_every_second(np.r_[False, np.diff(at) == 1])]
        symbols = symbols.copy()
        symbols[at] = v.made[rank[at]]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, word = symbols[stay], word[stay]
    ids = np.concatenate([s for s, _ in ready]) if ready else np.empty(0, np.int64)
    word = np.concatenate([w for _, w in ready]) if ready else np.empty(0, np.int64)
    return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(lengths))


def merge_by_rank(v: Vocabulary, symbols: np.ndarray) -> np.ndarray:
    """Ids of one long word: ranks ascending, all places of a rank at once."""
    n = len(symbols)
    symbol = np.r_[symbols, -1]  # a place after the end
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    places: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def add(at: np.ndarray) -> None:
        """Note the pairs that begin at these places."""
        right = symbol[after[at]]
        at, right = at[right >= 0], right[right >= 0]
        rank = v.ranks(symbol[at], right)
        at, rank = at[rank != _NONE], rank[rank != _NONE]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else (), np.split(at, cuts)):
            if r not in places:
                places[r] = []
                heapq.heappush(waiting, r)
            places[r].append(part)

    add(np.arange(n))
    while waiting:
        r = heapq.heappop(waiting)
        found = places.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        left, right = divmod(int(v.pair_of_rank[r]), 1 << _SHIFT)
        at = at[symbol[at] == left]
        at = at[symbol[after[at]] == right]
        if not len(at):
            continue
        at = at[_every_second(np.r_[False, after[at[:-1]] == at[1:]])]
        gone = after[at]
        symbol[at], symbol[gone] = v.made[r], -1
        after[at] = after[gone]
        before[after[at]] = at
        back = before[at]
        add(np.unique(np.r_[at, back[back >= 0]]))
    return symbol[symbol >= 0]


class Encoder:
    """Ids of texts; keeps the ids of words already met in one flat table."""

    def __init__(self, name: str):
        self.v = vocabulary(name)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.held = 0

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words into the table."""
        data = [w.encode() for w in words]
        size = np.array([len(d) for d in data], np.int64)
        symbols = self.v.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        long = size > LONG_WORD
        per_symbol = np.repeat(long, size)
        ids, length = merge_rounds(self.v, symbols[~per_symbol], size[~long])
        lengths = np.zeros(len(words), np.int64)
        lengths[~long] = length
        begin = np.cumsum(size) - size
        parts = [merge_by_rank(self.v, symbols[begin[k]:begin[k] + size[k]]) for k in np.flatnonzero(long)]
        lengths[long] = [len(p) for p in parts]
        start = np.zeros(len(words), np.int64)
        start[~long] = np.cumsum(length) - length
        start[long] = len(ids) + np.cumsum(lengths[long]) - lengths[long]
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids, *parts])
        self.start, self.length = np.r_[self.start, start + base], np.r_[self.length, lengths]
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words))))
        self.held += int(size.sum()) + 64 * len(words)

    def _pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens."""
        a = 0
        if self.v.special_pattern is not None:
            for m in self.v.special_pattern.finditer(text):
                if m.start() > a:
                    yield from self.v.split(text[a:m.start()])
                yield self.v.special[m[0]]
                a = m.end()
        if a < len(text):
            yield from self.v.split(text[a:])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (unsigned 32 bits)."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        batch: list[tuple[int, list[str] | int]] = []
        size = 0

        def flush():
            if self.held > KEEP_BYTES:
                self._forget()
            new = set()
            for _, piece in batch:
                if not isinstance(piece, int):
                    new.update(piece)
            fresh = list(new.difference(self.known))
            if fresh:
                self._learn(fresh)
            get = self.known.__getitem__
            for k, piece in batch:
                if isinstance(piece, int):
                    out[k].append(np.array([piece], np.uint32))
                else:
                    at = np.fromiter(map(get, piece), np.int64, len(piece))
                    out[k].append(self.ids[gathered(self.start[at], self.length[at])].astype(np.uint32))
            batch.clear()

        for k, text in enumerate(texts):
            for piece in self._pieces(text or ""):
                batch.append((k, piece))
                size += 1 if isinstance(piece, int) else len(piece)
                if size > BATCH_WORDS:
                    flush()
                    size = 0
        flush()
        return [np.concatenate(p) if p else np.empty(0, np.uint32) for p in out]


def decode(v: Vocabulary, ids: np.ndarray) -> str:
    """Text of the ids; ids that the vocabulary doesn't have count as empty, and
    bytes that are no UTF-8 become U+FFFD."""
    ids = ids[ids < len(v.token_length)].astype(np.int64)
    out = v.token_bytes[gathered(v.token_start[ids], v.token_length[ids])]
    return out.tobytes().decode("utf-8", errors="replace")


_IDS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_TEXT = pa.schema([*_IDS, ("text", pa.string())])


def encoded(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens and ids (unsigned little-endian 32-bit integers) of every
    document.  ``tokenizer``: a path, or the name of an installed vocabulary."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)

        def done(held):
            ids = encoder.encode([t for _, t in held])
            return as_batch([(d, len(x), x.astype("<u4").tobytes()) for (d, _), x in zip(held, ids)], _IDS)

        held, size = [], 0
        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                held.append((d.as_py(), t.as_py()))
                size += len(held[-1][1] or "")
                if size > FLUSH:
                    yield done(held)
                    held, size = [], 0
        if held:
            yield done(held)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        rows, "doc_id bigint, n_tokens bigint, ids binary")


def decoded(found: DataFrame, *, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``found`` (rows of ``encoded``) with ``text``, decoded from the ids alone;
    special tokens are kept."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(tokenizer)
        held, size = [], 0
        for batch in batches:
            for d, n, ids in zip(*batch.columns):
                ids = ids.as_py()
                held.append((d.as_py(), n.as_py(), ids, decode(v, np.frombuffer(ids or b"", "<u4"))))
                size += 2 * len(ids or b"")
                if size > FLUSH:
                    yield as_batch(held, _TEXT)
                    held, size = [], 0
        if held:
            yield as_batch(held, _TEXT)

    return found.select("doc_id", "n_tokens", "ids").mapInArrow(
        rows, "doc_id bigint, n_tokens bigint, ids binary, text string")


def digest(found: DataFrame) -> DataFrame:
    """Rows of ``decoded`` with hashes in place of ids and texts."""
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("text", 256).alias("decoded_sha256"))
