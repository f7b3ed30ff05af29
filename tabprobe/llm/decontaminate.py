"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Texts and test items become lower-case words.

1. A pass over the documents finds where three words in a row are also in a test
   item, and keeps the passages around these places.  A three-gram of more than
   ``common_items`` items ("which of the following") tells little; there the seed
   is the run of 8 words from it, then of 16, 32 and 64 (or the whole item, if
   that is shorter), until few items have it.
2. The seeds join the items by equality, and how many passages hold each seed is
   counted over all documents.  Of the seeds that a passage shares with an item,
   the rarer half by that count (ties included) say where the item may lie in the
   passage.  Rarity is judged within the passage and item, so verbatim copies of
   an item never hide an edited one, and every passage that shares a seed with an
   item is aligned with it.
3. Smith-Waterman on words (match 1, mismatch and gap -1) aligns item and passage,
   unless they have too few words in common for the least score at all (a score is
   at most the number of matched words); the score over the item's length is the
   share of the item that the passage repeats, edits counted against it.

A document pairs with at most ``common_items`` items for each shared place, or with
all that share 64 words or the whole of an item.  A copy is lost if none of its
three-grams is kept, or if all that are kept are common and edited within the words
that make them rare.

Test items are handled in blocks of ``block_words`` words; a block's words and
seeds are sent to all tasks and compared with all documents, so a test set of any
size takes bounded memory.

Edge cases: null and empty texts and items never match; items shorter than the
n-gram are found whole; repeated document rows and equal ids give one row per
(doc_id, item_id), its best; rows without an id are reported under a null id;
empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import FLUSH, as_batch, free_name, text_key, written

WORD = re.compile(r"[^\W_]+")
GRAM = 3
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """Key of each run of n word ids; 0 where a word is unknown (-1)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    h, known = np.zeros(len(ids) - n + 1, np.uint64), np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        part = ids[k:len(ids) - n + 1 + k]
        h = (h ^ (part + 1).astype(np.uint64)) * _P
        h ^= h >> np.uint64(31)
        known &= part >= 0
    return np.where(known, np.maximum(h, np.uint64(1)), np.uint64(0))


#: a seed's length where shorter runs are common, up to the last, which is never too common
LONGER = (8, 16, 32, 64)


class Items:
    """A block of test items: word ids, and the seeds of each."""

    def __init__(self, rows: list[tuple[int, str]], common_items: int = 64):
        self.vocabulary: dict[str, int] = {}
        self.item_ids, self.items = [], []
        for item_id, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                self.item_ids.append(item_id)
                self.items.append(np.array(ids, np.int64))
        self.counts = [np.unique(x, return_counts=True) for x in self.items]
        self.longest = max(map(len, self.items), default=0)
        #: by seed length: sorted keys of the seeds; and of those that longer seeds replace
        self.keys: dict[int, np.ndarray] = {}
        self.common: dict[int, np.ndarray] = {}
        seeds: list[np.ndarray] = []
        todo = {}
        for i, ids in enumerate(self.items):
            n = min(GRAM, len(ids))
            todo.setdefault(n, []).append((i, np.arange(len(ids) - n + 1)))
        while todo:
            n = min(todo)
            rows = [(gram_keys(self.items[i], n)[at], np.full(len(at), i), at) for i, at in todo.pop(n)]
            key, item, at = (np.concatenate(c) for c in zip(*rows))
            distinct, which = np.unique(key, return_inverse=True)
            pairs = np.unique(np.stack([which, item]), axis=1)
            often = np.bincount(pairs[0], minlength=len(distinct)) > common_items
            # the next length, or the whole item if that is shorter; 0: none is longer
            sizes = np.array([len(x) for x in self.items])
            longer = np.minimum(next((m for m in LONGER if m > n), 0), sizes)
            goes_on = often[which] & (longer[item] > n)
            stays = ~goes_on
            self.keys[n] = np.union1d(self.keys.get(n, np.empty(0, np.uint64)), key[stays])
            self.common[n] = np.union1d(self.common.get(n, np.empty(0, np.uint64)), key[goes_on])
            seeds.append(np.stack([key[stays].view(np.int64), np.full(stays.sum(), n), item[stays], at[stays]]))
            order = np.flatnonzero(goes_on)
            order = order[np.argsort(item[order], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else ():
                i = int(item[part[0]])
                m = int(longer[i])
                places = at[part][at[part] + m <= len(self.items[i])]
                if len(places):
                    todo.setdefault(m, []).append((i, places))
        #: key, length, item, place in the item
        self.seeds = np.concatenate(seeds, axis=1) if seeds else np.empty((4, 0), np.int64)

    def common_words(self, i: int, passage: np.ndarray) -> int:
        """How many words item and passage share (repeated words as often as
        both have them): at least the score of any alignment."""
        names, times = self.counts[i]
        at = np.searchsorted(names, passage)
        at[at == len(names)] = 0
        here = np.bincount(at[names[at] == passage], minlength=len(names))
        return int(np.minimum(times, here).sum())

    def found(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of a text; place, length and key of the seeds in it."""
        split = words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in split), np.int64, len(split))
        at, length, keys = [], [], []
        common = np.empty(0, np.int64)  # where longer seeds may begin
        for n in sorted(self.keys):
            if n <= GRAM:
                key = gram_keys(ids, n)
                places = np.flatnonzero(key)
                key = key[places]
            else:
                places = common[common + n <= len(ids)]
                key = _keys_at(ids, places, n)
            hit = _member(self.keys[n], key)
            at.append(places[hit]), keys.append(key[hit]), length.append(np.full(hit.sum(), n))
            if n == GRAM:
                common = places[_member(self.common[n], key)]
        return (ids, *(np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, length, keys)))


def _member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys


def _keys_at(ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """``gram_keys`` at some places."""
    h, known = np.zeros(len(places), np.uint64), np.ones(len(places), bool)
    for k in range(n):
        part = ids[places + k]
        h = (h ^ (part + 1).astype(np.uint64)) * _P
        h ^= h >> np.uint64(31)
        known &= part >= 0
    return np.where(known, np.maximum(h, np.uint64(1)), np.uint64(0))


_PASSAGE = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("first", pa.int64()), ("ids", pa.binary()),
                      ("seeds", pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])))])


def _passages(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """The passages of the documents that hold a seed.  Passages are so far apart that
    no alignment reaches from one into another."""
    reach = 2 * items.longest + 4

    def cut(doc_id, doc, text):
        ids, at, length, keys = items.found(text)
        order = np.argsort(at, kind="stable")
        at, length, keys = at[order], length[order], keys.astype(np.uint64)[order].view(np.int64)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * reach) + 1):
            if len(part):
                a = max(0, int(at[part[0]]) - reach)
                b = min(len(ids), int(at[part[-1]] + length[part[-1]]) + reach)
                yield (doc_id, doc, a, ids[a:b].astype("<i4").tobytes(),
                       [{"key": k, "n": n, "at": p - a} for k, n, p in
                        zip(keys[part].tolist(), length[part].tolist(), at[part].tolist())])

    held, size = [], 0
    for batch in batches:
        for cells in zip(*batch.columns):
            for row in cut(*(c.as_py() for c in cells)):
                held.append(row)
                size += len(row[3]) + 32 * len(row[4])
            if size > FLUSH:
                yield as_batch(held, _PASSAGE)
                held, size = [], 0
    if held:
        yield as_batch(held, _PASSAGE)


def windows(length: int, words_in_passage: int, hits: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where an item of ``length`` words may lie in a passage: around the rarer half of
    the ``hits`` (count, place in the passage, place in the item), ties included.  Long
    windows are cut with an overlap of twice the item, which no alignment exceeds."""
    counts = sorted(c for c, _, _ in hits)
    rare = counts[(len(counts) - 1) // 2]
    slack = length // 2 + 2  # room for inserted words on either side
    spans = sorted((max(0, at - place - slack), min(words_in_passage, at - place + length + slack))
                   for c, at, place in hits if c <= rare)
    merged = [list(spans[0])]
    for a, b in spans[1:]:
        if a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, most = [], 8 * length + 64
    for a, b in merged:
        while b - a > most:
            out.append((a, a + most))
            a += most - 2 * length - 2
        out.append((a, b))
    return out


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Smith-Waterman of (item, passage) pairs at once: best score and the
    passage word after its end."""
    if not pairs:
        return []
    rows, cols = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    item = np.full((len(pairs), rows), -2, np.int64)
    passage = np.full((len(pairs), cols), -1, np.int64)
    for k, (a, b) in enumerate(pairs):
        item[k, :len(a)], passage[k, :len(b)] = a, b
    ramp = np.arange(cols + 1, dtype=np.int32)
    above = np.zeros((len(pairs), cols + 1), np.int32)
    best = np.zeros((len(pairs), cols + 1), np.int32)
    for r in range(rows):
        now = np.zeros_like(above)
        score = np.where(item[:, r:r + 1] == passage, 1, -1)
        now[:, 1:] = np.maximum(np.maximum(above[:, :-1] + score, above[:, 1:] - 1), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps along the passage
        above = now
        np.maximum(best, now, out=best)
    end = best.argmax(axis=1)
    return list(zip(best[np.arange(len(pairs)), end].tolist(), end.tolist()))


_FOUND = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("item_id", pa.int64()),
                    ("score", pa.int64()), ("share", pa.float64()), ("end_word", pa.int64())])
#: contaminated documents whose keys are broadcast
BROADCAST_HITS = 1 << 20
#: passages, and words of them, that are aligned at once
AT_ONCE, WORDS_AT_ONCE = 256, 1 << 20


def _score(batches: Iterator[pa.RecordBatch], items: Items, min_share: float,
           min_score: int) -> Iterator[pa.RecordBatch]:
    """The rows of every passage that scores enough with an item it shares seeds with."""
    def enough(i, score):
        size = len(items.items[i])
        return score / size >= min_share and score >= min(min_score, size)

    def scored(held):
        held.sort(key=lambda c: len(c[4]))  # passages of like length are padded least
        s, out = 0, []
        while s < len(held):
            e = s + 1
            while e < len(held) and e - s < AT_ONCE and (e - s + 1) * len(held[e][4]) <= WORDS_AT_ONCE:
                e += 1
            some = held[s:e]
            s = e
            for (d, k, i, first, _), (score, end) in zip(
                    some, align([(items.items[i], p) for _, _, i, _, p in some])):
                if enough(i, score):
                    out.append((d, k, items.item_ids[i], score, score / len(items.items[i]), first + end))
        if out:
            yield as_batch(out, _FOUND)

    held, size = [], 0
    for batch in batches:
        for cells in zip(*batch.columns):
            doc_id, doc, first, ids, hits = (c.as_py() for c in cells)
            ids = np.frombuffer(ids, "<i4").astype(np.int64)
            by_item: dict[int, list] = {}
            for h in hits:
                by_item.setdefault(h["item"], []).append((h["held"], h["at"], h["place"]))
            for i, found in by_item.items():
                for a, b in windows(len(items.items[i]), len(ids), found):
                    if enough(i, items.common_words(i, ids[a:b])):
                        held.append((doc_id, doc, i, first + a, ids[a:b]))
                        size += b - a
            if size > 4 * WORDS_AT_ONCE:
                yield from scored(held)
                held, size = [], 0
    yield from scored(held)


def _item_blocks(benchmark: DataFrame, block_words: int):
    """Blocks of (item_id, text), read one after another in id order."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")) \
            .where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) // 5 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _joined(source: DataFrame, items: Items, min_share: float, min_score: int) -> DataFrame:
    """Steps 1 to 3 for one block of items."""
    spark = source.sparkSession
    sent = spark.sparkContext.broadcast(items)
    passages = written(source.mapInArrow(
        lambda batches: _passages(batches, sent.value),
        "doc_id bigint, doc bigint, first bigint, ids binary, seeds array<struct<key:bigint,n:int,at:int>>")) \
        .withColumn("pid", F.monotonically_increasing_id())
    seeds = passages.select("pid", F.explode("seeds").alias("s")).select("pid", "s.key", "s.n", "s.at")
    # both tables have at most a row per word of the block
    held = F.broadcast(seeds.select("pid", "key", "n").distinct().groupBy("key", "n").agg(F.count("pid").alias("held")))
    places = F.broadcast(spark.createDataFrame(pa.table(
        dict(zip(("key", "n", "item", "place"), items.seeds))).cast(pa.schema(
            [("key", pa.int64()), ("n", pa.int32()), ("item", pa.int32()), ("place", pa.int32())]))))
    # one row a passage: its size bounds the group
    met = seeds.join(held, ["key", "n"]).join(places, ["key", "n"]) \
        .groupBy("pid").agg(F.collect_list(F.struct("item", "held", "at", "place")).alias("hits"))
    out = written(passages.join(met, "pid").select("doc_id", "doc", "first", "ids", "hits").mapInArrow(
        lambda batches: _score(batches, sent.value, min_share, min_score),
        "doc_id bigint, doc bigint, item_id bigint, score bigint, share double, end_word bigint"))
    sent.unpersist()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_share: float = 0.5, min_score: int = 8,
                 block_words: int = 1_000_000, common_items: int = 64) -> DataFrame:
    """doc_id, doc (content key), item_id, score (alignment), share (score over
    the item's words) and end_word (where the passage ends), for every document
    and item with a share of at least ``min_share`` and a score of at least
    ``min_score`` (or of the whole item, if that is shorter)."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("doc"),
                         F.col("text").cast("string").alias("text"))
    parts = []
    for rows in _item_blocks(benchmark, block_words):
        items = Items(rows, common_items)
        if items.items:
            parts.append(_joined(source, items, min_share, min_score))
    if not parts:
        return spark.createDataFrame(
            [], "doc_id bigint, doc bigint, item_id bigint, score bigint, share double, end_word bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    best = out.groupBy("doc_id", "doc", "item_id").agg(
        F.max(F.struct("score", "share", "end_word")).alias("best"))
    return best.select("doc_id", "doc", "item_id", "best.*")


def report(found: DataFrame) -> DataFrame:
    """One row per (doc_id, item_id): the best passage."""
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "share", "end_word")).alias("b")) \
        .select("doc_id", "item_id", "b.score", "b.share", "b.end_word")


def clean(docs: DataFrame, benchmark: DataFrame, *, min_item_words: int = 2, **options) -> DataFrame:
    """The documents without a contaminated passage; columns as in ``docs``.  Items of
    fewer than ``min_item_words`` words take no document away: a lone word ("yes") is
    no copy of a test item."""
    n_words = F.size(F.expr("regexp_extract_all(lower(text), '[\\\\p{L}\\\\p{N}]+', 0)"))
    items = benchmark.where(n_words >= min_item_words)
    hit = contaminated(docs, items, **options).select(
        F.col("doc_id").alias("__id"), F.col("doc").alias("__hit")).distinct()
    hit = written(hit)
    if hit.count() <= BROADCAST_HITS:
        hit = F.broadcast(hit)  # 16 bytes a row; beyond that, texts are shuffled
    key = free_name([*docs.columns, "__id", "__hit"], "__key")
    keyed = docs.withColumn(key, text_key())
    ids = hit.withColumnsRenamed({c: free_name(keyed.columns, c) for c in hit.columns})
    return keyed.join(ids, keyed["doc_id"].eqNullSafe(ids[ids.columns[0]]) & (keyed[key] == ids[ids.columns[1]]),
                      "left_anti").drop(key)
