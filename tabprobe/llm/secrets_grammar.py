"""Secret scan with inferred grammars.

Fixed patterns (``BASE``) find labelled credentials.  From a bounded sample of
their values, a probabilistic automaton is inferred per kind: the prefix tree
of the values (as character classes) is built, and states are merged in
breadth-first order into the most alike of the states found compatible.  Two
states are compatible if Hoeffding bounds accept their stopping and next-symbol
frequencies, and those of all states after them, as equal, and the distribution
of how many characters are still to come as well; states of few values, where
such bounds accept anything, must agree on at least half of the latter.  So states
at the same place of a fixed format merge, and those at different places don't:
the automaton of 32-digit values has a state for each digit.

Every token of ``MIN_TOKEN`` characters or more that isn't within a base match
(one that reaches beyond a base match is taken whole) is scored: a token that
some automaton generates by steps it has seen gets that automaton's
log-likelihood minus that of ordinary text, a chain of characters learned from
the short tokens of all texts, which are no candidates; tokens that reach
``min_log_odds`` are added as spans of kind ``grammar``.

Two passes over the texts: one keeps base values and counts the characters of
short tokens, one scores.  Sample bounds are parameters: ``sample`` different
values per kind, chosen by hash.

Edge cases: a null text is empty; empty texts have no spans; repeated rows get
equal results; without any labelled value no span is added; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import as_batch, in_chunks, written

# fixed values: the base patterns, and the least length of what they find
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    # runs of 32 and more are those of [0-9a-f]+ that are long enough
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS = tuple(k for k, *_ in BASE)
#: least length of a candidate: the least of a labelled value
MIN_TOKEN = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_TOKEN)
#: ordinary text is learned from the shorter ones
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]+")
#: character classes and their sizes; any other character is a class of its own
CLASSES = {"d": "0123456789", "f": "abcdef", "l": "ghijklmnopqrstuvwxyz",
           "F": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS = {c: k for k, chars in CLASSES.items() for c in chars}
_SIZE = {k: len(v) for k, v in CLASSES.items()}
_ALPHABET = 68
#: visits below which a state's frequencies alone decide nothing
FEW = 30
#: probability of a step that a state hasn't seen
UNSEEN = 1e-30
#: tokens whose number or score a task remembers
REMEMBERED = 1 << 16


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the base matches, kind by kind."""
    out = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                out.append((kind, m.start(), m.end(), m[group]))
    return out


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens that aren't within one base match."""
    covered = sorted((a, b) for _, a, b, _ in base)
    out, k, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # the furthest end of a match that begins at or before the token
        while k < len(covered) and covered[k][0] <= a:
            reach = max(reach, covered[k][1])
            k += 1
        if reach < b:
            out.append((a, b, m[0]))
    return out


class Automaton:
    """A probabilistic automaton by state merging (ALERGIA).  ``alpha`` is the
    test's significance; smaller merges more."""

    def __init__(self, values: Iterable[str], alpha: float = 0.05):
        self.n, self.stop = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.hits: list[dict[str, int]] = [{}]
        self.left: list[dict[int, int]] = [{}]  # visits by characters still to come
        for v in values:
            self._insert([_CLASS.get(c, c) for c in v])
        self.factor = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _insert(self, symbols: list[str]) -> None:
        s, left = 0, len(symbols)
        self.n[0] += 1
        self.left[0][left] = self.left[0].get(left, 0) + 1
        for c in symbols:
            self.hits[s][c] = self.hits[s].get(c, 0) + 1
            if c not in self.next[s]:
                self.next[s][c] = len(self.n)
                self.n.append(0), self.stop.append(0), self.next.append({}), self.hits.append({}), self.left.append({})
            s, left = self.next[s][c], left - 1
            self.n[s] += 1
            self.left[s][left] = self.left[s].get(left, 0) + 1
        self.stop[s] += 1

    def _gap(self, a: int, b: int) -> float:
        """Largest difference of the shares of visits with at most so many characters to come."""
        most = x = y = 0.0
        for k in sorted(self.left[a].keys() | self.left[b].keys()):
            x += self.left[a].get(k, 0) / self.n[a]
            y += self.left[b].get(k, 0) / self.n[b]
            most = max(most, abs(x - y))
        return most

    def _alike(self, red: int, blue: int) -> tuple[float, float] | None:
        """How far the states are apart (what is to come, next symbols); None if they
        aren't compatible."""
        gap = self._gap(red, blue)
        bound = self.factor * (1 / math.sqrt(self.n[red]) + 1 / math.sqrt(self.n[blue]))
        if gap > (bound if min(self.n[red], self.n[blue]) >= FEW else min(bound, 0.5)):
            return None
        if not self._compatible(red, blue):
            return None
        symbols = self.hits[red].keys() | self.hits[blue].keys()
        return gap, sum(abs(self.hits[red].get(c, 0) / self.n[red] - self.hits[blue].get(c, 0) / self.n[blue])
                        for c in symbols)

    def _differ(self, a: int, m: int, b: int, n: int) -> bool:
        return m > 0 and n > 0 and abs(a / m - b / n) > self.factor * (1 / math.sqrt(m) + 1 / math.sqrt(n))

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            if self._differ(self.stop[r], self.n[r], self.stop[b], self.n[b]):
                return False
            for c in self.hits[r].keys() | self.hits[b].keys():
                if self._differ(self.hits[r].get(c, 0), self.n[r], self.hits[b].get(c, 0), self.n[b]):
                    return False
                if c in self.next[r] and c in self.next[b]:
                    todo.append((self.next[r][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to the states from ``red`` on."""
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            self.n[r] += self.n[b]
            self.stop[r] += self.stop[b]
            for k, v in self.left[b].items():
                self.left[r][k] = self.left[r].get(k, 0) + v
            for c, h in self.hits[b].items():
                self.hits[r][c] = self.hits[r].get(c, 0) + h
                if c in self.next[r]:
                    todo.append((self.next[r][c], self.next[b][c]))
                else:
                    self.next[r][c] = self.next[b][c]

    def _merge(self) -> None:
        red = [0]
        known = {0}
        blue = deque((0, c) for c in sorted(self.next[0]))
        while blue:
            source, c = blue.popleft()
            state = self.next[source][c]
            if state in known:
                continue
            found = [(far, r) for r in red if (far := self._alike(r, state)) is not None]
            if found:
                into = min(found)[1]
                self.next[source][c] = into
                self._fold(into, state)
                # folding may have given red states new successors
                waiting = set(blue)
                blue.extend((s, x) for s in red for x in sorted(self.next[s])
                            if self.next[s][x] not in known and (s, x) not in waiting)
            else:
                red.append(state)
                known.add(state)
                blue.extend((state, x) for x in sorted(self.next[state]))
        keep = {s: i for i, s in enumerate(red)}
        self.n, self.stop = [self.n[s] for s in red], [self.stop[s] for s in red]
        self.hits, self.left = [self.hits[s] for s in red], [self.left[s] for s in red]
        self.next = [{c: keep[t] for c, t in self.next[s].items()} for s in red]

    def accepts(self, value: str) -> bool:
        """Whether every step, and to stop after the last, was seen."""
        s = 0
        for c in value:
            s = self.next[s].get(_CLASS.get(c, c), -1)
            if s < 0:
                return False
        return self.stop[s] > 0

    def log_likelihood(self, value: str, prior: float = 0.5) -> float:
        """Of the value's characters and its end; a seen class gets the prior's share
        too, a step that wasn't seen has ``UNSEEN`` and leads to the start state."""
        s, total = 0, 0.0
        for c in value:
            k = _CLASS.get(c, c)
            size = _SIZE.get(k, 1)
            seen = self.hits[s].get(k, 0)
            total += math.log((seen + prior * size / _ALPHABET) / (self.n[s] + prior) / size if seen else UNSEEN)
            s = self.next[s].get(k, 0)
        return total + math.log((self.stop[s] + prior / _ALPHABET) / (self.n[s] + prior) if self.stop[s] else UNSEEN)


class Ordinary:
    """A chain of characters: how likely ordinary text goes on as a token does."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.pairs = pairs
        self.total: dict[str, int] = {}
        for (a, _), n in pairs.items():
            self.total[a] = self.total.get(a, 0) + n

    def log_likelihood(self, value: str, prior: float = 1.0) -> float:
        # "" stands before the first character; ends cost nothing
        return sum(math.log((self.pairs.get((a, b), 0) + prior / _ALPHABET) / (self.total.get(a, 0) + prior))
                   for a, b in zip(("", *value), value))


_LEARNED = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of base matches by kind, and (kind ``pair``) how often characters
    follow each other in short tokens."""
    pairs: Counter = Counter()
    tokens: Counter = Counter()

    def spend():
        for token, n in tokens.items():
            for two in zip((" ", *token), token):
                pairs["".join(two)] += n
        tokens.clear()

    for batch in batches:
        values: Counter = Counter()
        for cell in batch.column(0):
            text = cell.as_py() or ""
            values.update((kind, value) for kind, _, _, value in base_spans(text))
            tokens.update([t for t in TOKEN.findall(text) if 1 < len(t) < MIN_TOKEN])
            if len(tokens) > REMEMBERED:
                spend()
        if values:
            yield as_batch([(*v, n) for v, n in values.items()], _LEARNED)
    spend()
    if pairs:
        yield as_batch([("pair", p, n) for p, n in pairs.items()], _LEARNED)


Model = tuple[dict[str, Automaton], Ordinary]


def infer(docs: DataFrame, sample: int, alpha: float) -> Model | None:
    """An automaton per kind that has values, from at most ``sample`` different values
    by hash, and ordinary text; None without a value."""
    learned = written(docs.select(F.col("text").cast("string")).mapInArrow(
        _scan, "kind string, value string, n bigint"))
    grammars = {}
    for kind in KINDS:
        values = learned.where(F.col("kind") == kind).groupBy("value").agg(F.xxhash64("value").alias("h")) \
            .orderBy("h", "value").limit(sample).select("value").collect()
        if values:
            grammars[kind] = Automaton([r[0] for r in values], alpha)
    if not grammars:
        return None
    # at most a row for every two characters of the alphabet
    pairs = learned.where("kind = 'pair'").groupBy("value").agg(F.sum("n").alias("n")).collect()
    return grammars, Ordinary({(r[0][0].strip(), r[0][1]): r[1] for r in pairs})


def log_odds(value: str, grammars: dict[str, Automaton], ordinary: Ordinary) -> float:
    """The best automaton's log-likelihood minus that of ordinary text; minus infinity
    where no automaton generates the value."""
    found = [g.log_likelihood(value) for g in grammars.values() if g.accepts(value)]
    return max(found) - ordinary.log_likelihood(value) if found else -math.inf


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, "grammar"))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


_RESULT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS],
                     ("n_grammar", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())])


def _score(batches: Iterator[pa.RecordBatch], model: Model | None, min_log_odds: float) -> Iterator[pa.RecordBatch]:
    odds: dict[str, float] = {}

    def is_secret(token: str) -> bool:
        if token not in odds:
            if len(odds) >= REMEMBERED:
                odds.clear()
            odds[token] = log_odds(token, *model)
        return odds[token] >= min_log_odds

    def one(doc_id, text):
        text = text or ""
        base = base_spans(text)
        known = [(kind, a, b) for kind, a, b, _ in base]
        added = [("grammar", a, b) for a, b, token in candidates(text, base) if is_secret(token)] if model else []
        spans = joined(known + added)
        return (doc_id, *(sum(x[0] == k for x in known) for k in KINDS), len(added), joined(known), spans), len(spans)

    return in_chunks(batches, one, _RESULT)


def find_secrets(docs: DataFrame, *, sample: int = 1000, alpha: float = 0.05,
                 min_log_odds: float = 12.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_grammar, ``base_spans`` and ``spans``
    (kind:start:end in code points, by start, comma-joined)."""
    model = infer(docs, sample, alpha)
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        lambda batches: _score(batches, model, min_log_odds),
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_grammar bigint, "
        "base_spans string, spans string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_grammar")


def base_digest(text: str | None) -> str:
    """``base_sha256`` of one text, for callers without Spark."""
    return hashlib.sha256(joined((k, a, b) for k, a, b, _ in base_spans(text or "")).encode()).hexdigest()
