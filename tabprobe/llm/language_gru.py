"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes.  In each, a
forward and a backward recurrent layer with an update gate
(``h <- z h + (1 - z) tanh(.)``) read the bytes; from both states every byte
position gets a distribution over languages.  A document's probabilities are the
mean over all its bytes.

The network is trained here in numpy by backpropagation through time, every
position being labelled with its document's language, on windows of a bounded
sample of labelled documents (``per_language`` documents of each language, by
hash of the id, ``sample`` in all).  Scoring reads every byte of every text;
windows of many documents go through the network together in tiles.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
documents without a language aren't learned from; repeated rows get equal
results; with no labelled document everything is ``und``; an empty table gives
no row; other columns are kept by ``identified`` and never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabprobe.llm.common import free_name, id_crc

WINDOW, PAD, TILE = 64, 256, 4096
_LETTER = re.compile(r"[^\W\d_]")
FLUSH_BYTES = 4 << 20


class ByteGRU:
    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(labels)
        self.labels, self.hidden = labels, hidden
        scale = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        # per direction: byte embedding times input weights (gate | candidate), recurrent weights
        self.p = {"Ef": scale(257, 2 * h), "Uf": scale(h, 2 * h), "Eb": scale(257, 2 * h),
                  "Ub": scale(h, 2 * h), "W": scale(2 * h, k), "b": np.zeros(k, np.float32)}

    def _states(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: [T, B] bytes. Hidden states [T, B, H], and what training needs."""
        T, B = x.shape
        h, H = np.zeros((B, self.hidden), np.float32), self.hidden
        E, U = self.p["E" + way].copy(), self.p["U" + way].copy()
        E[:, :H] *= 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        U[:, :H] *= 0.5
        out, trace = np.empty((T, B, H), np.float32), []
        for t in (range(T) if way == "f" else reversed(range(T))):
            g = E[x[t]]
            g += h @ U
            np.tanh(g, out=g)
            z = g[:, :H]
            z += 1
            z *= 0.5
            if keep:
                trace.append((t, h, z, g[:, H:]))
            new = h - g[:, H:]
            new *= z
            new += g[:, H:]
            h = out[t] = new
        return out, trace

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[T, B] bytes to [T, B, K] probabilities."""
        f, b = self._states(x, "f", False)[0], self._states(x, "b", False)[0]
        H = self.hidden
        logits = f @ self.p["W"][:H]
        logits += b @ self.p["W"][H:]
        logits += self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over real positions, and gradients; y: [B] label numbers."""
        T, B = x.shape
        H, grads = self.hidden, {}
        f, trace_f = self._states(x, "f", True)
        b, trace_b = self._states(x, "b", True)
        both = np.concatenate((f, b), axis=2)
        logits = both @ self.p["W"] + self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        real = (x != PAD).astype(np.float32)
        n = max(1.0, float(real.sum()))
        right = prob[:, np.arange(B), y]
        loss = float(-(np.log(right + 1e-9) * real).sum() / n)
        prob[:, np.arange(B), y] -= 1
        prob *= (real / n)[:, :, None]
        grads["W"] = both.reshape(T * B, -1).T @ prob.reshape(T * B, -1)
        grads["b"] = prob.sum(axis=(0, 1))
        back = prob @ self.p["W"].T
        for way, trace, d_out in (("f", trace_f, back[:, :, :H]), ("b", trace_b, back[:, :, H:])):
            U, dh = self.p["U" + way], np.zeros((B, H), np.float32)
            dU, dE = np.zeros_like(U), np.zeros_like(self.p["E" + way])
            for t, before, z, c in reversed(trace):
                dh = dh + d_out[t]
                dg = np.empty((B, 2 * H), np.float32)
                dg[:, :H] = dh * (before - c) * z * (1 - z)
                dg[:, H:] = dh * (1 - z) * (1 - c * c)
                dU += before.T @ dg
                np.add.at(dE, x[t], dg)
                dh = dh * z + dg @ U.T
            grads["U" + way], grads["E" + way] = dU, dE
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02,
              seed: int = 1) -> float:
        """Adam on random batches of windows x: [N, T], labels y: [N]."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        loss = float("nan")
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(batch, len(x)))
            loss, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            pace = rate * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (pace * (m[k] / (1 - 0.9 ** step))
                              / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-6)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """[documents, languages]: mean probabilities over each text's bytes."""
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        total = int(windows.sum())
        out = np.zeros((len(texts), len(self.labels)))
        if not total:
            return out
        x = np.full(total * WINDOW, PAD, np.int16)
        begin = np.concatenate(([0], np.cumsum(windows)[:-1])) * WINDOW
        for b, t in zip(begin.tolist(), texts):
            x[b:b + len(t)] = np.frombuffer(t, np.uint8)
        x = x.reshape(total, WINDOW)
        doc = np.repeat(np.arange(len(texts)), windows)
        for s in range(0, total, TILE):
            tile = np.ascontiguousarray(x[s:s + TILE].T)
            p = self.probabilities(tile)
            if tile[-1].max() == PAD or (tile == PAD).any():
                p *= (tile != PAD)[:, :, None]
            sums = p.sum(axis=0, dtype=np.float64)
            np.add.at(out, doc[s:s + TILE], sums)
        return out / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, per_language: int, sample: int, per_doc: int) -> DataFrame:
    """(lang, window): windows of a bounded sample of labelled documents."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND lang <> 'und'") \
        .select("doc_id", "lang", F.xxhash64("doc_id", "lang").alias("h"))
    # a language may hold most documents: its count says below which hash about
    # four times the wanted number lie, and only those are ranked
    # (at most ``sample`` languages can be learned from that many documents)
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample)
    few = labelled.join(F.broadcast(counts), "lang").where(
        F.pmod("h", F.lit(1 << 40)).cast("double") * F.col("n") < F.lit(4.0 * per_language * (1 << 40)))
    turn = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = few.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= per_language) \
        .orderBy("turn", "h", "lang").limit(sample).select("doc_id", "lang").distinct()
    source = docs.join(F.broadcast(chosen), ["doc_id", "lang"]) \
        .select("doc_id", "lang", F.col("text").cast("binary").alias("bytes"))
    windows = F.expr(f"transform(sequence(1, {per_doc}), i -> substring(bytes, 1 + CAST(pmod("
                     f"xxhash64(doc_id, i), greatest(1, length(bytes) - {WINDOW - 1})) AS INT), {WINDOW}))")
    return source.select("doc_id", "lang", F.explode(windows).alias("window")) \
        .orderBy(F.xxhash64("doc_id", "window"), "lang", "window").limit(sample * per_doc)


def trained(docs: DataFrame, *, learn: Column | None = None, per_language: int = 1000, sample: int = 8192,
            per_doc: int = 4, hidden: int = 8, steps: int = 200, seed: int = 1) -> ByteGRU | None:
    """A network trained on ``docs`` where ``learn`` holds; None without labels."""
    source = docs.where(learn) if learn is not None else docs
    rows = training_windows(source, per_language, sample, per_doc).select("lang", "window").collect()
    rows = [(r[0], bytes(r[1])) for r in rows if len(r[1])]
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    x = np.full((len(rows), WINDOW), PAD, np.int16)
    for i, (_, w) in enumerate(rows):
        x[i, :len(w)] = np.frombuffer(w, np.uint8)
    y = np.array([labels.index(r[0]) for r in rows])
    # languages are drawn alike, however many windows each has
    pick = np.random.default_rng(seed)
    by = [np.flatnonzero(y == k) for k in range(len(labels))]
    even = np.concatenate([pick.choice(b, max(map(len, by))) for b in by])
    model = ByteGRU(labels, hidden, seed)
    model.train(x[even], y[even], steps, seed=seed)
    return model


def identified(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (with underscores after them if
    these names are taken)."""
    names = docs.columns
    added = [free_name(names, c) for c in ("lang_pred", "lang_score")]
    source = docs.withColumn("text", F.col("text").cast("string"))
    at = names.index("text")
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in source.schema.fields]

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and model is not None and _LETTER.search(t)]
        if some:
            p = model.documents([texts[i].encode("utf-8", "replace") for i in some])
            for i, row in zip(some, p):
                k = int(row.argmax())
                pred[i], score[i] = model.labels[k], float(min(1.0, row[k]))
        return pred, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(cut: pa.RecordBatch, texts):
            pred, score = predict(texts)
            return pa.RecordBatch.from_arrays(
                [*cut.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                [*names, *added])

        for batch in batches:
            texts, s, held = [], 0, 0
            for i, cell in enumerate(batch.column(at)):
                texts.append(cell.as_py())
                held += len(texts[-1] or "")
                if held > FLUSH_BYTES:
                    yield part(batch.slice(s, i + 1 - s), texts)
                    texts, s, held = [], i + 1, 0
            if texts:
                yield part(batch.slice(s, batch.num_rows - s), texts)

    return source.mapInArrow(run, ", ".join([*fields, f"`{added[0]}` string", f"`{added[1]}` double"]))


def in_a_language(docs: DataFrame, model: ByteGRU | None, min_evidence: float = 0.1) -> DataFrame:
    """The documents that are in some language; columns as in ``docs``.

    A document's evidence is the network's pooled probability of its best language,
    times the share of letters among its characters that aren't space: the network
    knows languages only, so what is hardly made of letters counts for less.
    Documents below ``min_evidence`` go, as do null texts and texts without a
    letter.  Without a network (no document is marked) the share of letters decides
    alone, so a corpus without marks is kept.
    """
    pred, score = (free_name(docs.columns, c) for c in ("lang_pred", "lang_score"))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    share = F.try_divide(letters, F.length(F.regexp_replace("text", r"[\s]", "")))
    if model is None:
        return docs.where(F.coalesce(letters > 0, F.lit(False)) & (share >= min_evidence))
    return identified(docs, model).where((F.col(pred) != "und") & (F.col(score) * share >= min_evidence)) \
        .select(*docs.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 3 == 1


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the
    documents that aren't held out."""
    model = trained(docs, learn=~held_out(), **options)
    return identified(docs.select("doc_id", "text"), model) \
        .select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
