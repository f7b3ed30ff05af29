import numpy as np

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import language_gru as lg
from tabprobe.llm import queries


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(0)
    model = lg.ByteGRU(["a", "b", "c"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.integers(60, 70, (7, 5)).astype(np.int16)
    x[5:, 1] = lg.PAD
    y = np.array([0, 1, 2, 0, 1])
    _, grads = model.gradients(x, y)
    for name, p in model.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if name in ("Ef", "Eb"):
                at = (int(rng.integers(60, 70)), at[1])
            keep, eps = p[at], 1e-2
            p[at] = keep + eps
            up = model.gradients(x, y)[0]
            p[at] = keep - eps
            down = model.gradients(x, y)[0]
            p[at] = keep
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 3e-3


def plain_probabilities(model, text):
    """One window and one byte at a time."""
    raw, H, total = text.encode(), model.hidden, np.zeros(len(model.labels))
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for s in range(0, len(raw), lg.WINDOW):
        window = list(raw[s:s + lg.WINDOW]) + [lg.PAD] * (lg.WINDOW - len(raw[s:s + lg.WINDOW]))
        states = {}
        for way, order in (("f", range(lg.WINDOW)), ("b", reversed(range(lg.WINDOW)))):
            h, states[way] = np.zeros(H), {}
            for t in order:
                g = model.p["E" + way][window[t]] + h @ model.p["U" + way]
                z, c = sigmoid(g[:H]), np.tanh(g[H:])
                h = states[way][t] = z * h + (1 - z) * c
        for t in range(len(raw[s:s + lg.WINDOW])):
            a = np.exp(np.concatenate((states["f"][t], states["b"][t])) @ model.p["W"] + model.p["b"])
            total += a / a.sum()
    return total / len(raw)


def test_every_byte_is_pooled():
    model = lg.ByteGRU(["a", "b", "c"], hidden=4, seed=3)
    texts = ["x", "été " * 40, "a" * 64, "b" * 65, "Zug " * 700]
    got = model.documents([t.encode() for t in texts])
    want = np.array([plain_probabilities(model, t) for t in texts])
    assert np.allclose(got, want, atol=1e-4)


def test_query_held_out_accuracy_and_odd_rows(spark, make_docs):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.SPARK["op8_language"](spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert 0.25 < len(held) / len(rows) < 0.42
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) > 0.97 * len(held)
    docs = [(100 + i, ("der die das und nicht ein " if i % 2 else "the and of that with from ") * 20, "de" if i % 2 else "en")
            for i in range(60)]
    odd = make_docs(docs + ODD_ROWS + [(70, "1234 !! --")]).withColumn("lang_pred", lg.F.lit("clash"))
    out = lg.report(odd, steps=80).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(docs) + len(ODD_ROWS) + 1
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (1, 2, 3, 70))
    assert all(by[d].lang_pred == lang for d, _, lang in docs)
    assert {r.lang_pred for r in lg.report(make_docs(ODD_ROWS)).collect()} == {"und"}
    assert lg.report(make_docs([])).collect() == []
