import numpy as np

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import queries
from tabprobe.llm import quality_ftrl as qf


def test_ftrl_against_plain_updates():
    rng = np.random.default_rng(2)
    model, z, n = qf.FTRL(), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= model.l1:
            return 0.0
        s = np.sign(z[i])
        return -(z[i] - s * model.l1) / ((model.beta + np.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(200):
        at = np.unique(rng.integers(0, 40, 8)).astype(np.int32)
        x, y = rng.random(len(at)), int(rng.random() < 0.5)
        p = 1 / (1 + np.exp(-sum(weight(i) * v for i, v in zip(at.tolist(), x))))
        for i, v, w in [(i, v, weight(i)) for i, v in zip(at.tolist(), x)]:
            g, before = (p - y) * v, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / model.alpha * w
            n[i] = before + g * g
        model.learn(at, x, y)
    assert np.allclose(model.weights()[:40], [weight(i) for i in range(40)])


def test_features_count_whole_texts():
    f = qf.Features()
    at, x = f.of("a b a a")
    assert qf._SAME in at and abs((x[at != qf._BIAS] ** 2).sum() - 1) < 1e-6
    long_at, long_x = f.of("a b " * 50000 + "END")
    assert f.of("END")[0][0] in long_at and f.of(None)[0].tolist() == f.of("")[0].tolist() == [qf._BIAS]


def test_query_held_out_accuracy_and_odd_rows(spark, make_docs):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.SPARK["op9_quality"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, _, y in held if y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97 and np.mean([p for _, p, y in held if y == 1]) > 0.97
    docs = [(i, "### buy $$$ now" if i % 3 else "a calm line of prose") for i in range(60)]
    labels = [(i, int(i % 3 == 0), 0) for i in range(60)] + [(1, None, 0), (None, 1, 0), (60, 0, 0), (60, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    odd = make_docs(docs + ODD_ROWS).withColumn("quality", qf.F.lit("clash"))
    out = qf.report(odd, labels).collect()
    assert len(out) == len(docs) + len(ODD_ROWS)
    by = {r.doc_id: r.score for r in out}
    assert min(by[i] for i in range(12, 60) if i % 3 == 0) > max(by[i] for i in range(12, 60) if i % 3)
    assert {r.score for r in qf.report(odd, labels.limit(0)).collect()} == {0.5}
    assert qf.report(make_docs([]), labels).collect() == []


def test_features_on_the_driver_are_bounded(spark, make_docs):
    docs = make_docs([(i, f"word{i % 7} other{i % 3} " * 200) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    whole = qf.trained(docs, labels)
    assert (whole != 0).any() and (qf.trained(docs, labels, sample_bytes=1 << 20) == whole).all()
    assert not (qf.trained(docs, labels, sample_bytes=1) != 0).any()
    part = qf.trained(docs, labels, sample_bytes=500)
    assert (part != 0).any() and (part != whole).any()
