import random

import numpy as np

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import decontaminate as dc
from tabprobe.llm import queries


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_against_plain_smith_waterman():
    rng = random.Random(3)
    pairs = [([rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(1, 30))])
             for _ in range(80)]
    got = dc.align([(np.array(a), np.array(b)) for a, b in pairs])
    assert [s for s, _ in got] == [smith_waterman(a, b) for a, b in pairs]


def brute(rows, items, min_share=0.5, min_score=8):
    out = {}
    for d, text in rows:
        for i, item in items:
            a = dc.words(item)
            score = smith_waterman(a, dc.words(text)) if a else 0
            if a and score >= min_share * len(a) and score >= min(min_score, len(a)):
                out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_query_against_brute_force(spark, sample):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.SPARK["op6_decontaminate"](spark, SF).collect()
    some = [(r[0], r[1]) for r in sample if len(r[1]) < 3000]
    ids = {d for d, _ in some}
    assert {(r.doc_id, r.item_id): r.score for r in got if r.doc_id in ids} == brute(some, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})


def test_edited_copies_odd_rows_and_blocks(spark, make_docs):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)] + ["the", "of", "and"] * 20

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(prose(rng.randint(12, 50)))) for i in range(30)]
    items += [(100, "Tiny Item"), (101, None), (102, ""), (103, items[0][1])]
    rows = [(1000 + k, " ".join(prose(120))) for k in range(20)]
    for k in range(60):
        words = items[k % 30][1].split()
        for _ in range(len(words) // 7):  # replaced, dropped and inserted words
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = prose(rng.randint(0, 1))
        rows.append((2000 + k, " ".join(prose(40)) + ", " + " ".join(words).upper() + ". " + " ".join(prose(40))))
    rows += [(3000 + k, f"x {items[1][1]} y") for k in range(50)]  # a widely copied item keeps its seeds
    rows += [(4000, "a tiny item here"), (2000, "another row of this id")] + ODD_ROWS
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make_docs(rows).withColumn("item_id", dc.F.lit(1))
    want = brute(rows, [(i, t) for i, t in items if t])
    for block in (100, 10 ** 6):
        got = dc.report(dc.contaminated(docs, bench, block_words=block)).collect()
        assert {(r.doc_id, r.item_id): r.score for r in got} == want
    assert {2000 + k for k in range(60)} <= {d for d, _ in want} and (4000, 100) in want
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    flagged = {d for d, _ in want}
    texts = dict(rows)
    left = sorted(str(r.doc_id) for r in kept.collect())
    assert left == sorted(str(d) for d, t in rows if d not in flagged or (d == 2000 and t != rows[20][1]))
    assert texts and dc.contaminated(make_docs([]), bench).collect() == []
    assert dc.contaminated(docs, bench.limit(0)).collect() == [] and dc.clean(docs, bench.limit(0)).count() == len(rows)


def test_verbatim_copies_do_not_hide_edited_ones(spark, make_docs):
    item = [f"w{i}" for i in range(41)]
    edited = [f"x{i}" if i % 7 == 6 else w for i, w in enumerate(item)]
    half = [f"y{i}" if i >= 20 and i % 4 == 3 else w for i, w in enumerate(item)]
    rows = [(1, " ".join(item)), (2, "so " + " ".join(edited) + " on"), (3, " ".join(half))]
    rows += [(100 + k, f"quote{k} " + " ".join(item[:20])) for k in range(200)]  # below half of the item
    rows += [(400 + k, f"note{k} " + " ".join(item[:24])) for k in range(200)]  # above it
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    for some in (rows[:2], rows):
        got = dc.report(dc.contaminated(make_docs(some), bench)).collect()
        assert {(r.doc_id, r.item_id): r.score for r in got} == brute(some, [(7, " ".join(item))])
        assert {1, 2} <= {r.doc_id for r in got}


def test_common_phrases_fan_out_no_more_than_the_bound(spark, make_docs):
    """20 000 items begin alike: a document with the phrase meets none of them, edited
    and whole copies are found all the same."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, "which of the following " + " ".join(rng.choice(vocabulary) for _ in range(16))) for i in range(20_000)]
    items += [(30_000 + i, "please pick the one right answer to it") for i in range(200)]  # equal and common throughout
    built = dc.Items(items)
    _, at, _, _ = built.found("He asked which of the following roads leads home. " * 50)
    assert len(at) == 0
    edited = items[77][1].split()
    edited[9] = "changed"
    rows = [(1, "which of the following was it " * 30), (2, "so " + " ".join(edited) + " end"), (3, items[5][1]),
            (4, "please pick the one right answer to it")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(make_docs(rows), bench).collect()}
    assert got == {(2, 77), (3, 5)} | {(4, 30_000 + i) for i in range(200)}
    seeds = np.unique(built.seeds[:2], axis=1, return_counts=True)
    assert all(c <= 64 or n == 8 for n, c in zip(seeds[0][1], seeds[1]))  # whole items (8 words) aren't bounded


def test_recall_on_paraphrased_copies(spark, make_docs):
    """Against exhaustive alignment, for copies with every third to eighth word changed:
    all but some of those in which hardly a run of three words is left."""
    rng = random.Random(20)
    vocabulary = [f"word{i}" for i in range(400)] + ["the", "of", "and", "to"] * 25
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60)))) for i in range(40)]
    rows = []
    for k in range(160):
        text = items[k % 40][1].split()
        step = 3 + k % 6
        rows.append((k, " ".join(rng.choice(vocabulary) if i % step == step - 1 else w for i, w in enumerate(text))))
    want = brute(rows, items)
    got = {(r.doc_id, r.item_id): r.score for r in dc.report(dc.contaminated(
        make_docs(rows), spark.createDataFrame(items, "item_id bigint, text string"))).collect()}
    assert got.items() <= want.items() and len(got) >= 0.9 * len(want) and len(want) > 100


def test_long_windows_are_cut_with_overlap():
    hits = [(1, p, 0) for p in range(0, 3000, 3)]
    parts = dc.windows(20, 4000, hits)
    assert all(b - a <= 8 * 20 + 64 for a, b in parts)
    covered = [any(a <= s and s + 40 <= b for a, b in parts) for s in range(0, 2900)]
    assert all(covered)
    assert dc.windows(10, 500, [(5, 100, 0), (1, 300, 2), (9, 400, 1)]) == [(93, 117), (291, 315)]


def test_lone_words_and_taken_names(spark, make_docs):
    docs = make_docs([(1, "yes it is"), (2, "no yes")]).withColumnsRenamed({"lang": "__key", "source": "__id"})
    bench = spark.createDataFrame([(1, "Yes!")], "item_id bigint, text string")
    assert dc.clean(docs, bench).count() == 2 and dc.clean(docs, bench).columns == docs.columns
    assert dc.clean(docs, bench, min_item_words=1).count() == 0
