import random
import re

import numpy as np
import xxhash

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import queries, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for (d, _), f in zip(rows, fps):
        r = root(f)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, f"{f:016x}", least.get(root(f))) for (d, _), f in zip(rows, fps)), key=str)


def test_query_against_brute_force(spark, sample):
    got = [tuple(r) for r in queries.SPARK["op5_simhash"](spark, SF).collect()]
    assert sorted(got, key=str) == brute([(r[0], r[1]) for r in sample])


def near_copies():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for k in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((100 + k, " ".join(copy)))
    return rows


def test_odd_rows_copies_and_near_copies(spark, make_docs):
    rows = ODD_ROWS + near_copies()
    found = simhash.near_duplicates(make_docs(rows))
    got = [(r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found.collect()]
    assert sorted(got, key=str) == brute(rows)
    assert simhash.near_duplicates(make_docs([])).collect() == []
    kept = simhash.one_per_component(make_docs(rows).withColumn("fp", simhash.F.lit(1)))
    assert kept.columns[-1] == "fp" and kept.columns[0] == "doc_id"
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(c) for _, _, c in brute(rows)})


def test_links_complete_for_random_flips(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    for bits in (0, 1, 2, 3, 5):
        got = {tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fp bigint"), bits).collect()}
        want = {(a, b) for (a,) in signed for (b,) in signed
                if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert got == want


def test_groups_without_ids_stay_apart(spark, make_docs):
    rows = [(None, "the first text of a row without id"), (None, "quite another text, no id either"),
            (None, "quite another text, no id either"), (3, "a text with an id")]
    kept = simhash.one_per_component(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted({(str(d), t) for d, t in rows})
