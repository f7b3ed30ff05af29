import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import queries, suffix_dedup


def brute(rows, length=50):
    least = {}
    for d, text in rows:
        raw, d = (text or "").encode(), suffix_dedup.NO_ID if d is None else d
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            least[s] = min(d, least.get(s, d))
    out = []
    for d, text in rows:
        raw, at = (text or "").encode(), suffix_dedup.NO_ID if d is None else d
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if least[raw[i:i + length]] < at:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sample):
    got = [tuple(r) for r in queries.SPARK["op10_suffix_dedup"](spark, SF).collect()]
    assert sorted(got, key=str) == brute([(r[0], r[1]) for r in sample])


def passages():
    rng = random.Random(4)

    def text(n):
        return "".join(rng.choice("abcdé \n") for _ in range(n))

    shared = [text(rng.randint(30, 160)) for _ in range(8)]
    rows = []
    for k in rng.sample(range(1000, 3000), 150):
        parts = [text(rng.randint(0, 90)) for _ in range(3)]
        for _ in range(2):
            s = rng.choice(shared)
            a = rng.randint(0, 20)
            parts.insert(rng.randint(0, len(parts)), s[a:len(s) - rng.randint(0, 20)])
        rows.append((k, "".join(parts)))
    hot = text(400)
    rows += [(5000 + i, hot) for i in range(60)] + [(5000, "x" + hot), (5100, hot * 3), (2, hot[30:200])]
    return rows + ODD_ROWS + [(10, "a" * 200), (3, "b" * 49), (11, "b" * 49), (0, "word " * 30)]


def test_passages_copies_and_odd_rows(spark, make_docs):
    rows = passages()
    docs = make_docs(rows, parts=3).withColumn("start", suffix_dedup.F.lit(1))
    for buckets in (1, 7):
        got = suffix_dedup.digest(suffix_dedup.without_repeats(docs, buckets=buckets)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
    got = suffix_dedup.digest(suffix_dedup.without_repeats(docs, block_bytes=2000)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    size = sum(len((t or "").encode()) for _, t in rows)
    assert suffix_dedup.block_count(docs, 2000) == -(-size // 2000)
    assert suffix_dedup.without_repeats(make_docs([])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=50, max_size=300), st.integers(0, 200), st.text("ab", max_size=30))
def test_equal_windows_choose_equal_anchors(text, cut, lead):
    def chosen(raw):
        data = np.frombuffer(raw, np.uint8)
        out = []
        for i in range(len(raw) - 49):
            valid = np.zeros(len(raw) - 49, bool)
            valid[i] = True
            out.append(int(suffix_dedup.anchors(data, valid)[0]) - i)
        return {raw[i:i + 50]: a for i, a in enumerate(out)}

    raw = text.encode()
    other = lead.encode() + raw[cut % (len(raw) - 49):]
    one, two = chosen(raw), chosen(other)
    assert all(one[w] == two[w] for w in one.keys() & two.keys())
    assert all(0 <= a < suffix_dedup.CHOICES for a in one.values())


def test_levels_grow_geometrically():
    family, seen = suffix_dedup.SuffixLevels(), {}
    rng = random.Random(2)
    for batch in range(37):
        items = np.array([bytes([rng.randint(1, 9) for _ in range(3)]) for _ in range(8)], "S50")
        docs = np.sort(np.array([batch * 4 + rng.randint(0, 3) for _ in range(8)]))
        got = family.add(items, docs)
        for s, d in zip(items.tolist(), docs.tolist()):
            seen[s] = min(d, seen.get(s, d))
        assert got.tolist() == [seen[s] < d for s, d in zip(items.tolist(), docs.tolist())]
    assert [x is not None for x in family.levels] == [bool(37 >> k & 1) for k in range(6)]


def by_hand(rows, buckets, blocks):
    """The operator's steps without Spark: its rows, and the contexts in each bucket."""
    def grouped(table, column):
        return {k: table.filter(pc.equal(table[column], k)) for k in pc.unique(table[column]).to_pylist()}

    docs = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()),
                     "text": pa.array([None if t is None else t.encode() for _, t in rows], pa.binary()),
                     "block": pa.array([k % blocks for k in range(len(rows))], pa.int64())})
    parts = grouped(docs, "block")
    codes = pa.concat_tables([suffix_dedup._send_codes(t, buckets) for t in parts.values()])
    replies = pa.concat_tables([suffix_dedup._shared_codes(t) for t in grouped(codes, "bucket").values()])
    dealt = pa.concat_tables([suffix_dedup._send_contexts(t, replies.filter(pc.equal(replies["block"], k)), buckets)
                              for k, t in parts.items()])
    load = [0] * buckets
    for b, known, cell in zip(dealt["bucket"].to_pylist(), dealt["spans"].to_pylist(), dealt["cell"].to_pylist()):
        load[b] += 0 if known else len(suffix_dedup._unpack(cell)[0]) // suffix_dedup.WIDTH
    spans = pa.concat_tables([suffix_dedup._bucket(t) for t in grouped(dealt, "bucket").values()])
    out = []
    for k, t in parts.items():
        done = suffix_dedup._cut(t, spans.filter(pc.equal(spans["block"], k)))
        out += [(suffix_dedup.NO_ID if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"],
                 hashlib.sha256(r["kept"]).hexdigest()) for r in done.to_pylist()]
    return sorted(out, key=str), load


def test_hot_phrase_is_spread_over_buckets(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix_dedup, "HOT", 50, raising=False)
    monkeypatch.setattr(suffix_dedup, "HOT_AT_ONCE", 64, raising=False)

    def prose(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    for size in (40, 69):
        phrase = prose(size)
        rows = [(k, prose(100) + (phrase if k % 3 == 0 else "") + prose(100)) for k in range(1500)]
        rows += [(2000 + k, rows[3 * k][1][60:200]) for k in range(40)]  # a part with the phrase in it
        got, load = by_hand(rows, 16, 4)
        assert got == brute(rows)
        assert max(load) < 3 * sum(load) / len(load)


def test_all_anchors_hot_and_runs_of_one_byte(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1, raising=False)
    rows = [(d, t) for d, t in passages() if d is not None or t is None or len(t) < 60]
    got, _ = by_hand(rows, 5, 3)
    assert got == brute([(suffix_dedup.NO_ID if d is None else d, t) for d, t in rows])
    rows = [(1, "x" + "-" * 5000 + "y"), (2, "-" * 3000), (3, "ab" * 2000), (4, "c" + "ab" * 100 + "d" + "-" * 60)]
    for hot in (1, 1 << 14):
        monkeypatch.setattr(suffix_dedup, "HOT", hot, raising=False)
        got, load = by_hand(rows, 3, 2)
        assert got == brute(rows) and sum(load) < 1000
