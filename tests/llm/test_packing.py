import os
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import pack_bestfit, pack_squares, queries
from tabprobe.llm.tokens import encoder

TOKENIZER = "byte_bpe_50k.json"


def expected_ids(text):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    if not hasattr(expected_ids, "t"):
        expected_ids.t = Tokenizer.from_file(path(TOKENIZER))
    return expected_ids.t.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(
    st.characters(min_codepoint=9, max_codepoint=0x2ff, exclude_categories=("Cs",)),
    st.sampled_from(" \t\n\r'’s—…€ ­\u0085 　ßıſK"), st.characters(exclude_categories=("Cs",))),
    max_size=60))
def test_ids_equal_tokenizers(text):
    assert encoder(TOKENIZER).ids(text).tolist() == expected_ids(text)[:-1]


def check_pieces(rows, texts, window=1024):
    """Every id in exactly one piece; sequences gapless."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, _ in texts}
    for doc_id, text in texts:
        ids, at = expected_ids(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            part = np.array(ids[at:at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    fills = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= window
        fills.append(at)
    return fills


def test_pack_whole_table(spark, sample):
    rows = queries.SPARK["op1_pack_squares"](spark, SF).collect()
    fills = check_pieces(rows, [(r[0], r[1]) for r in sample])
    padding = sum(0 if f & (f - 1) == 0 else 1024 - f for f in fills)
    assert padding == 0


def test_pack_odd_rows(spark, make_docs):
    rows = [r for i, r in enumerate(ODD_ROWS) if r[0] not in (None, 4)]
    got = pack_squares.digest(pack_squares.pack(make_docs(rows))).collect()
    check_pieces(got, rows)
    every = pack_squares.pack(make_docs(ODD_ROWS)).collect()
    assert sum(r.length for r in every) == sum(len(expected_ids(t)) for _, t in ODD_ROWS)
    assert pack_squares.pack(make_docs([])).collect() == []


def test_placement_minimises_sum_of_squares():
    rng = random.Random(5)
    placed, counts = [], {}
    packer = pack_squares.SquaresPacker(16, placed.append)

    def total(c):
        return sum(v * v for v in c.values())

    for k in range(400):
        size = rng.randint(1, 15)
        options = []
        for h in [0, *[h for h in range(1, 16) if counts.get(h)]]:
            if h + size <= 16:
                after = dict(counts)
                if h:
                    after[h] -= 1
                if h + size < 16:
                    after[h + size] = after.get(h + size, 0) + 1
                options.append(total(after))
        packer.add(k, np.zeros(size, np.uint32))
        counts = {h: len(x) for h, x in enumerate(packer.open) if x}
        assert total(counts) == min(options)


def test_best_fit_decreasing_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        width = rng.choice([7, 16, 33, 100])
        sizes = [rng.randint(1, width) for _ in range(rng.randint(0, 60))]
        room, expected = [], []
        for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [j for j in range(len(room)) if room[j] >= sizes[i]]
            if fits:
                best = min(room[j] for j in fits)
                room[next(j for j in fits if room[j] == best)] -= sizes[i]
            else:
                room.append(width - sizes[i])
        rows = pack_bestfit.best_fit_decreasing(sizes, width)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(width - sum(sizes[i] for i in r) for r in rows) == sorted(room)


def test_packed_matrix_round_trip(spark, sample, make_docs, tmp_path):
    path = os.path.join(tmp_path, "matrix")
    odd = [r for r in ODD_ROWS if r[0] not in (None, 4)]
    for texts, width in (([(r[0], r[1]) for r in sample], 2048), (odd, 64), ([], 64)):
        out = f"{path}{width}-{len(texts)}"
        pack_bestfit.write_matrix(make_docs(texts), out, width=width, block_docs=50)
        back, used, rows = {}, 0, spark.read.parquet(out).collect()
        for r in rows:
            ids, positions = (np.frombuffer(x, "<u2") for x in (r.ids, r.positions))
            assert len(ids) == len(positions) == width and r.cu_lengths[-1] == r.n_tokens <= width
            used += r.n_tokens
            for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_lengths, r.cu_lengths[1:]):
                assert positions[a:b].tolist() == list(range(b - a))
                back.setdefault(d, {})[s] = ids[a:b].tolist()
            assert positions[r.n_tokens:].tolist() == list(range(width - r.n_tokens))
        for d, text in texts:
            assert sum((back[d][s] for s in sorted(back[d])), []) == expected_ids(text)[:-1] + [50256]
        if width == 2048:
            assert used > 0.95 * width * len(rows)


def test_ids_that_do_not_fit_are_an_error(spark, make_docs):
    import pytest

    docs = make_docs([(1, "a few words")])
    with pytest.raises(Exception, match="doesn't fit"):
        pack_bestfit.packed_matrix(docs, end_id=70_000).collect()
    assert pack_bestfit.packed_matrix(docs, end_id=70_000, dtype="<u4").count() == 1
