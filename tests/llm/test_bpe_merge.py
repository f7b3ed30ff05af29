import hashlib
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import bpe_merge, queries

NAME = "byte_bpe_50k.json"


def library():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    if not hasattr(library, "t"):
        library.t = Tokenizer.from_file(path(NAME))
    return library.t


@pytest.fixture(scope="module")
def encoder():
    return bpe_merge.Encoder(NAME)


def same(encoder, text):
    ids = encoder.encode([text])[0]
    assert ids.tolist() == library().encode(text, add_special_tokens=False).ids
    assert bpe_merge.decode(encoder.v, ids) == library().decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(exclude_categories=("Cs",)),
                              st.sampled_from(" \t\n\r'’s—…aeiotlrve0129 ­\u0085 　ßıſK")), max_size=80))
def test_any_text(text):
    if not hasattr(test_any_text, "encoder"):
        test_any_text.encoder = bpe_merge.Encoder(NAME)
    same(test_any_text.encoder, text)


def test_every_assigned_character(encoder):
    """Words are split alike at every code point, next to letters, digits, signs and spaces."""
    points = [chr(c) for c in range(0x110000)
              if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")
              and not 0x3400 <= c < 0xD7B0 and not 0x20000 <= c < 0x40000] + ["漢", "한", "", "͸"]
    for i in range(0, len(points), 2000):
        text = "".join(f"a{c}1{c}!{c}  {c} {c}{c}b" for c in points[i:i + 2000])
        got = [w for part in encoder.v.split(text) for w in part]
        assert got == encoder.v._split_by_library(text)


def test_special_tokens(encoder):
    for text in ("<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|> ", "<|endof", "  <|endoftext|>\n"):
        same(encoder, text)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aeioutnsr", "aeiou nst ", "é漢ab", "a", " ", "=-", "0123456789", "\n ", "՘a"])
def test_long_words(encoder, alphabet):
    """Rank by rank and round by round give the library's ids."""
    rnd = random.Random(1)
    for n in (1, 2, 255, 256, 257, 1000, 9000):
        same(encoder, "".join(rnd.choice(alphabet) for _ in range(n)))


def test_both_ways_of_merging_agree(encoder):
    rnd = random.Random(2)
    for n in (1, 2, 3, 30, 200):
        for alphabet in (b"ab", b"etaoin", bytes(range(256))):
            word = np.array([rnd.choice(alphabet) for _ in range(n)])
            symbols = encoder.v.byte_ids[word]
            ids, lengths = bpe_merge.merge_rounds(encoder.v, symbols, np.array([n]))
            assert ids.tolist() == bpe_merge.merge_by_rank(encoder.v, symbols).tolist() and lengths.tolist() == [len(ids)]


def test_long_text_is_cut_where_words_end(encoder, monkeypatch):
    monkeypatch.setattr(bpe_merge, "SPLIT_CHARS", 50)
    monkeypatch.setattr(bpe_merge, "BATCH_WORDS", 20)
    monkeypatch.setattr(bpe_merge, "KEEP_BYTES", 2000)
    rnd = random.Random(4)
    parts = ["word", " ", "  ", "\n", "it's", "12", "!?", " a", "é", "<|endoftext|>"]
    for _ in range(50):
        same(encoder, "".join(rnd.choice(parts) for _ in range(400)))


def test_time_grows_with_length(encoder):
    import time

    rnd = random.Random(6)
    took = []
    for n in (200_000, 800_000):
        text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        t = time.process_time()
        encoder.encode([text])
        took.append(time.process_time() - t)
    assert took[1] < 12 * took[0]


def check(rows, texts):
    want = []
    for d, t in texts:
        ids = library().encode(t or "", add_special_tokens=False).ids
        text = library().decode(ids, skip_special_tokens=False)
        want.append(str((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(text.encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in rows) == sorted(want)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(queries.op11_bpe_merge(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, make_docs):
    rows = [*ODD_ROWS, (20, "x" * 100_000), (21, "many words " * 100_000), (22, " " * 70_000)]
    docs = make_docs(rows).withColumnsRenamed({"lang": "ids", "source": "n_tokens"})
    check(bpe_merge.digest(bpe_merge.decoded(bpe_merge.encoded(docs))).collect(), rows)
    assert bpe_merge.digest(bpe_merge.decoded(bpe_merge.encoded(docs.limit(0)))).collect() == []


def test_bytes_that_are_no_text(encoder):
    ids = np.array([encoder.v.byte_ids[0xE6], 10 ** 6, encoder.v.byte_ids[0x41]], np.uint32)
    assert bpe_merge.decode(encoder.v, ids) == "�A"


def test_vocabularies_that_merge_otherwise_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe_merge.vocabulary("word_bpe_49k.json")
