import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import fill_middle, queries


def units(text):
    """Units by a loop over characters."""
    out = []
    for c in text:
        letter = "a" <= c <= "z" or "A" <= c <= "Z"
        if letter and out and out[-1][-1:].isalpha() and out[-1][-1:].isascii():
            out[-1] += c
        else:
            out.append(c)
    return out


def expected(doc_id, text):
    text = text or ""
    u = units(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PIECES = st.sampled_from(["ab", "Z", " ", "\n", "é", "漢", "<P", "<S>", "<", "P>", "<M", ">", "\U0001f600", "1", "S>"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join), st.integers(0, 1000))
def test_text_by_text(text, doc_id):
    n, form, prefix, middle, output = fill_middle.transformed(text, doc_id)
    assert (n, form, prefix, middle, output.decode()) == expected(doc_id, text)
    assert fill_middle.restore(output, form).decode() == text


def test_cuts_in_every_block(monkeypatch):
    monkeypatch.setattr(fill_middle, "SCAN_BYTES", 7)
    rnd = random.Random(3)
    for doc_id in range(300):
        text = "".join(rnd.choice(["abc", " ", "é", "漢", "x", "9"]) for _ in range(rnd.randrange(60)))
        n, form, prefix, middle, output = fill_middle.transformed(text, doc_id)
        assert (n, form, prefix, middle, output.decode()) == expected(doc_id, text)


def check(rows, texts):
    want = sorted(str((d, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(),
                       hashlib.sha256((t or "").encode()).hexdigest()))
                  for d, t in texts for n, form, p, m, out in [expected(d, t)])
    assert sorted(str(tuple(r)) for r in rows) == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = queries.op13_fill_middle(spark, SF).collect()
    check(rows, texts)
    assert {"plain", "psm", "spm"} == {r.form for r in rows}


def test_odd_rows(spark, make_docs):
    rows = [*ODD_ROWS, (11, "a <P> b"), (12, "<M>"), (13, "wörd " * 300_000)]
    docs = make_docs(rows).withColumnsRenamed({"lang": "form", "source": "output"})
    check(fill_middle.digest(fill_middle.restored(fill_middle.transform(docs))).collect(), rows)
    assert fill_middle.digest(fill_middle.restored(fill_middle.transform(docs.limit(0)))).collect() == []


def test_shares_are_parameters(spark, make_docs):
    docs = make_docs([(i, f"text number {i} of many") for i in range(200)])
    forms = {r.form for r in fill_middle.transform(docs, percent=100, spm_percent=100).collect()}
    assert forms == {"spm"}
    assert {r.form for r in fill_middle.transform(docs, percent=0).collect()} == {"plain"}
