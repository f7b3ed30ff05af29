import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from llm.rows import ODD_ROWS, SF
from tabprobe.llm import pseudonyms as ps
from tabprobe.llm import queries

F = ps.Feistel(b"k")


def test_permutations_are_bijective_keyed_and_undone():
    for n in (1, 2, 3, 7, 10, 97, 1000):
        image = [F.permute("x", n, i) for i in range(n)]
        assert sorted(image) == list(range(n))
        assert [F.permute("x", n, y, undo=True) for y in image] == list(range(n))
    assert [F.permute("x", 1000, i) for i in range(9)] != [ps.Feistel(b"l").permute("x", 1000, i) for i in range(9)]
    assert [F.permute("x", 1000, i) for i in range(9)] != [F.permute("y", 1000, i) for i in range(9)]


def card(n):
    return f"{n:015d}" + ps.luhn_digit(f"{n:015d}")


@settings(max_examples=150, deadline=None)
@given(st.integers(3 * 10 ** 14, 6 * 10 ** 14), st.integers(0, 2 ** 32 - 1), st.integers(0, 10 ** 10 - 1),
       st.dates(dt.date(1900, 1, 1), dt.date(2099, 12, 31)), st.from_regex(r"[a-z][a-z0-9.]{3,12}[a-z]@[a-z]{3,8}[0-9]\.com", fullmatch=True))
def test_formats_kept_and_undone(n, ip, phone, day, mail):
    p = f"{phone:010d}"
    values = [card(n), ".".join(map(str, ip.to_bytes(4, "big"))), f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}",
              day.isoformat(), day.strftime("%d.%m.%Y"), mail]
    text = "a " + " b ".join(values) + " c"
    out, counts = ps.replace_values(text, F)
    got = re.fullmatch("a (.*)", out)[1][:-2].split(" b ")
    assert dict(zip(ps.KINDS, counts)) == {"email": 1, "iban": 0, "ip": 1, "date": 2, "ssn": 0, "phone": 1, "card": 1}
    assert ps.luhn_digit(got[0][:-1]) == got[0][-1] and got[0][0] == values[0][0] and len(got[0]) == 16
    assert all(0 <= int(o) <= 255 for o in got[1].split("."))
    assert re.fullmatch(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", got[2])
    assert dt.date.fromisoformat(got[3]) == dt.datetime.strptime(got[4], "%d.%m.%Y").date()
    assert re.sub("[a-z]", "a", re.sub("[0-9]", "0", got[5][:-4])) == re.sub("[a-z]", "a", re.sub("[0-9]", "0", mail[:-4]))
    assert ps.replace_values(out, F, undo=True)[0] == text


def test_same_value_same_pseudonym_in_other_layouts():
    one = ps.replace_values(f"x {card(412345678901234)} y", F)[0].split()[1]
    spaced = " ".join(card(412345678901234)[i:i + 4] for i in range(0, 16, 4))
    two = ps.replace_values(f"pay {spaced}, now", F)[0]
    assert "".join(re.findall("[0-9]", two)) == one
    a = ps.replace_values("call +1 (743) 555-3824 now", F)[0]
    b = ps.replace_values("call 743-555-3824 now", F)[0]
    assert re.findall("[0-9]", a)[1:] == re.findall("[0-9]", b)


def test_invalid_values_and_words_stay():
    for text in ("card 4785380592391130 no", "ip 300.1.2.3 no", "2023-02-30 no", "000-12-3456", "version 1.2.3",
                 "a8fb1e4c565a0eb63815530a948bdde", "", "plain words", "GB82WEST12345698765431", "1234", "3.14159 2.5"):
        assert ps.replace_values(text, F) == (text, [0] * len(ps.KINDS))
    for good in ("GB82WEST12345698765432", "078-05-1120", "12/31/1999", "31/12/1999", "+49 30 1234567"):
        out, counts = ps.replace_values(f"x {good} y", F)
        assert sum(counts) == 1 and out != f"x {good} y" and len(out) == len(good) + 4
        assert ps.replace_values(out, F, undo=True)[0] == f"x {good} y"


def test_query_and_odd_rows(spark, sample, make_docs):
    got = {r.doc_id: r for r in queries.SPARK["op4_pseudonyms"](spark, SF).collect()}
    f = ps.Feistel(queries.DEMO_KEY)
    for doc_id, text, *_ in sample:
        want, counts = ps.replace_values(text, f)
        assert got[doc_id].text == want and list(got[doc_id])[2:] == counts
        assert len(re.findall("@", want)) == len(re.findall("@", text))
    values = [(90, f"id {card(412345678901234)}"), (91, f"again {card(412345678901234)}."), (92, "1.2.3.4 " * 20000)]
    docs = make_docs(ODD_ROWS + values).withColumn("n_ip", ps.F.lit("clash"))
    out = ps.pseudonymised(docs, key=b"k").collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(ODD_ROWS) + 3 and by[1].text is None and by[2].text == "" and by[92].n_ip_ == 20000
    assert {r.n_ip for r in out} == {"clash"}
    assert re.search("[0-9]{16}", by[90].text)[0] == re.search("[0-9]{16}", by[91].text)[0] != card(412345678901234)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    back = ps.pseudonymised(ps.pseudonymised(docs, key=b"k"), key=b"k", undo=True).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in back) == sorted((str(d), str(t)) for d, t in ODD_ROWS + values)
    assert ps.pseudonymised(make_docs([]), key=b"k").collect() == []


def changed(value, kind, lead="x ", tail=" y"):
    out, counts = ps.replace_values(lead + value + tail, F)
    assert {k: n for k, n in zip(ps.KINDS, counts) if n} == {kind: 1}
    assert out.startswith(lead) and out.endswith(tail) and out != lead + value + tail
    assert ps.replace_values(out, F, undo=True)[0] == lead + value + tail
    return out[len(lead):len(out) - len(tail)]


def test_dates_before_t_and_a_time():
    day = changed("2021-03-05", "date")
    for tail in ("T10:00:00Z", "T10:00", "t10:00:00+02:00", "T100000Z", "T10Z", " 10:00"):
        assert changed("2021-03-05", "date", tail=tail) == day
    changed("05.03.2021", "date", tail="T10:00")
    for text in ("2021-03-05Total", "2021-03-05T1"):
        assert ps.replace_values(text, F) == (text, [0] * len(ps.KINDS))


def test_printed_ibans():
    one = changed("GB82WEST12345698765432", "iban")
    for value in ("GB82 WEST 1234 5698 7654 32", "GB82 WEST 123456 98765432"):
        for tail in (" y", ", BIC", " EUR 100", " ABCD 1234", "."):
            out = changed(value, "iban", tail=tail)
            assert out.replace(" ", "") == one and [c == " " for c in out] == [c == " " for c in value]
    austrian = changed("AT61 1904 3002 3457 3201", "iban", tail=" EUR")
    assert austrian.replace(" ", "") == changed("AT611904300234573201", "iban")
    body = "ABCD1234567"
    value = f"ZZ{98 - ps.iban_remainder('ZZ00' + body):02d}{body}"
    assert changed(" ".join(value[i:i + 4] for i in range(0, 15, 4)), "iban").replace(" ", "") == changed(value, "iban")
    text = "GB82 WEST 1234 5698 7654 3"
    assert ps.replace_values(text, F)[1][ps.KINDS.index("iban")] == 0


def test_phones_with_a_leading_one():
    digits = re.findall("[0-9]", changed("743-555-3824", "phone"))
    for value in ("1-743-555-3824", "1.743.555.3824", "1 743 555 3824", "1-(743) 555-3824", "1(743) 555-3824",
                  "1 (743) 555-3824"):
        out = changed(value, "phone")
        assert out[0] == "1" and re.findall("[0-9]", out)[1:] == digits
        assert re.sub("[0-9]", "0", out) == re.sub("[0-9]", "0", value)


def test_dates_of_one_digit():
    seen = set()
    for value in ("3/5/2021", "12/5/2021", "3/15/2021", "03/5/2021", "25/3/2021", "25/12/2021", "3.5.2021", "13.5.2021", "3-5-2021"):
        out = changed(value, "date")
        assert [len(x) for x in re.split("[/.-]", out)] == [len(x) for x in re.split("[/.-]", value)]
        seen.add(out)
    assert len(seen) == 9
    assert int(changed("25/3/2021", "date").split("/")[0]) > 12  # still read day first


def test_time_in_proportion_to_length():
    import time

    unit = " ".join(["10.20.30.40", "a.b7@example.com", "2021-03-05", "3/5/2021", "078-05-1120", "743-555-3824",
                     card(412345678901234), "GB82 WEST 1234 5698 7654 32", "plain words of a log line, 12 and 13"]) + "\n"
    took = []
    for size in (100_000, 5_000_000):
        text = unit * (size // len(unit))
        t = time.process_time()
        out, counts = ps.replace_values(text, F)
        took.append((time.process_time() - t) / len(text))
        assert all(c == size // len(unit) * (2 if k == "date" else 1) for k, c in zip(ps.KINDS, counts))
    assert took[1] < 2 * took[0] + 1e-7
    for run in ("1" * 10 ** 6, "a" * 10 ** 6, "1." * 10 ** 6, "a@" * 10 ** 5, "1-" * 10 ** 6, "AB12" * 10 ** 5):
        t = time.process_time()
        ps.replace_values(run, F)
        assert time.process_time() - t < 20


class Reference:
    """The permutations and four of the formats, written again from their description."""

    def __init__(self, key):
        import hashlib

        self.hash = hashlib.blake2b
        self.key = self.hash(key, digest_size=32).digest()

    def permute(self, kind, n, x):
        side = 1
        while side * side < n:
            side += 1
        bits = side.bit_length() + 64
        size = -(-bits // 8)

        def draw(i, value):
            text = f"{i}|{value}|{kind}|{n}".encode()
            blocks = [self.hash(text + f"|{c}".encode(), key=self.key, digest_size=64).digest() for c in range(-(-size // 64))]
            return int.from_bytes(b"".join(blocks)[:size], "big") % side
        while True:
            halves = [x // side, x % side]
            for i in range(8):
                halves[i % 2] = (halves[i % 2] + draw(i, halves[1 - i % 2])) % side
            x = halves[0] * side + halves[1]
            if x < n:
                return x

    def ip(self, text):
        n = 0
        for o in text.split("."):
            n = n * 256 + int(o)
        n = self.permute("ip", 2 ** 32, n)
        return ".".join(str(n // 256 ** i % 256) for i in (3, 2, 1, 0))

    def ssn(self, text):
        areas = [a for a in range(1, 900) if a != 666]
        a, g, t = map(int, text.split("-"))
        n = self.permute("ssn", 898 * 99 * 9999, (areas.index(a) * 99 + g - 1) * 9999 + t - 1)
        return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"

    def date(self, text):
        first = dt.date(1900, 1, 1)
        n = self.permute("date", (dt.date(2100, 1, 1) - first).days, (dt.date.fromisoformat(text) - first).days)
        return (first + dt.timedelta(days=n)).isoformat()

    def card(self, text):
        body = text[0] + f"{self.permute('card' + text[0], 10 ** 14, int(text[1:-1])):014d}"
        total = sum(sum(divmod(int(c) * (1 + (i + 1) % 2), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)


def test_against_a_reference_written_by_hand(spark, make_docs):
    import random

    rng, ref = random.Random(5), Reference(b"k")
    rows, want = [], []
    for k in range(60):
        values = [("ip", ".".join(str(rng.randrange(256)) for _ in range(4))),
                  ("ssn", f"{rng.choice([1, 665, 667, 899, rng.randint(2, 600)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"),
                  ("date", (dt.date(1900, 1, 1) + dt.timedelta(days=rng.randrange(73049))).isoformat()),
                  ("card", card(rng.randint(3 * 10 ** 14, 6 * 10 ** 14)))]
        rng.shuffle(values)
        rows.append((k, "see " + ", then ".join(v for _, v in values) + "."))
        want.append((k, "see " + ", then ".join(getattr(ref, kind)(v) for kind, v in values) + "."))
    got = ps.pseudonymised(make_docs(rows), key=b"k").collect()
    assert sorted((r.doc_id, r.text) for r in got) == want
