"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern and validated: card numbers (Luhn), IBANs
(modulo 97), IPv4 addresses (octets), social security numbers (area, group and
serial rules), telephone numbers, calendar dates, and e-mail addresses.  A
valid value is numbered within its format, the number is permuted by a keyed
Feistel network over exactly that many values (cycle walking keeps it in
range), and the pseudonym is written back in the layout of the original: same
length, separators and letter case, and again valid.  The permutation depends on
the key and the kind only, so equal values have equal pseudonyms in every
document, different values have different ones, and the key holder can undo it.

A date whose month and day could change places is read month first, and stays one
that is read so; one that can only be read day first stays such a one.  Dates
written with one digit ("3/5/2021") are permuted among the dates that are written
with as many.  Both have pseudonyms of their own, other than those of the same day
in another form.

Each text is rewritten where it lies, in time in proportion to its length; nothing
is shuffled.

Edge cases: a null text stays null; empty texts and texts without values stay
as they are; repeated rows get equal results; all other columns keep their values,
and a count whose name is taken gets underscores after it; an empty table gives
no row.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import free_name

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
#: chunk of texts that leaves a task at once
FLUSH_CHARS = 8 << 20


class Feistel:
    """Keyed permutations of ``range(n)`` for any n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.walk = lru_cache(maxsize=1 << 16)(self._walk)

    def _round(self, tweak: str, i: int, value: int, modulus: int) -> int:
        size = (modulus.bit_length() + 64 + 7) // 8
        data = b"%d|%d|" % (i, value) + tweak.encode()
        out, counter = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(data + b"|%d" % counter, key=self.key, digest_size=64).digest()
            counter += 1
        return int.from_bytes(out[:size], "big") % modulus

    def _once(self, tweak: str, side: int, x: int, undo: bool) -> int:
        left, right = divmod(x, side)
        for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS)):
            sign = -1 if undo else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left, side)) % side
            else:
                left = (left + sign * self._round(tweak, i, right, side)) % side
        return left * side + right

    def _walk(self, kind: str, n: int, x: int, undo: bool) -> int:
        if n < 2:
            return x
        side, tweak = isqrt(n - 1) + 1, f"{kind}|{n}"
        x = self._once(tweak, side, x, undo)
        while x >= n:
            x = self._once(tweak, side, x, undo)
        return x

    def permute(self, kind: str, n: int, x: int, undo: bool = False) -> int:
        return self.walk(kind, n, x, undo)


def luhn_digit(payload: str) -> str:
    """The check digit that follows ``payload``."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _in_layout(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced, one by one."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _permute_digits(f: Feistel, kind: str, digits: str, undo: bool) -> str:
    n = len(digits)
    return f"{f.permute(kind, 10 ** n, int(digits or 0), undo):0{n}d}" if n else ""


def _permute_classes(f: Feistel, kind: str, text: str, undo: bool) -> str:
    """Letters become letters and digits digits; other characters stay."""
    bases = [10 if "0" <= c <= "9" else 26 if "a" <= c.lower() <= "z" and c.isascii() else 0 for c in text]
    shape = "".join("d" if b == 10 else "a" if b else c for b, c in zip(bases, text))
    n, x = 1, 0
    for c, b in zip(text.lower(), bases):
        if b:
            n, x = n * b, x * b + (int(c) if b == 10 else ord(c) - 97)
    x = f.permute(f"{kind}|{shape}", n, x, undo)
    out = list(text)
    for i in reversed(range(len(text))):
        if bases[i]:
            x, r = divmod(x, bases[i])
            c = str(r) if bases[i] == 10 else chr(97 + r)
            out[i] = c.upper() if text[i].isupper() else c
    return "".join(out)


def _email(f, m, undo):
    local, _, domain = m[0].rpartition("@")
    name, dot, top = domain.rpartition(".")
    return f"{_permute_classes(f, 'email', local, undo)}@{_permute_classes(f, 'domain', name, undo)}{dot}{top}"


def _iban(f, m, undo):
    value = m[0].replace(" ", "")
    if iban_remainder(value) != 1:
        return None
    account = _permute_classes(f, "iban" + value[:2], value[4:], undo)
    it = iter(f"{value[:2]}{98 - iban_remainder(value[:2] + '00' + account):02d}{account}")
    return "".join(c if c == " " else next(it) for c in m[0])


def _ip(f, m, undo):
    octets = m[0].split(".")
    if any(int(o) > 255 for o in octets):
        return None
    x = f.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, octets)), "big"), undo)
    return ".".join(map(str, x.to_bytes(4, "big")))


@lru_cache(maxsize=None)
def _days(one_digit_month: bool, one_digit_day: bool, day_first: bool) -> list[int]:
    """The days that a form of date can hold, in order: a month or day of one digit is
    below 10, and a date that must be read day first has a day above 12."""
    out = []
    for n in range(FIRST_DAY, LAST_DAY + 1):
        d = dt.date.fromordinal(n)
        if not (one_digit_month and d.month > 9 or one_digit_day and d.day > 9 or day_first and d.day <= 12):
            out.append(n)
    return out


def _date(f, m, undo):
    a, mark, b, c = m["d1"], m["mark"], m["d2"], m["d3"]
    orders = [("ymd", a, b, c)] if len(a) == 4 else [("mdy", c, a, b), ("dmy", c, b, a)]
    if mark == "." and len(a) != 4:
        orders = orders[1:]
    for form, y, month, day in orders:
        try:
            day_number = dt.date(int(y), int(month), int(day)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day_number <= LAST_DAY:
            return None
        short, day_first = (len(month) == 1, len(day) == 1), form == "dmy" and mark != "."
        days = _days(*short, day_first)
        kind = "date" + "".join(map(str, map(int, (*short, day_first)))) if any((*short, day_first)) else "date"
        x = f.permute(kind, len(days), bisect_left(days, day_number), undo)
        to = dt.date.fromordinal(days[x])
        parts = {"y": f"{to.year:04d}", "m": f"{to.month:0{len(month)}d}", "d": f"{to.day:0{len(day)}d}"}
        return mark.join(parts[c] for c in form)
    return None


def _ssn(f, m, undo):
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = f.permute("ssn", len(areas) * 99 * 9999, x, undo)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(f, m, undo):
    code, rest = m["code"] or m["one"] or "", m["rest"]
    digits = _digits(rest)
    if not 6 <= len(digits) <= 13 or len(_digits(code)) + len(digits) < 10:
        return None
    return code + _in_layout(rest, _permute_digits(f, f"phone{len(digits)}", digits, undo))


def _card(f, m, undo):
    digits = _digits(m[0])
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    payload = digits[0] + _permute_digits(f, "card" + digits[0], digits[1:-1], undo)
    return _in_layout(m[0], payload + luhn_digit(payload))


#: characters of an IBAN by country
IBAN_LENGTHS = {c: int(n) for c, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 "
    "DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HN:28 HR:21 HU:28 "
    "IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 "
    "MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 "
    "SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30").split())}


class Ibans:
    """Finds IBANs in one piece and with single spaces.  A spaced one ends where
    its country's length is reached (in groups of four, where these end, if the
    country isn't known), so that words after it aren't taken for a part of it."""

    start = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}")
    piece = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?!\w)")
    spaced = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
    fours = re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?!\w)")

    def finditer(self, text: str):
        for m in self.start.finditer(text):
            found = self.piece.match(text, m.start())
            length = IBAN_LENGTHS.get(m[0][:2])
            if not found and length:
                end = m.end()
                for _ in range(length - 4):
                    end += text[end:end + 1] == " "
                    end += 1
                if not re.match(r"\w", text[end:end + 1]):
                    found = self.spaced.fullmatch(text, m.start(), end)
            elif not found:
                found = self.fours.match(text, m.start())
            if found:
                yield found


_D = "[0-9]"
PATTERNS = {
    "email": (re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    "iban": (Ibans(), _iban),
    "ip": (re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])"), _ip),
    "date": (re.compile(r"(?<![\w/.-])(?P<d1>[0-9]{4}(?=[-/.][0-9]{2}[-/.][0-9]{2}(?![0-9]))|[0-9]{1,2})(?P<mark>[-/.])"
                        r"(?P<d2>[0-9]{1,2})(?P=mark)(?P<d3>(?:[0-9]{4}|(?<=[0-9]{4}[-/.][0-9]{2}[-/.])[0-9]{2}))"
                        # T and a time may follow
                        r"(?:(?!\w|[-/.][0-9])|(?=[Tt][0-9]{2}(?::?[0-9]{2}|[Zz]|(?!\w))))"), _date),
    "ssn": (re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _ssn),
    "phone": (re.compile(r"(?<![\w.+-])(?:(?P<code>\+[0-9]{1,3}[ .-]?)|(?P<one>1(?:[ .-]|(?=\())))?"
                         r"(?P<rest>(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w|[.-][0-9])"
                         r"|(?(code)\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,8}){1,4}|(?!)))(?!\w|[.-][0-9])"), _phone),
    "card": (re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?!\w|[.-][0-9])"), _card),
}
_ANY_DIGIT = re.compile(_D)


def replace_values(text: str, f: Feistel, undo: bool = False) -> tuple[str, list[int]]:
    """The text with pseudonyms, and how many values of each of ``KINDS``."""
    counts = [0] * len(KINDS)
    digit, at = _ANY_DIGIT.search(text), "@" in text
    if not digit and not at:
        return text, counts
    spans: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for k, kind in enumerate(KINDS):
        if not (at if kind == "email" else digit):
            continue
        pattern, change = PATTERNS[kind]
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(taken[a:b]):
                continue
            new = change(f, m, undo)
            if new is not None:
                counts[k] += 1
                spans.append((a, b, new))
                taken[a:b] = b"\1" * (b - a)
    out, end = [], 0
    for a, b, new in sorted(spans):
        out += text[end:a], new
        end = b
    return "".join(out) + text[end:], counts


def pseudonymised(docs: DataFrame, *, key: bytes, undo: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten (and ``n_chars`` adjusted where there is
    one) and a count column ``n_<kind>`` for each kind."""
    names = docs.columns
    counts = [free_name(names, f"n_{k}") for k in KINDS]
    source = docs.withColumn("text", F.col("text").cast("string"))
    at = names.index("text")
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in source.schema.fields]
    fields += [f"`{c}` bigint" for c in counts]

    def run(batches):
        f = Feistel(key)
        for batch in batches:
            done, s, held = [], 0, 0

            def part(a, b):
                cut = batch.slice(a, b - a)
                columns = list(cut.columns)
                columns[at] = pa.array([t for t, _ in done], columns[at].type)
                columns += [pa.array(c, pa.int64()) for c in zip(*(n for _, n in done))]
                return pa.RecordBatch.from_arrays(columns, [*names, *counts])

            for i, cell in enumerate(batch.column(at)):
                text = cell.as_py()
                done.append((text, [0] * len(KINDS)) if text is None else replace_values(text, f, undo))
                held += len(text or "")
                if held > FLUSH_CHARS:
                    yield part(s, i + 1)
                    done, s, held = [], i + 1, 0
            if done:
                yield part(s, batch.num_rows)

    out = source.mapInArrow(run, ", ".join(fields))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
