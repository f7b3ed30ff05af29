"""Column expressions used across the library (all JVM-side built-ins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that define the split protocol.
SPLIT_SEED_BASE = 20260101
SEED_MODULUS = 2**32 - 1
HOLDOUT_TEST_SIZE = 0.2


def seed_for(key: Column) -> Column:
    """Stable per-dataset seed: (base + int(first 8 hex of sha256(key), 16)) mod (2^32-1)."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.pmod(head + F.lit(SPLIT_SEED_BASE), F.lit(SEED_MODULUS)).cast("long")


def seed_for_py(key: str) -> int:
    import hashlib

    return (SPLIT_SEED_BASE + int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)) % SEED_MODULUS


def _timestamp_text(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss.SSSSSS; midnights, as of dates, without a formatter."""
    day = c.cast("date")
    plain = (c == day.cast("timestamp_ntz")) & (F.year(day) > 0) & (F.year(day) < 10000)
    return F.when(plain, F.concat(day.cast("string"), F.lit(" 00:00:00.000000"))) \
        .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _key_pieces(df: DataFrame, name: str) -> list[Column]:
    """Tag, length, colon and text of one row-key column, each NULL or not as the column is."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, T.TimestampType):
        tag, text = "t", F.unix_micros(c).cast("string")
    elif isinstance(dt, T.TimestampNTZType):
        tag, text = "c", _timestamp_text(c)
    elif isinstance(dt, T.DateType):
        tag, text = "c", F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        tag, text = "d", c.cast("string")
    elif isinstance(dt, T.IntegralType):
        tag, text = "i", c.cast("string")
    else:
        tag, text = "s", c.cast("string") if not isinstance(dt, (T.ArrayType, T.MapType, T.StructType)) \
            else F.to_json(F.struct(c))
    return [F.lit(tag), F.length(text).cast("string"), F.lit(":"), text]


def key_part(df: DataFrame, name: str) -> Column:
    """Lossless text of one row-key column: a type tag, the length, the value.

    Dates and timestamps keep their microseconds and doubles the shortest
    digits that give them back; a NULL is ``n``.  Tags and lengths keep parts
    apart, so different keys never share a text.
    """
    return F.coalesce(F.concat(*_key_pieces(df, name)), F.lit("n"))


def key_text(df: DataFrame, key_cols: list[str]) -> Column:
    """The key parts put together: in one go where none is NULL."""
    whole = F.concat(*[p for c in key_cols for p in _key_pieces(df, c)])
    return F.coalesce(whole, F.concat(*[key_part(df, c) for c in key_cols]))


def row_hash(df: DataFrame, key_cols: list[str], seed) -> Column:
    """sha256 hex of ``seed:key text``; the split / sample ordering key."""
    seed = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha2(F.concat(seed, F.lit(":"), key_text(df, key_cols)), 256)


def finite_or_null(c: Column) -> Column:
    """NaN / +-inf -> NULL (missing), everything else as double."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)


def initials(key: Column) -> Column:
    """Initials of hyphen-separated words, upper-cased ("california-housing" -> "CH")."""
    return F.upper(F.array_join(F.transform(F.split(key, "-"), lambda w: F.substring(w, 1, 1)), ""))


def fmt_score(v: Column) -> Column:
    """3 decimals, scientific ``%.2e`` when |v| >= 1000."""
    return F.when(v.isNull(), F.lit(None)).when(F.abs(v) >= 1000, F.format_string("%.2e", v)) \
        .otherwise(F.format_string("%.3f", v))


def fmt_seconds(s: Column) -> Column:
    """Seconds, or minutes once >= 120 s."""
    return F.when(s.isNull(), F.lit(None)).when(s >= 120, F.format_string("%.1f min", s / 60)) \
        .otherwise(F.format_string("%.1f s", s))


def fmt_before_after(before: Column, after: Column, missing: str = "—") -> Column:
    """"before -> after" cell, a dash when either side is missing."""
    return F.coalesce(F.format_string("%.0f -> %.0f", before, after), F.lit(missing))


def first_error_line(e: Column, width: int = 120) -> Column:
    return F.substring(F.split(e, "\n").getItem(0), 1, width)


def sector_family(sector: Column) -> Column:
    """Coarse sector family by substring rules."""
    # fixed values of the coverage rule
    rules = (("finance", ("finance", "telco")), ("healthcare", ("health",)),
             ("physical-science", ("material", "physical", "chem", "energy")))
    s = F.lower(sector)
    out = F.lit("general")
    for family, parts in reversed(rules):
        out = F.when(reduce(lambda a, b: a | b, [s.contains(p) for p in parts]), family).otherwise(out)
    return out


def json_row(*cols: str) -> Column:
    return F.to_json(F.struct(*cols))
