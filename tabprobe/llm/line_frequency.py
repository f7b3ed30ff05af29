"""Cross-document line frequency, in DataFrame operations only.

A line is normalised (white space trimmed and collapsed, A-Z lower-cased,
digits made 0) and hashed.  For each host, the documents with different texts
that hold a line are counted, so copies of one text count once.  Lines found in
more than ``max_docs`` of them are boilerplate and are removed; a document left
with less than ``min_kept`` of its words is depleted and is rejected.

Hot lines: (host, line, text) triples are made distinct before the shuffle and
counted in two steps, so a line that a third of all documents share is combined
by every task before it travels; the join with frequent lines is salted by
text.  Nothing is broadcast by hand.

Edge cases: a null text has no words and no lines; a null host is a host of its
own; repeated rows get equal results; empty tables give no row; other columns
are ignored.  Lines and texts are told apart by 64-bit hashes; windows of a
document by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprobe.llm.common import text_key, written

_BLANKS = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]+"
SALTS = 16


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, _SPACE))


def base_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words and base_failed of the whole text."""
    df = docs.select(*keep, F.col("text").alias("t"))
    df = df.select(*keep, "t", _words(F.col("t")).alias("w"))
    df = df.withColumn("n", F.size("w"))
    # windows by hash and position, so that sorting puts equal windows together;
    # neighbours of one hash are compared word by word
    df = df.withColumn("k", F.expr(
        "CASE WHEN n < 3 THEN CAST(array() AS ARRAY<STRUCT<h: BIGINT, i: INT>>) ELSE sort_array(transform("
        "sequence(0, n - 3), i -> named_struct('h', xxhash64(w[i], w[i + 1], w[i + 2]), 'i', i))) END"))
    same = ("coalesce(x.h = get(k, {j}).h AND w[x.i] = w[get(k, {j}).i] AND w[x.i + 1] = w[get(k, {j}).i + 1] "
            "AND w[x.i + 2] = w[get(k, {j}).i + 2], false)")
    df = df.withColumn("p", F.expr(
        f"sort_array(transform(filter(k, (x, j) -> {same.format(j='j - 1')} OR {same.format(j='j + 1')}), "
        "x -> CAST(x.i AS BIGINT)))"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("l", F.coalesce(lines, F.array().cast("array<string>")))
    df = df.select(
        *keep, F.col("n").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.coalesce(F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")), F.lit(0)).cast("long")
        .alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, j) -> least(get(p, j + 1) - x, 3L)), 0L, (a, x) -> a + x)")
        .alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 50)
                         | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def normalised_line(line: Column) -> Column:
    plain = F.btrim(line, F.lit(_BLANKS))
    plain = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789",
                        "abcdefghijklmnopqrstuvwxyz000000000")
    return F.regexp_replace(plain, _SPACE, " ")


def _document_lines(docs: DataFrame, host: str) -> DataFrame:
    """(host, doc, line, words, times): lines of each different text of a host;
    words sums over all copies' occurrences."""
    lines = docs.select(F.xxhash64(F.col(host)).alias("host"), text_key().alias("doc"),
                        F.explode(F.split("text", "\n", -1)).alias("raw"))
    lines = lines.select("host", "doc", normalised_line(F.col("raw")).alias("line")) \
        .where("line <> ''")
    return lines.select(
        "host", "doc", F.xxhash64("line").alias("line"),
        (F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1).alias("words")) \
        .groupBy("host", "doc", "line").agg(F.sum("words").alias("words"))


def frequent_lines(document_lines: DataFrame, max_docs: int, min_share: float = 0.0) -> DataFrame:
    """(host, line) in more than ``max_docs`` different texts of the host, and in more than
    ``min_share`` of all its different texts that hold a line."""
    often = document_lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")) \
        .where(F.col("n_docs") > max_docs)
    if not min_share:
        return often
    hosts = document_lines.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    return often.join(hosts, "host").where(F.col("n_docs") > F.lit(min_share) * F.col("of")).drop("of")


def _found(docs: DataFrame, host: str, max_docs: int, min_share: float) -> DataFrame:
    """(host, doc, line, words) of boilerplate lines in documents."""
    lines = written(_document_lines(docs, host))  # read again to mark
    frequent = frequent_lines(lines, max_docs, min_share).select("host", "line", F.explode(
        F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return lines.withColumn("salt", F.pmod("doc", F.lit(SALTS)).cast("int")) \
        .join(frequent, ["host", "line", "salt"])


def verdicts(docs: DataFrame, *, host: str = "source", max_docs: int = 10, min_share: float = 0.0,
             min_kept: float = 0.5) -> DataFrame:
    """The base measures, ``n_removed_words`` (words in boilerplate lines) and
    ``kept`` for every document.  ``min_share`` (default: none) is the share of a host's
    texts that a line must exceed beside ``max_docs``: with it, the verdict on a line
    that few of a host's texts share doesn't change as the host grows."""
    # a narrow table, so that a later filter on the verdict isn't pushed into
    # (and evaluated once per word of) the array expressions
    base = written(base_measures(docs.select("doc_id", F.xxhash64(F.col(host)).alias("host"),
                                             text_key().alias("doc"), "text"),
                                 ["doc_id", "host", "doc"]))
    copies = docs.groupBy(F.xxhash64(F.col(host)).alias("host"), text_key().alias("doc")) \
        .agg(F.count(F.lit(1)).alias("copies"))
    removed = _found(docs, host, max_docs, min_share).groupBy("host", "doc").agg(F.sum("words").alias("words")) \
        .join(copies, ["host", "doc"]) \
        .select("host", "doc", (F.col("words") / F.col("copies")).cast("long").alias("removed"))
    salted = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")) \
        .join(salted, ["host", "doc", "salt"], "left")
    n_removed = F.coalesce("removed", F.lit(0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "base_failed", n_removed.cast("long").alias("n_removed_words"),
                      (~F.col("base_failed") & (F.col("n_words") - n_removed
                                                >= F.lit(min_kept) * F.col("n_words"))).alias("kept"))


def without_boilerplate(docs: DataFrame, *, host: str = "source", max_docs: int = 10, min_share: float = 0.0,
                        min_kept: float = 0.5) -> DataFrame:
    """``docs`` without boilerplate lines and without depleted documents: all
    columns, ``text`` being what is left."""
    lines = _found(docs, host, max_docs, min_share).groupBy("host", "doc") \
        .agg(F.collect_set("line").alias("__lines")) \
        .select(F.col("host").alias("__host"), F.col("doc").alias("__doc"), "__lines")
    keyed = docs.withColumns({"__h": F.xxhash64(F.col(host)), "__d": text_key()})
    out = keyed.join(lines, (keyed["__h"] == lines["__host"]) & (keyed["__d"] == lines["__doc"]), "left")
    rest = F.filter(F.split("text", "\n", -1), lambda x: ~F.coalesce(F.array_contains(
        "__lines", F.xxhash64(normalised_line(x))), F.lit(False)))
    out = out.withColumn("__rest", F.when(F.col("__lines").isNull(), F.col("text"))
                         .otherwise(F.array_join(rest, "\n")))
    before, after = F.size(_words(F.col("text"))), F.size(_words(F.col("__rest")))
    return out.where(after >= F.lit(min_kept) * before).withColumn("text", F.col("__rest")) \
        .drop("__h", "__d", "__host", "__doc", "__lines", "__rest")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT *, CASE WHEN len(w) < 3 THEN CAST([] AS VARCHAR[]) ELSE
             list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS s FROM w),
grams AS (SELECT doc_id, host, t, g, count(*) AS n, list(i) AS spots FROM
             (SELECT DISTINCT doc_id, host, t, unnest(s) AS g, generate_subscripts(s, 1) AS i FROM win) GROUP BY ALL),
rep AS (SELECT doc_id, host, t, count(DISTINCT p) AS n FROM
             (SELECT doc_id, host, t, unnest([i, i + 1, i + 2]) AS p FROM
               (SELECT doc_id, host, t, unnest(spots) AS i FROM grams WHERE n > 1)) GROUP BY ALL),
base AS (SELECT w.doc_id, w.host, w.t, CAST(len(w.w) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(w.l) - len(list_distinct(w.l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
         FROM w LEFT JOIN rep ON rep.doc_id IS NOT DISTINCT FROM w.doc_id AND rep.host = w.host AND rep.t = w.t),
lines AS (SELECT host, t, regexp_replace(translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
             '[\x20\x09-\x0D]+', ' ', 'g') AS line
           FROM (SELECT host, t, unnest(l) AS x FROM (SELECT DISTINCT host, t, l FROM w))),
often AS (SELECT host, line FROM lines GROUP BY ALL HAVING count(DISTINCT t) > 10),
gone AS (SELECT host, t, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS n
           FROM lines SEMI JOIN often USING (host, line) GROUP BY ALL),
j AS (SELECT base.*, coalesce(gone.n, 0) AS n_removed_words,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
        FROM base LEFT JOIN gone ON gone.host = base.host AND gone.t = base.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CAST(n_removed_words AS BIGINT) AS n_removed_words,
       NOT base_failed AND n_words - n_removed_words >= 0.5 * n_words AS kept
FROM j
"""
