import re
import time

import duckdb
import pytest

from llm.rows import ODD_ROWS
from tabprobe.llm import line_frequency, queries


def compare(spark, con):
    got = line_frequency.verdicts(spark.table("docs_lf"))
    cur = con.execute(line_frequency.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=str)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want
    return {(r.doc_id): r for r in got.collect()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_against_sql(spark, sf):
    path = f"/root/testdata/sf{sf}/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    spark.read.parquet(path).createOrReplaceTempView("docs_lf")
    compare(spark, con)
    assert queries.SPARK["op2_line_frequency"](spark, f"/root/testdata/sf{sf}").count() > 0


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 10007}" for i in range(n))


def test_boilerplate_and_odd_rows(spark, make_docs, tmp_path):
    menu = "Home | About  us | Call 123"
    rows = [(100 + i, f"{menu if i % 2 else menu.upper()}\n{prose(i, 60)}", None, "a") for i in range(14)]
    rows += [(200 + i, f"{menu}\n{menu}\n{prose(99, 40)}\n{prose(i, 12)}", None, "a") for i in range(20)]
    rows += [(300, f"{menu}\n{prose(5, 60)}", None, "b"), (301, prose(6, 80), None, None)]
    rows += [(400 + i, prose(77, 90), None, "c") for i in range(30)]  # copies of a clean text
    rows += [(d, t, None, "a") for d, t in ODD_ROWS]
    docs = make_docs(rows)
    docs.createOrReplaceTempView("docs_lf")
    path = str(tmp_path / "d")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = compare(spark, con)
    assert got[100].kept and got[100].n_removed_words == 7
    assert not got[205].kept and got[205].n_removed_words == 54
    assert got[300].kept and got[300].n_removed_words == 0 and got[401].kept
    clean = {r.doc_id: r for r in line_frequency.without_boilerplate(
        docs.withColumn("host", line_frequency.F.lit("x"))).collect()}
    assert clean[100].text == prose(0, 60) and clean[300].text.startswith(menu) and 205 not in clean
    assert line_frequency.verdicts(make_docs([])).collect() == []


def test_filter_on_the_verdict_stays_cheap(spark, make_docs):
    docs = make_docs([(i, prose(i, 9_000)) for i in range(8)])
    start = time.time()
    assert line_frequency.verdicts(docs).where("kept AND NOT base_failed AND n_repeat_words < 9").count() == 8
    assert time.time() - start < 30


def test_no_python_in_plan(spark, make_docs):
    plan = line_frequency.verdicts(make_docs([(1, "a b c")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


def test_windows_that_share_most_bits_of_a_hash_differ(spark, make_docs):
    # xxhash64 of these two windows agrees in its low 46 bits
    one, two = spark.sql("SELECT xxhash64('c16189601', 'x', 'y'), xxhash64('c29038626', 'x', 'y')").first()
    assert one != two and (one ^ two) & ((1 << 46) - 1) == 0
    words = [f"a{i}" for i in range(1 << 17)]
    words[100:103], words[50_000:50_003] = ["c16189601", "x", "y"], ["c29038626", "x", "y"]
    repeat = words[200:204]
    docs = make_docs([(1, " ".join(words)), (2, " ".join(words + repeat))])
    got = {r.doc_id: r.n_repeat_words for r in line_frequency.verdicts(docs).collect()}
    assert got == {1: 0, 2: 8}


def test_share_limit_beside_the_count(spark, make_docs):
    """A line of 12 of a host's 40 texts: over the count of 10, under a share of a half."""
    rows = [(i, ("Subscribe to our letter\n" if i < 12 else "") + "All rights reserved\n" + prose(i, 60), None, "a")
            for i in range(40)]
    docs = make_docs(rows)

    def removed(**options):
        return {r.doc_id: r.n_removed_words for r in line_frequency.verdicts(docs, **options).collect()}

    assert removed() == {i: 7 if i < 12 else 3 for i in range(40)}
    assert removed(min_share=0.5) == {i: 3 for i in range(40)}
    assert removed(min_share=0.25) == removed()
    text = {r.doc_id: r.text for r in line_frequency.without_boilerplate(docs, min_share=0.5).collect()}
    assert text[0] == "Subscribe to our letter\n" + prose(0, 60) and text[20] == prose(20, 60)
