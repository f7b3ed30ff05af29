import re

import corpus_pipeline
from llm.rows import SF
from tabprobe.llm import pseudonyms, queries
from llm.test_decontaminate import brute as brute_leaks
from llm.test_decontaminate import smith_waterman  # noqa: F401
from llm.test_packing import check_pieces
from llm.test_simhash import brute as brute_components


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = [(10 ** 6, None, None, None, None), (10 ** 6 + 1, "", None, None, 0), (10 ** 6 + 2, "12 34", "en", "s", 5)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        frames[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], docs)
        if name != "packing":
            assert docs.columns == columns

    def kept(name):
        return {r.doc_id: r.text for r in frames[name][1].collect()}

    before, _ = frames["language"]
    assert kept("language") == {d: t for d, t in before if d < 10 ** 6}
    before, _ = frames["near_duplicates"]
    firsts = {c for _, _, c in brute_components(before)}
    assert kept("near_duplicates") == {d: t for d, t in before if d in firsts}
    before, _ = frames["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = kept("decontamination")
    for d, t in before:
        if len(t) < 3000:
            assert (d in after) == (not brute_leaks([(d, t)], items))
    before, _ = frames["pii"]
    f = pseudonyms.Feistel(corpus_pipeline.PSEUDONYM_KEY)
    assert kept("pii") == {d: pseudonyms.replace_values(t, f)[0] for d, t in before}
    before, packed = frames["packing"]
    check_pieces(packed.collect(), before)


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < len({r.doc_id for r in rows}) < total
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    assert re.match("op1_", next(iter(queries.SPARK)))


def language_kept(rows, docs):
    """The language stage by its definition: the network's score of each text by itself,
    letters and blanks counted one by one."""
    from tabprobe.llm import language_gru

    model = language_gru.trained(docs)
    out = set()
    for d, text in rows:
        solid = [c for c in text or "" if not c.isspace()]
        letters = sum(c.isalpha() for c in solid)
        if not letters:
            continue
        score = 1.0 if model is None else float(model.documents([text.encode()])[0].max())
        if score * letters / len(solid) >= 0.1:
            out.add(d)
    return out


JUNK = [(9001, "x9$ #%% 00"), (9002, "0101010101010 a"), (9003, "@@ ]] (( 3.14 2.71 e 1.41"), (9004, None), (9005, ""),
        (9006, "12 34 ..."), (9007, "Hi"), (9008, "ein kurzer Satz"), (9009, "call 555-1234 or 555-9876, 10.2.3.4, now please"),
        (9010, " \n a")]


def test_language_stage_decides_by_score_and_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(d, t, None, "s", None) for d, t in JUNK], docs.schema)
    docs = docs.unionAll(more)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()}
    assert kept == language_kept(rows, docs)
    assert not kept & {9001, 9002, 9003, 9004, 9005, 9006} and {9007, 9008, 9009, 9010} <= kept


def test_language_stage_without_marks_keeps_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", queries.F.lit(None).cast("string"))
    more = spark.createDataFrame([(d, t, None, "s", None) for d, t in JUNK], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionAll(more), SF).collect()}
    assert len(kept) == docs.count() + 5 and not kept & {9002, 9003, 9004, 9005, 9006}
    taken = docs.withColumn("lang_pred", queries.F.lit("mine"))
    assert {r.lang_pred for r in corpus_pipeline.language(spark, taken, SF).collect()} == {"mine"}
