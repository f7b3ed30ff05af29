import pytest

from llm.rows import SF

DOCS_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, parts=2):
        """rows: (doc_id, text[, lang[, source]])"""
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else "s",
                 len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS_SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def sample(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
