import duckdb
import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts, or (doc_id, text) or (doc_id, text, lang, source)."""

    def make(*rows):
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else r
            doc_id, text, lang, source = (*r, None, None)[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(full, ROWS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Rows of the small table: doc_id, text, lang, source."""
    return duckdb.sql("select doc_id, text, lang, source from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def small(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
