import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a caller's columns of these names must not disturb them.
CLASHES = ("host", "k", "d", "pos", "node", "label", "bucket", "size", "target", "passes", "t", "s", "seg", "place", "words", "part", "removed", "start")


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns of clashing names."""

    def documents(rows, clashes=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashes:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("own") for c in CLASHES})
        return df

    return documents


@pytest.fixture
def texts(spark):
    """Whole texts of the smallest documents table, by id."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
