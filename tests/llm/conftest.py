import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source)."""
    def build(rows, extra=False):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src0")), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:  # columns whose names the operators use inside
            for c in ("h", "n", "d", "t", "key", "rep", "size", "score", "target", "at", "name", "component", "_d"):
                from pyspark.sql import functions as F
                df = df.withColumn(c, F.lit("x"))
        return df
    return build


@pytest.fixture(scope="session")
def sample(spark):
    """The given documents of the smallest table, as (doc_id, text, lang, source)."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return [(r.doc_id, r.text, r.lang, r.source) for r in rows]


#: Nulls, empties, one word, white space, repeated rows, no letters, a long line, ties.
EDGE = [(1, None), (2, ""), (3, "one"), (4, " \n\t "), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (6, "A B c d e f g H"),
        (7, "12 34 ++"), (None, "a b c d e f g h"), (None, None), (8, "x" * 5000), (9, "é ñ ß\n\né ñ ß\n\né ñ ß"), (10, "a  b   c ")]


@pytest.fixture(scope="session")
def edge():
    return EDGE
