"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Builds documents from (doc_id, text) rows."""

    def build(*rows):
        full = [(i, t, None, None, len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def clashing():
    """Adds columns named like results and like helpers of the operators."""
    names = ["kept", "keep_id", "hash", "_h", "_row", "_n", "_sha", "block", "length", "score", "text_sha256", "component_id"]
    return lambda df: df.withColumns({n: F.lit("x") for n in names})
