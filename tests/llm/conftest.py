import pytest
from pyspark.sql import types as T

from ..conftest import SF_MID, SF_SMALL  # noqa: F401

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)

    return make
