import hashlib

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (id, text) pairs, with extra columns whose names clash with results."""
    def make(rows, clash=()):
        df = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DOCS)
        from pyspark.sql import functions as F
        for c in clash:
            df = df.withColumn(c, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def sha():
    return lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
