import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def table(spark):
    """Documents of texts; ids count from 0 unless given."""

    def make(texts, ids=None, langs=None, sources=None):
        rows = [(ids[k] if ids else k, t, langs[k] if langs else "en", sources[k] if sources else "s", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
