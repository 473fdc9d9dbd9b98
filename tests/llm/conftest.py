import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """documents of texts, or of (doc_id, text) pairs; with columns that clash with names used inside."""

    def build(texts, langs=None):
        rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
        rows = [(d, t, (langs[k] if langs else "en"), "src", len(t) if t is not None else None) for k, (d, t) in enumerate(rows)]
        df = spark.createDataFrame(rows, DOCS)
        for name in ("size", "key", "fp", "n", "score", "row", "ids", "shard", "h"):
            df = df.withColumn(name, df["source"])
        return df

    return build


@pytest.fixture(scope="session")
def corpus(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
