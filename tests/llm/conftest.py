import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


@pytest.fixture()
def documents(spark):
    """documents(texts, ...) -> DataFrame with ids 0, 1, ... or the given ones."""
    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        rows = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in zip(ids, texts, langs, strict=True)]
        return spark.createDataFrame(rows, DOCUMENTS)
    return make


@pytest.fixture()
def sf(tmp_path):
    """sf(name=frame, ...) writes tables and gives their folder."""
    def make(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make
