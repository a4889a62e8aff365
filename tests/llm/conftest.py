import pytest
from pyspark.sql import functions as F

WORDS = "the quick brown fox jumps over a lazy dog while seven old wizards brew potions near some river bank".split()


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names clash with inner ones."""

    def build(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        extra = {c: F.lit("x") for c in ("id", "n", "d", "sha", "size", "start", "rep", "key", "shard", "ids", "u", "k", "bucket", "row", "h", "c", "th", "words", "right_h", "_doc", "_stay", "_own", "a.b")}
        return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), **extra})

    return build


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
