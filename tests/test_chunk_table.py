"""The table function against the DataFrame chunkers, and what it refuses."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunk_table
from lodestone.operators import chunking

ROWS = [(1, "One. Two three four.\n\nFive six seven. Eight nine ten eleven twelve.", {"page": 3}), (2, "", None), (3, None, {}), (4, "0123456789" * 20, None), (4, "世界。 x" * 9, None)]
SCHEMA = "doc_id long, text string, metadata map<string,int>"


@pytest.mark.parametrize("name", ["fixed", "recursive", "semantic"])
def test_same_as_the_frames(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plain = chunking.fixed(docs, 30, 7) if name == "fixed" else chunking.recursive(docs, 30, 7, "reference" if name == "recursive" else name)
    want = sorted((r.doc_id, r.ordinal, r.start_char, r.content) for r in plain.collect())
    got = chunk_table.chunked(docs, name, 30, 7)
    assert got.columns == ["doc_id", "metadata", "ordinal", "start_char", "content"]
    rows = got.collect()
    assert sorted((r.doc_id, r.ordinal, r.start_char, r.content) for r in rows) == want
    assert {str(r.metadata) for r in rows if r.doc_id == 1} == {"{'page': 3}"}


def test_sql_and_own_chunkers(spark, monkeypatch):
    monkeypatch.setitem(chunk_table.CHUNKERS, "halves", lambda text, size, overlap: [(0, len(text) // 2), (len(text) // 2, len(text))])
    chunk_table.register(spark)
    spark.createDataFrame([("abcd", "k")], "text string, key string").createOrReplaceTempView("two")
    rows = spark.sql("SELECT key, content FROM chunk(TABLE(two), 'fixed', 3, 1) ORDER BY start_char").collect()
    assert [tuple(r) for r in rows] == [("k", "abc"), ("k", "cd")]
    assert spark.sql("SELECT * FROM chunk(TABLE(SELECT * FROM two WHERE false), 'fixed', 3, 1)").count() == 0


def test_what_is_refused(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for bad in ({"chunker": "none"}, {"size": 0}, {"overlap": 512}, {"overlap": -1}):
        with pytest.raises(Exception, match="chunker|size"):
            chunk_table.chunked(docs, **bad).collect()
    with pytest.raises(Exception, match="text"):
        chunk_table.chunked(docs.drop("text")).collect()
    with pytest.raises(Exception, match="already"):
        chunk_table.chunked(docs.withColumn("content", F.lit(1))).collect()
