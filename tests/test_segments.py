"""The stored BM25 index against the plan that reads the corpus."""

import json
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, segments
from lodestone.operators.segments import Bm25Index, term_counts
from lodestone.functions.text import tokens
from lodestone.sources import manifest
from lodestone.streaming import ingest

DOCS = "doc_id long, text string"


def corpus(n, seed=1):
    """Zipf-like words, so that frequent ones are everywhere; empty and null texts; ties by equal texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(400 ** rng.random()) - 1}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "w3 w3 w3 Rare"), (n + 3, "rare w3 w3 w3"), (n + 4, "long " * 30_000 + "w1")]


ASKED = [(1, "w0 w1 w2 rare"), (2, "w3 w3 w250"), (3, "nothing here"), (4, ""), (5, None), (6, "w0"), (7, "w5 w17 w80 w300 w399 LONG")]


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string").cache()


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr("lodestone.operators.segments.GROUP_DOCS", 16)
    monkeypatch.setattr("lodestone.operators.segments.TASK_GROUPS", 8)
    monkeypatch.setattr("lodestone.operators.segments.GROUP_WORDS", 512)
    monkeypatch.setattr("lodestone.operators.segments.KIND_DOCS", 100)
    monkeypatch.setattr("lodestone.operators.segments.SENT_TERMS", 9)
    monkeypatch.setattr("lodestone.operators.segments.QUERY_BLOCK", 2)


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "b a b  c b"), (2, ""), (3, None)], DOCS)
    got = {r.doc_id: [tuple(x) for x in r.t] for r in df.select("doc_id", term_counts(tokens(F.col("text"))).alias("t")).collect()}
    assert got == {1: [("a", 1), ("b", 3), ("c", 1)], 2: [], 3: []}


def test_segments_deletes_and_compaction(spark, asked, tmp_path, small_groups):
    rows = corpus(400)
    index = Bm25Index(spark, str(tmp_path / "index"))
    assert len(index) == 0 and index.search(asked, 5).collect() == []
    for i in range(2):
        part = spark.createDataFrame(rows[i::2], DOCS)
        assert index.add(part, f"part-{i}") and not index.add(part, f"part-{i}")
    assert len(index) == len(rows) and index.documents().count() == len(rows)
    whole = spark.createDataFrame(rows, DOCS)
    for k in (1, 1000, 0):
        assert rows_of(index.search(asked, k)) == rows_of(bm25.top(bm25.scores(whole, asked), k))
    gone = spark.createDataFrame([(i,) for i in [*range(0, 400, 3), 402, 99999, 402]], "doc_id long")
    n = index.delete(gone, "first")
    assert (n, index.delete(gone, "first"), index.delete(gone, "again")) == (135, 0, 0) and len(index) == len(rows) - n
    for mode in ("exact", "reference"):
        assert rows_of(index.search(asked, 6, mode)) == rows_of(bm25.top(bm25.scores(whole, asked, deleted=gone, delete_mode=mode), 6))
    want = rows_of(index.search(asked, 6))
    index.compact()
    assert list(index.segments()) == [f"compact-{manifest.read(spark, index.folder)[0]}"] and rows_of(index.search(asked, 6)) == want
    index.vacuum()
    assert rows_of(index.search(asked, 6)) == want and not (tmp_path / "index/forward/segment=part-0").exists()
    assert not index.add(spark.createDataFrame(rows[::2], DOCS), "part-0")  # what was compacted is not added again
    assert index.add(spark.createDataFrame([(0, "w0 w0 rare")], DOCS), "back")
    assert len(index) == len(rows) - n + 1
    with pytest.raises(ValueError):
        index.search(asked, 3, "soft")


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """Where documents differ in kind, most blocks of a query's terms are not read."""
    monkeypatch.setattr("lodestone.operators.segments.GROUP_DOCS", 16)
    rng = random.Random(5)
    rows = [(i, " ".join([f"t{i % 7}"] * 4 + [f"t{i % 7}w{rng.randrange(30)}" for _ in range(5 + rng.randrange(60))] + ["and", "of"] * rng.randrange(5))) for i in range(1500)]
    index = Bm25Index(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(rows, DOCS))
    some = spark.createDataFrame([(1, "t3 and t3w1 t3w2 t3w3 of"), (2, "of and t5w7")], "query_id long, text string")
    reads = index.reads(some, 3).collect()
    assert len(reads) == 2 and all(0 < r.n_read < 0.7 * r.n_blocks for r in reads), reads
    assert rows_of(index.search(some, 3)) == rows_of(bm25.top(bm25.scores(spark.createDataFrame(rows, DOCS), some), 3))


def test_blocks_lie_in_rows_by_group(spark, tmp_path):
    """Rows of blocks follow groups and buckets, not terms; reads count each term of a query in each group."""
    index = Bm25Index(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(corpus(200), DOCS), "a")
    blocks = index._grouped(["a"]).select("g", F.explode("terms").alias("term")).distinct().cache()
    assert index._rows("packs", ["a"]).count() <= segments.BUCKETS * blocks.select("g").distinct().count() < blocks.count()
    some = spark.createDataFrame([(1, "w0 w1 w2 rare"), (2, "w0 none")], "query_id long, text string")
    got = {r.query_id: r.n_blocks for r in index.reads(some, 3).collect()}
    assert got == {1: blocks.where("term IN ('w0', 'w1', 'w2', 'rare')").count(), 2: blocks.where("term = 'w0'").count()}


def test_what_is_refused_is_not_published(spark, asked, tmp_path):
    index = Bm25Index(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(1, "rare", "x", 2), (2, None, "y", 3)], DOCS + ", term string, len int"))
    for bad in ([(3, "a"), (3, "b")], [(None, "a")], [(2, "again")]):
        with pytest.raises(ValueError):
            index.add(spark.createDataFrame(bad, DOCS), "bad")
    assert len(index) == 2 and rows_of(index.search(asked, 3)) == [(1, 1, 1, pytest.approx(0.478033, abs=1e-6))]
    assert index.add(spark.createDataFrame([], DOCS), "empty") and len(index) == 2
    assert index.add(spark.createDataFrame([(3, "a")], DOCS), "bad")  # the name is free


def test_a_batch_that_failed_before_publishing_runs_again(spark, asked, tmp_path, monkeypatch):
    index = Bm25Index(spark, str(tmp_path / "index"))
    part = spark.createDataFrame(corpus(50), DOCS)
    monkeypatch.setattr(manifest, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.add(part, "b")
    monkeypatch.undo()
    assert len(index) == 0 and index.add(part, "b") and len(index) == 55


def test_stream_in_three_batches(spark, asked, tmp_path):
    rows = corpus(300)
    for i in range(3):
        spark.createDataFrame(rows[i::3], DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index = Bm25Index(spark, str(tmp_path / "index"))
    go = lambda: ingest.ingest_index(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, index, str(tmp_path / "progress"), 1)
    go()
    assert sorted(index.segments()) == ["batch-0", "batch-1", "batch-2"]
    want = rows_of(bm25.top(bm25.scores(spark.createDataFrame(rows, DOCS), asked), 5))
    assert rows_of(index.search(asked, 5)) == want
    spark.createDataFrame([(9999, "rare rare w0")], DOCS).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert len(index) == len(rows) + 1 and rows_of(index.search(asked, 5)) != want


def test_a_stream_hands_workers_few_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BATCH_DOCS", 10)
    spark.createDataFrame(corpus(100), DOCS).coalesce(1).write.parquet(str(tmp_path / "in"))

    @F.arrow_udf("array<string>")
    def words(text: pa.Array) -> pa.Array:
        assert len(text) <= 10
        return pa.array([(x or "").split() for x in text.to_pylist()], pa.list_(pa.string()))

    index = Bm25Index(spark, str(tmp_path / "index"), tokenizer=words)
    ingest.ingest_index(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, index, str(tmp_path / "progress"), 1)
    assert len(index) == 105


def test_manifests(spark, tmp_path):
    folder = str(tmp_path)
    assert manifest.read(spark, folder) == (0, {}) and manifest.versions(spark, f"{folder}/none") == []
    assert manifest.publish(spark, folder, 0, {"a": 1}) == 1 and manifest.publish(spark, folder, 1, {"a": "é"}) == 2
    assert manifest.read(spark, folder) == (2, {"a": "é"}) and manifest.read(spark, folder, 1) == (1, {"a": 1})
    with pytest.raises(RuntimeError):
        manifest.publish(spark, folder, 0, {"a": 3})
    with pytest.raises(FileNotFoundError):
        manifest.read(spark, folder, 7)
    Path(folder, "manifest-00000003.json").write_text(json.dumps({"format": 99}))
    with pytest.raises(ValueError):
        manifest.read(spark, folder)


def test_candidates_follow_tasks_and_not_groups(spark, asked, tmp_path, small_groups):
    """A search keeps a query's k best for each task; before, it kept them for each group."""
    rows = corpus(600)
    index = Bm25Index(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(rows, DOCS))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 600, 7)], "doc_id long"))
    found = index._search(asked, 3, "exact")[0]
    n = {r.query_id: r["count"] for r in found.groupBy("query_id").count().collect()}
    groups = spark.read.parquet(str(tmp_path / "index/groups")).agg(F.sum("n_groups")).collect()[0][0]
    assert groups > 36 and set(n) == {1, 2, 6, 7} and max(n.values()) <= 3 * 4  # k, partitions


def test_held_candidates_are_cut_to_the_best(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.operators.segments.GROUP_DOCS", 16)
    rows = corpus(300, 3)
    index = Bm25Index(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame(rows, DOCS))
    whole = spark.createDataFrame(rows, DOCS)
    want = rows_of(bm25.top(bm25.scores(whole, asked), 4))
    monkeypatch.setattr(segments, "HELD", 5)
    assert rows_of(index.search(asked, 4)) == want


ODD = ["", " ", "a", " a", "a ", "b a\tb\n\x0bA  c\x0cb\rb", "no\u00a0break \u2003wide\u2003", "\u00c9t\u00e9 \u00e9t\u00e9 \u0130 \u4e2d\u6587 \U0001f600", "\x1c\x1d \x85", "end", "start", "  ", None, "b b a a", "x" * 300]


def test_texts_go_to_workers_whole(spark, tmp_path, monkeypatch):
    """Words are cut where they are counted; before, arrays of them were sent. The forward table is as SQL has it."""
    seen = []
    write = Bm25Index._write_forward
    monkeypatch.setattr(Bm25Index, "_write_forward", lambda self, rows, n, name: (seen.append(rows), write(self, rows, n, name)))
    docs = spark.createDataFrame(list(enumerate(ODD * 3)), DOCS).coalesce(2)
    index = Bm25Index(spark, str(tmp_path / "index"))
    index.add(docs, "a")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" in plan and "split(" not in plan
    counted = docs.select("doc_id", F.size(tokens(F.col("text"))).alias("len"), term_counts(tokens(F.col("text"))).alias("x"))
    often = F.array_max(F.arrays_zip("tfs", "terms"))["terms"]
    want = counted.select("doc_id", "len", F.col("x.term").alias("terms"), F.col("x.tf").alias("tfs")).select("doc_id", "len", often.alias("often"), "terms", "tfs")
    assert sorted(map(tuple, seen[0].collect())) == sorted(map(tuple, want.collect()))
    assert index._rows("forward", ["a"]).select("doc_id", "len", "terms", "tfs").exceptAll(want.drop("often")).count() == 0


def test_words_of_a_slice_of_texts():
    texts = pa.array([(x or "").lower() for x in ODD])
    for a, n in ((0, len(ODD)), (3, 5), (12, 1), (5, 0)):
        words, sizes = segments._split(texts.slice(a, n))
        want = [[w for w in re.split(r"[ \t\n\x0b\f\r]+", x) if w] for x in texts.slice(a, n).to_pylist()]
        assert words.to_pylist() == sum(want, []) and sizes.tolist() == [len(x) for x in want]


def test_blocks_are_packed_from_bytes(monkeypatch):
    """Terms of a group are hashed and packed where they lie; before, each became a string, twice."""
    of, seen = segments._bucket, []
    monkeypatch.setattr(segments, "_bucket", lambda x: (seen.append(x), of(x))[1])
    terms = [["", "a b", "\u00e9"], ["\u00e9", "\u4e2d"], []]
    group = {"doc_id": [7, 3, 5], "len": [4, 2, 0], "g": [2, 2, 2], "joined": ["".join(x).encode() for x in terms], "sizes": [[len(y.encode()) for y in x] for x in terms], "tfs": [[1, 2, 1], [1, 1], []]}
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(group.values(), kinds, strict=True)], list(group))
    got = {}
    for r in pa.Table.from_batches(segments._blocks(iter([batch]))).to_pylist():
        x = {c: np.frombuffer(r[c], kind).tolist() for c, kind in segments.PACKED.items()}
        assert r["g"] == 2 and x["doc_ids"] == [3, 5, 7] and x["lens"] == [2, 0, 4]
        at = 0
        for size, n, tf, least in zip(x["sizes"], x["n"], x["max_tf"], x["min_len"], strict=True):
            term, r["terms"] = r["terms"][:size], r["terms"][size:]
            assert of(term) == r["bucket"]
            got[term.decode()] = (n, tf, least, x["at"][at : at + n], x["tfs"][at : at + n])
            at += n
    assert got == {"": (1, 1, 4, [2], [1]), "a b": (1, 2, 4, [2], [2]), "\u00e9": (2, 1, 2, [0, 2], [1, 1]), "\u4e2d": (1, 1, 2, [0], [1])}
    assert len(seen) == 4 and all(isinstance(x, memoryview) for x in seen)
