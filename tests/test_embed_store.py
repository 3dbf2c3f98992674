"""Embeddings by content: each distinct text once, whatever the run."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.embed_store import EmbeddingStore
from lodestone.plans import index_queries, retrieval
from lodestone.sources import manifest

SCHEMA = "id int, text string, embedding int"


def test_only_unseen_texts_are_embedded(spark, tmp_path, monkeypatch):
    seen = str(tmp_path / "seen")
    open(seen, "w").close()

    def load():
        def embed(texts):
            with open(seen, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[len(t), 1] for t in texts]

        return embed

    store = EmbeddingStore(spark, str(tmp_path / "store"), retrieval.embed_batches(load))
    rows = spark.createDataFrame([(1, "aa", 0), (2, "b", 0), (3, "aa", 0), (4, None, 0), (5, "", 0), (1, "aa", 0)], SCHEMA)
    assert (len(store), store.joined(rows).where("embedding IS NULL").count()) == (0, 6)
    monkeypatch.setattr(manifest, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.add(rows)
    monkeypatch.undo()
    assert (store.add(rows), store.add(rows), store.add(rows.limit(0)), len(store)) == (3, 0, 0, 3)
    more = rows.union(spark.createDataFrame([(9, "x" * 50_000, 0)], SCHEMA))
    assert store.add(more) == 1
    got = store.joined(more)
    assert got.columns == ["id", "text", "embedding"]
    assert sorted((r.id, r.embedding[0]) for r in got.collect()) == [(1, 2), (1, 2), (2, 1), (3, 2), (4, 0), (5, 0), (9, 50_000)]
    assert open(seen).read().split("\n").count("b") == 2  # the lost run and the one that was published
    store.compact()
    store.vacuum()
    assert (len(store), store.add(more), store.joined(more).where(F.col("embedding").isNull()).count()) == (4, 0, 0)


def test_runs(spark, sf_dir):
    runs = [r.n_embedded for r in index_queries.stored_embedding_runs(spark, sf_dir).orderBy("run").collect()]
    assert runs[0] > 0 and runs[1] > 0 and runs[2] == 0
    assert sum(runs) == spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.coalesce("text", F.lit(""))).distinct().count()
