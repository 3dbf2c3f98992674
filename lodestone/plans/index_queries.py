"""Queries of stored indexes: built from the tables, then searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import ivf
from lodestone.operators.embed_store import EmbeddingStore
from lodestone.operators.segments import Bm25Index
from lodestone.plans import retrieval, text_queries, vector_queries
from lodestone.plans.text_queries import K, asked, texts
from lodestone.sources.shared import shared_folder
from lodestone.streaming import ingest

#: Inverted lists of the exact search.
LISTS = 32


def built(spark, sf_dir) -> Bm25Index:
    """An index of the documents in a new folder."""
    index = Bm25Index(spark, shared_folder(spark, "index"))
    index.add(texts(spark, sf_dir), "documents")
    return index


def bm25_index_topk(spark, sf_dir):
    """The ranking of bm25_topk, from posting blocks that bounds let it read."""
    return built(spark, sf_dir).search(asked(spark, sf_dir), K)


def bm25_index_reads(spark, sf_dir):
    """For every query the blocks that its terms have, and how many were read to find its candidates."""
    return built(spark, sf_dir).reads(asked(spark, sf_dir), K)


def bm25_index_topk_after_delete(spark, sf_dir):
    """The ranking of bm25_topk_after_delete, with tombstones in the index."""
    index = built(spark, sf_dir)
    index.delete(text_queries.table(spark, sf_dir, "labels").where("toxic = 1"), "toxic")
    return index.search(asked(spark, sf_dir), K)


def stream_index_topk(spark, sf_dir):
    """The ranking of bm25_topk, from an index that a stream of documents has appended to."""
    return ingest.indexed(spark, f"{sf_dir}/documents.parquet").search(asked(spark, sf_dir), K)


def _lists(spark, sf_dir, metric: str):
    index = ivf.build(vector_queries.points(spark, sf_dir), LISTS, metric)
    return ivf.search(index, vector_queries.asked(spark, sf_dir), K)


def ivf_exact_topk(spark, sf_dir):
    """The ranking of cosine_topk_batch, from inverted lists whose shells are cut by the triangle inequality."""
    return _lists(spark, sf_dir, "cosine")[0]


def ivf_exact_topk_l2(spark, sf_dir):
    """The ranking of l2_topk, from inverted lists whose shells are cut by the triangle inequality."""
    return _lists(spark, sf_dir, "l2")[0]


def ivf_exact_reads(spark, sf_dir):
    """Distances that the exact search of inverted lists measures, and those that looking at everything takes."""
    return _lists(spark, sf_dir, "l2")[1]


def _store(spark) -> EmbeddingStore:
    return EmbeddingStore(spark, shared_folder(spark, "embeddings"), retrieval.embed_terms(text_queries.TERMS))


def stored_embedding(spark, sf_dir):
    """toy_embedding, from a store of distinct texts to which the table has been added."""
    store, docs = _store(spark), texts(spark, sf_dir)
    store.add(docs)
    rows = store.joined(docs).select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("long"), F.round("x", 6).alias("x"))


def stored_embedding_runs(spark, sf_dir):
    """Texts that are embedded when one half of the sources is added, then all documents, then all again."""
    store, docs = _store(spark), text_queries.table(spark, sf_dir, "documents")
    half = docs.where(F.crc32(F.coalesce("source", F.lit(""))) % 2 == 0)
    counts = [(i, store.add(x)) for i, x in enumerate((half, docs, docs), 1)]
    return spark.createDataFrame(counts, "run int, n_embedded long")


QUERIES = (bm25_index_topk, bm25_index_reads, bm25_index_topk_after_delete, stream_index_topk, ivf_exact_topk, ivf_exact_topk_l2, ivf_exact_reads, stored_embedding, stored_embedding_runs)

ORACLE = {
    "bm25_index_topk": text_queries.ORACLE["bm25_topk"],
    "bm25_index_topk_after_delete": text_queries.ORACLE["bm25_topk_after_delete"],
    "stream_index_topk": text_queries.ORACLE["bm25_topk"],
    "stored_embedding": text_queries.ORACLE["toy_embedding"],
    "ivf_exact_topk": vector_queries.ORACLE["cosine_topk_batch"],
    "ivf_exact_topk_l2": vector_queries.ORACLE["l2_topk"],
}
