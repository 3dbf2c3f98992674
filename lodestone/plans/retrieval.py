"""Retrieval over a chunk table: embedding, dense and hybrid search, reranking.

Queries (query_id, text) and chunks (chunk_id, content, ...) are tables; a single question is a
table of one row. An embedding is a column function, or a model behind embed_batches().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import term_vector
from lodestone.operators import bm25, dense, quantise, rerank
from lodestone.operators.segments import Bm25Index
from lodestone.sources import manifest

Embedding = Callable[[Column], Column]
#: Scores candidates (query_id, doc_id, query, content, score, rank) as a column.
Reranker = Callable[[DataFrame], Column]


def embed_terms(terms: list[str]) -> Embedding:
    """Substring counts of some terms, as a unit vector."""
    return lambda text: term_vector(F.lower(text), terms)


def embed_batches(load: Callable[[], Callable[[list[str]], list]]) -> Embedding:
    """A model's embedding: load() runs once a worker and gives a function of a list of texts."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for b in batches:
            yield pd.Series([[float(x) for x in v] for v in embed(b.fillna("").tolist())], dtype=object)

    return run


def contains_reranker(rows: DataFrame) -> Column:
    """1 if the content has the query in any case, else 0."""
    return F.when(F.contains(F.lower("content"), F.lower("query")), 1.0).otherwise(0.0)


class BatchedReranker:
    """A model over batches of (query, content); see rerank.batches()."""

    def __init__(self, load: rerank.Load, size: int = 32, profile=None):
        self.load, self.size, self.profile = load, size, profile

    def scored(self, rows: DataFrame) -> DataFrame:
        return rerank.batches(rows, self.load, self.size, self.profile)


class ExactIndex:
    """Exact cosine search over (vec_id, embedding). Vectors can be added at any time; ids are not compared."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors.select("vec_id", "embedding")

    def __len__(self) -> int:
        return self.vectors.count()

    def add(self, vectors: DataFrame) -> None:
        self.vectors = self.vectors.unionByName(vectors.select("vec_id", "embedding"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return dense.search(queries, self.vectors, k)

    def save(self, path: str) -> None:
        self.vectors.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ExactIndex:
        if not manifest.exists(spark, path):
            raise FileNotFoundError(f"{path}: no index")
        return cls(spark.read.parquet(path))


class IvfPqIndex:
    """Approximate search. Its words fit the vectors that it was trained on, so an index takes no more: add() raises, build another."""

    def __init__(self, codes: DataFrame, index: quantise.IvfPq, n_probe: int = 8):
        self.codes, self.index, self.n_probe = codes, index, n_probe

    @classmethod
    def build(cls, vectors: DataFrame, n_clusters: int = 256, n_probe: int = 8, n_subvectors: int = 64, n_bits: int = 8, passes: int = 25) -> IvfPqIndex:
        index = quantise.fit_ivfpq(vectors, n_clusters, n_subvectors, n_bits, passes)
        return cls(quantise.encode(vectors, index), index, n_probe)

    def __len__(self) -> int:
        return self.codes.count()

    def add(self, vectors: DataFrame) -> None:
        raise RuntimeError("a built IVF-PQ index takes no more vectors; build another")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return quantise.search(self.codes, self.index, queries, k, self.n_probe)

    def save(self, path: str) -> None:
        quantise.save(self.codes, self.index, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, n_probe: int = 8) -> IvfPqIndex:
        return cls(*quantise.load(spark, path), n_probe)


class RetrievalPipeline:
    """Dense, or dense and BM25 fused, then reranked if there is a reranker.

    chunks has (chunk_id long, content); index searches their embeddings by chunk_id. sparse is a stored BM25
    index of the contents, for hybrid search without tokenising them; else a tokenizer may be given.
    """

    def __init__(
        self, chunks: DataFrame, embedding: Embedding, index=None, *, hybrid: bool = False, reranker: Reranker | BatchedReranker | None = None, rerank_top_n: int = 30,
        k1: float = bm25.K1, b: float = bm25.B, sparse: Bm25Index | None = None, tokenizer: bm25.Tokenizer | None = None,
    ):
        if rerank_top_n <= 0:
            raise ValueError("rerank_top_n must be positive")
        self.chunks, self.embedding, self.hybrid, self.reranker, self.rerank_top_n, self.k1, self.b = chunks, embedding, hybrid, reranker, rerank_top_n, k1, b
        self.sparse, self.tokenizer = sparse, tokenizer
        self.index = ExactIndex(chunks.select(F.col("chunk_id").alias("vec_id"), embedding(F.col("content")).alias("embedding"))) if index is None else index

    @property
    def mode(self) -> str:
        return ("hybrid" if self.hybrid else "dense") + "+rerank" * (self.reranker is not None)

    def _candidates(self, queries: DataFrame, k: int) -> DataFrame:
        vectors = queries.select(F.col("query_id").alias("vec_id"), self.embedding(F.col("text")).alias("embedding"))
        if not self.hybrid:
            return self.index.search(vectors, k)
        wide = max(3 * k, 30)
        if self.sparse:
            sparse = self.sparse.search(queries, wide)
        else:
            texts = self.chunks.select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
            sparse = bm25.top(bm25.scores(texts, queries, self.k1, self.b, tokenizer=self.tokenizer, k=wide), wide)
        return bm25.top(bm25.fuse(self.index.search(vectors, wide), sparse), k)

    def retrieve(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, doc_id, score, rank long) and the chunk's columns; k <= 0 gives no rows."""
        found = self._candidates(queries, (max(self.rerank_top_n, k) if self.reranker else k) if k > 0 else 0)
        found = found.join(self.chunks.withColumnRenamed("chunk_id", "doc_id"), "doc_id")
        if self.reranker:
            rows = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
            scored = self.reranker.scored(rows) if isinstance(self.reranker, BatchedReranker) else rows.withColumn("rerank_score", self.reranker(rows))
            found = rerank.reranked(scored, k).withColumn("score", F.col("rerank_score")).drop("rerank_score", "query")
        return found
