"""Exact vector search of a set of queries, in blocks.

Queries and corpus are packed into blocks of rows; each pair of blocks is one matrix product in an
Arrow task that keeps only its best k, so nothing of the size queries x corpus is ever a row. The
packed queries are measured, and sent to all tasks in groups of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.bm25 import top
from lodestone.sources.shared import use_checkpoints

CORPUS_BLOCK, QUERY_BLOCK = 4096, 1024
#: Bytes of packed queries that are sent to all tasks at once.
SENT = 64_000_000


def rows_of(vectors: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles; vectors have one dimension all."""
    n = len(vectors)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    if n and (len(flat) % n or pc.min_max(pc.list_value_length(vectors)).as_py() != {"min": len(flat) // n, "max": len(flat) // n}):
        raise ValueError("vectors of different dimensions")
    return flat.reshape(n, -1)


def pack(df: DataFrame, key: str, vector: str, rows: int, prefix: str) -> DataFrame:
    """Blocks (prefix_ids array<long>, prefix_data binary of doubles) of up to so many rows; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())], ["i", "d"])

        for b in batches:
            b = b.filter(pc.is_valid(b.column(1)))
            if b.num_rows:
                held.append((b.column(0).to_numpy(zero_copy_only=False), rows_of(b.column(1))))
            while sum(len(i) for i, _ in held) >= rows:
                ids, data = (np.concatenate(x) for x in zip(*held, strict=True))
                yield out(ids[:rows], data[:rows])
                held = [(ids[rows:], data[rows:])]
        if sum(len(i) for i, _ in held):
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    named = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    return named.mapInArrow(run, "i array<long>, d binary").toDF(f"{prefix}_ids", f"{prefix}_data")


def crossed(queries: DataFrame, corpus: DataFrame, found: Callable[[DataFrame], DataFrame], key: str = "vec_id", vector: str = "embedding", spread: bool = False) -> DataFrame:
    """found() of all pairs of blocks (q_ids, q_data, c_ids, c_data), the queries' blocks in groups of bounded size.

    spread deals the corpus's blocks to twice as many tasks as there are cores, however few files hold it.
    """
    sc = queries.sparkSession.sparkContext
    use_checkpoints(queries.sparkSession)
    asked = pack(queries, key, vector, QUERY_BLOCK, "q").checkpoint()
    n = -(-(asked.agg(F.sum(F.length("q_data"))).collect()[0][0] or 0) // SENT)
    blocks = pack(corpus, key, vector, CORPUS_BLOCK, "c")
    if spread:
        blocks = blocks.repartition(2 * sc.defaultParallelism)
    if n > 1:
        blocks = blocks.checkpoint()  # read once for each group
    part = F.pmod(F.xxhash64("q_ids"), F.lit(max(1, n)))
    return reduce(DataFrame.union, (found(blocks.crossJoin(F.broadcast(asked.where(part == i)))) for i in range(max(1, n))))


def search(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score double, rank long): the k best of the corpus for every query.

    metric "cosine" ranks high similarities first, "l2" low squared distances. Scores are rounded
    to 6 digits and ties go to the lower id; zero vectors have similarity 0. k <= 0 gives no rows.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(n == 0, 1, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qd, ci, cd in zip(b["q_ids"], b["q_data"], b["c_ids"], b["c_data"], strict=True):
                q, c = np.frombuffer(qd).reshape(len(qi), -1), np.frombuffer(cd).reshape(len(ci), -1)
                if q.shape[1] != c.shape[1]:
                    raise ValueError(f"vectors of {q.shape[1]} and {c.shape[1]} dimensions")
                s = unit(q) @ unit(c).T if metric == "cosine" else -((q * q).sum(1)[:, None] + (c * c).sum(1) - 2 * q @ c.T).clip(0)
                s = np.round(s, 6)
                ids = np.asarray(ci)
                best = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(qi), best.shape[1]), "doc_id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    schema = "query_id long, doc_id long, score double"
    if k <= 0:
        return top(queries.sparkSession.createDataFrame([], schema), k)
    found = crossed(queries, corpus, lambda pairs: pairs.mapInPandas(run, schema), key, vector)
    ranked = top(found, k)
    return ranked if metric == "cosine" else ranked.withColumn("score", F.abs("score"))
