"""Inverted lists of whole vectors, searched exactly or in the nearest lists alone.

A list's vectors lie in blocks in order of their distance from the list's centroid, so a block is a shell: by
the triangle inequality none of it is nearer to a query than the shell is. A first pass over the nearest
list of each query gives a distance within which it has k neighbours; the second looks, of every block, only
at the queries whose distance the shell reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import dense, quantise
from lodestone.operators.bm25 import top
from lodestone.sources.shared import use_checkpoints

#: Vectors of a block, and slack of a bound against rounding.
BLOCK, SLACK = 1024, 1e-5
#: Pairs of blocks that a worker is handed at once; each is of about a megabyte.
PAIRS, PER_BATCH = 16, "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Ivf:
    """Blocks (cluster, low, high double, c_ids array<long>, c_data binary) of vectors by centroid [k, d], and their metric."""

    blocks: DataFrame
    centroids: np.ndarray
    metric: str


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T).clip(0))


def build(points: DataFrame, n_clusters: int, metric: str = "cosine", passes: int = 10, seed: int = 42, block: int = BLOCK) -> Ivf:
    """Lists of (vec_id, embedding), as a checkpointed table; null vectors are left out.

    metric "cosine" clusters unit vectors (zero vectors stay zero), "l2" vectors as they are. A list may be of
    any size: its blocks are cut from ranges of distances, of which a task sorts one at a time.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("metric is cosine or l2")
    use_checkpoints(points.sparkSession)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = dense.rows_of(b.column(1))
                x = _unit(x) if metric == "cosine" else x
                yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))], ["vec_id", "embedding"])

    kept = points.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    kept = kept.mapInArrow(unit, "vec_id long, embedding array<double>")
    centroids = quantise.fit_kmeans(kept, n_clusters, passes, seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = dense.rows_of(b.column(1))
                near = quantise.nearest(x, centroids)
                away = np.sqrt(((x - centroids[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(away), *b.columns], ["cluster", "away", "vec_id", "embedding"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            away, ids, x = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3))
            values = [rows[0][0]], [away.min()], [away.max()], [ids], [x.tobytes()]
            kinds = pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()
            columns = [pa.array(v, t) for v, t in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, ["cluster", "low", "high", "c_ids", "c_data"])

        for b in batches:
            if not b.num_rows:
                continue
            cluster, away, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), dense.rows_of(b.column(3))
            cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(cluster)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                while lo < hi:
                    if held and held[0][0] != cluster[lo]:
                        yield out(held)
                        held = []
                    end = min(hi, lo + block - sum(len(r[1]) for r in held))
                    held.append((int(cluster[lo]), away[lo:end], ids[lo:end], x[lo:end]))
                    lo = end
                    if sum(len(r[1]) for r in held) == block:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    placed = kept.mapInArrow(place, "cluster long, away double, vec_id long, embedding array<double>")
    ordered = placed.repartitionByRange("cluster", "away").sortWithinPartitions("cluster", "away", "vec_id")
    blocks = ordered.mapInArrow(pack, "cluster long, low double, high double, c_ids array<long>, c_data binary").checkpoint()
    return Ivf(blocks, centroids, metric)


def _scan(index: Ivf, asked: DataFrame, k: int, n_probe: int | None) -> DataFrame:
    """(query_id, doc_id, far, looked): the k nearest in each block, of the queries that may have neighbours there; a row without
    doc_id counts the distances of a block."""
    centroids, index_metric = index.centroids, index.metric
    kinds = {"query_id": "Int64", "doc_id": "Int64", "far": "float64", "looked": "int64"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, q, to = None, None, None
        for b in batches:
            for cluster, low, high, ci, cd, qi, qd, within in zip(*(b[c] for c in ("cluster", "low", "high", "c_ids", "c_data", "q_ids", "q_data", "within")), strict=True):
                if qd is not last:
                    last, q = qd, np.frombuffer(qd).reshape(len(qi), -1)
                    to = _far(q, centroids)
                    order = np.argsort(np.argsort(to, axis=1, kind="stable"), axis=1) if n_probe else None
                d = to[:, cluster]
                open_ = np.maximum(d - high, low - d) <= np.asarray(within) + SLACK
                if n_probe:
                    open_ &= order[:, cluster] < n_probe
                rows = np.flatnonzero(open_)
                yield pd.DataFrame({"query_id": [None], "doc_id": [None], "far": [None], "looked": [len(rows) * len(ci)]}).astype(kinds)
                if len(rows):
                    c, ids = np.frombuffer(cd).reshape(len(ci), -1), np.asarray(ci)
                    far = np.round(_far(q[rows], c) ** 2, 6) if index_metric == "l2" else -np.round(q[rows] @ c.T, 6)
                    best = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(np.asarray(qi)[rows], best.shape[1]), "doc_id": ids[best].ravel(), "far": np.take_along_axis(far, best, 1).ravel(), "looked": 0})

    return index.blocks.crossJoin(F.broadcast(asked)).mapInPandas(run, "query_id long, doc_id long, far double, looked long")


def _asked(index: Ivf, queries: DataFrame) -> list[DataFrame]:
    """Packed queries (q_ids, q_data) in groups of about dense.SENT bytes, prepared for the metric."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_unit(np.frombuffer(x).reshape(len(i), -1)).tobytes() for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["q_ids", "q_data"])

    packed = dense.pack(queries, "vec_id", "embedding", dense.QUERY_BLOCK, "q")
    packed = (packed.mapInArrow(unit, "q_ids array<long>, q_data binary") if index.metric == "cosine" else packed).checkpoint()
    n = max(1, -(-(packed.agg(F.sum(F.length("q_data"))).collect()[0][0] or 0) // dense.SENT))
    part = F.pmod(F.xxhash64("q_ids"), F.lit(n))
    return [packed.where(part == i) for i in range(n)] if n > 1 else [packed]


def search(index: Ivf, queries: DataFrame, k: int, n_probe: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, score double, rank long) as dense.search() ranks, and one row (n_looked, n_all long): distances
    measured, and those that looking at everything takes.

    All lists are searched, as far as shells can hold a neighbour; with n_probe only that many nearest ones
    (approximate). Null queries have no rows, k <= 0 gives none.
    """
    spark = queries.sparkSession
    if k <= 0 or not len(index.centroids):
        nothing = spark.createDataFrame([], "query_id long, doc_id long, score double")
        return top(nothing, k), spark.createDataFrame([(0, 0)], "n_looked long, n_all long")
    found, looked, groups = [], [], _asked(index, queries)
    before = spark.conf.get(PER_BATCH)
    spark.conf.set(PER_BATCH, str(PAIRS))  # all scans are run, by checkpoint(), before it is set back
    try:
        for asked in groups:
            unknown = asked.withColumn("within", F.transform("q_ids", lambda _: F.lit(float("inf"))))
            if n_probe:
                rows = _scan(index, unknown, k, n_probe)
            else:
                near = _scan(index, unknown, k, 1).where("doc_id IS NOT NULL")
                kth = top(near.withColumn("score", -F.col("far")), k).where(F.col("rank") == k).select("query_id", "far")
                # Scores are rounded to 6 digits, and ties go to the lower id, so the bound is a little wider.
                far = F.sqrt(F.col("far") + 2e-6) if index.metric == "l2" else F.sqrt(F.greatest(F.lit(0.0), 2 + 2 * F.col("far")) + 2e-6)
                # The queries' vectors stay out of the join: a block of them is known by the hash of its ids.
                named = asked.withColumn("block", F.xxhash64("q_ids"))
                bounds = named.select("block", F.posexplode("q_ids").alias("i", "query_id")).join(kth.select("query_id", far.alias("kth")), "query_id", "left")
                bounds = bounds.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("kth", F.lit(float("inf"))).alias("d")))).alias("w"))
                packed = named.join(bounds, "block")
                rows = _scan(index, packed.select("q_ids", "q_data", F.col("w.d").alias("within")).checkpoint(), k, None)
            rows = rows.checkpoint()
            found.append(rows.where("doc_id IS NOT NULL").select("query_id", "doc_id", (-F.col("far")).alias("score")))
            looked.append(rows.agg(F.coalesce(F.sum("looked"), F.lit(0)).alias("n_looked")))
    finally:
        spark.conf.set(PER_BATCH, before)
    hits, counts = found[0], looked[0]
    for a, b in zip(found[1:], looked[1:], strict=True):
        hits, counts = hits.union(a), counts.union(b)
    ranked = top(hits, k)
    ranked = ranked if index.metric == "cosine" else ranked.withColumn("score", F.abs("score"))
    n = index.blocks.agg(F.coalesce(F.sum(F.size("c_ids")), F.lit(0)).alias("n")).crossJoin(F.broadcast(queries.where("embedding IS NOT NULL").agg(F.count("*").alias("m"))))
    return ranked, counts.agg(F.sum("n_looked").alias("n_looked")).crossJoin(F.broadcast(n)).select("n_looked", (F.col("n") * F.col("m")).alias("n_all"))
