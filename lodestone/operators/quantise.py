"""k-means, product quantisation and inverted lists.

Training packs the points once, then loops over passes: tasks assign their blocks with a matrix product, and
sums by centroid are merged in a tree of tasks, so what moves is bounded by the model's size. All
sub-quantisers are trained in one pass over residuals that are taken in the task. Null vectors are left
out everywhere. Codes live in a table by cluster; a search joins packed blocks of it with the queries
that probe the cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dense
from lodestone.operators.bm25 import top
from lodestone.sources import manifest
from lodestone.sources.shared import use_checkpoints

#: Queries of a cluster that are searched together, and probes up to which queries are sent to all tasks.
QUERY_GROUP, SENT = 1024, 100_000
#: Points of a block that training looks at together.
BLOCK = 2048


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, lowest index on ties (distances to 9 digits)."""
    d = np.round((x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T, 9)
    return d.argmin(1)


def matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values]) if len(values) else np.empty((0, 0))


def _valid(points: DataFrame) -> DataFrame:
    return points.select("vec_id", "embedding").where("embedding IS NOT NULL")


def _start(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k points of lowest id hash. Those of a share of the hashes that holds about twice as many are
    looked at, or of a larger one if it holds too few, so that what is collected follows k alone."""
    rows = _valid(points).select(F.xxhash64("vec_id", F.lit(seed)).alias("h"), "vec_id", "embedding")
    n, tried = rows.count(), 2 * k + 64
    while True:
        low = rows if tried >= n else rows.where(F.col("h") < -(2**63) + tried * 2**64 // n)
        found = low.dropDuplicates(["h"]).collect()
        if len(found) >= k or tried >= n:
            return matrix([r.embedding for r in sorted(found, key=lambda r: (r.h, r.vec_id))[:k]])
        tried *= 2


def _packed(points: DataFrame) -> DataFrame:
    """Blocks (p_ids, p_data) of the points, written once for all passes."""
    use_checkpoints(points.sparkSession)
    return dense.pack(points, "vec_id", "embedding", BLOCK, "p").checkpoint()


def _added(near: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums [k, d] and counts [k] of the rows of x by cluster."""
    order = np.argsort(near, kind="stable")
    n = np.bincount(near, minlength=k)
    sums = np.zeros((k, x.shape[1]))
    some = np.flatnonzero(n)
    if len(some):
        sums[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0)
    return sums, n


def lloyd(blocks: DataFrame, start: np.ndarray, passes: int, coarse: np.ndarray | None = None) -> np.ndarray:
    """Centroids [m, k, d/m] after Lloyd passes from start over packed points, or over their residuals to coarse.

    m sub-vectors are clustered independently. An empty cluster keeps its centroid; passes end early
    when no centroid moves.
    """
    centroids = start
    m, k, d = start.shape
    for _ in range(passes):

        def run(batches: Iterator[pa.RecordBatch], c=centroids) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((m, k, d + 1))
            for b in batches:
                for raw in b.column(0):
                    x = np.frombuffer(raw.as_py()).reshape(-1, m * d)
                    x = x if coarse is None else x - coarse[nearest(x, coarse)]
                    for j in range(m):
                        part = x[:, j * d : (j + 1) * d]
                        added, n = _added(nearest(part, c[j]), part, k)
                        sums[j, :, :d] += added
                        sums[j, :, d] += n
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["s"])

        parts = blocks.select("p_data").mapInArrow(run, "s binary").rdd.map(lambda r: bytes(r.s))
        if not parts.getNumPartitions():
            break
        sums = np.frombuffer(parts.treeReduce(lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes())).reshape(m, k, d + 1)
        n = sums[:, :, d:]
        moved = np.where(n > 0, sums[:, :, :d] / np.where(n > 0, n, 1), centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


@dataclass
class IvfPq:
    """centroids [k, d]; words [m, 2^bits or fewer, d/m] of the residuals."""

    centroids: np.ndarray
    words: np.ndarray

    def size(self, n: int) -> int:
        """Bytes of an index of n vectors: float32 centroids and words, 4-byte ids, one byte per code."""
        return 4 * self.centroids.size + 4 * self.words.size + 4 * n + n * len(self.words)


def fit_kmeans(points: DataFrame, k: int, passes: int = 25, seed: int = 42) -> np.ndarray:
    """Centroids [k, d]; fewer points than k give as many centroids as points."""
    if k <= 0:
        raise ValueError("k must be positive")
    start = _start(points, k, seed)
    return lloyd(_packed(points), start[None], passes)[0] if len(start) else start


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": nearest(matrix(b["embedding"]), centroids)})

    return _valid(points).mapInPandas(run, "vec_id long, cluster long")


def residuals(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster long, embedding array<double>): points less their nearest centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = matrix(b["embedding"])
                near = nearest(x, centroids)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": near, "embedding": [v.tolist() for v in x - centroids[near]]})

    return _valid(points).mapInPandas(run, "vec_id long, cluster long, embedding array<double>")


def fit_ivfpq(points: DataFrame, n_clusters: int = 256, n_subvectors: int = 64, n_bits: int = 8, passes: int = 25, seed: int = 42) -> IvfPq:
    """Coarse centroids, then sub-quantisers of the residuals."""
    if not 1 <= n_bits <= 8:
        raise ValueError("n_bits is from 1 to 8")
    if n_clusters <= 0:
        raise ValueError("k must be positive")
    first = _start(points, max(n_clusters, 2**n_bits), seed)
    if not len(first):
        raise ValueError("there are no vectors")
    if first.shape[1] % n_subvectors:
        raise ValueError("the dimension must be a multiple of n_subvectors")
    blocks = _packed(points)
    centroids = lloyd(blocks, first[None, :n_clusters], passes)[0]
    start = first[: 2**n_bits] - centroids[nearest(first[: 2**n_bits], centroids)]
    start = start.reshape(len(start), n_subvectors, -1).transpose(1, 0, 2)
    return IvfPq(centroids, lloyd(blocks, np.ascontiguousarray(start), passes, centroids))


def encode(points: DataFrame, index: IvfPq) -> DataFrame:
    """(vec_id, cluster long, codes binary): one byte per sub-vector."""
    m, _, d = index.words.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = matrix(b["embedding"])
                near = nearest(x, index.centroids)
                rest = x - index.centroids[near]
                codes = np.stack([nearest(rest[:, j * d : (j + 1) * d], index.words[j]) for j in range(m)], 1).astype(np.uint8)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": near, "codes": [c.tobytes() for c in codes]})

    return _valid(points).mapInPandas(run, "vec_id long, cluster long, codes binary")


def search(codes: DataFrame, index: IvfPq, queries: DataFrame, k: int, n_probe: int = 8) -> DataFrame:
    """(query_id, doc_id, score double, rank long): approximate neighbours by asymmetric distances, score 1 / (1 + d)."""
    m, words, d = index.words.shape
    probes = min(n_probe, len(index.centroids))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                q = matrix(b["embedding"])
                far = np.round((q * q).sum(1)[:, None] + (index.centroids**2).sum(1) - 2 * q @ index.centroids.T, 9)
                near = np.argsort(far, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": np.repeat(b["vec_id"].to_numpy(), probes), "cluster": near.ravel(), "q": [v.tolist() for v in np.repeat(q, probes, 0)]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cluster, ids, raw, q_ids, q in zip(b["cluster"], b["ids"], b["codes"], b["q_ids"], b["q"], strict=True):
                table = np.frombuffer(raw, np.uint8).reshape(-1, m)
                rest = (matrix(q) - index.centroids[cluster]).reshape(-1, m, 1, d)
                adc = ((rest - index.words[None]) ** 2).sum(3)  # [queries, m, words]
                far = np.round(sum(adc[:, j, table[:, j]] for j in range(m)), 9)
                ids = np.asarray(ids)
                best = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
                near = 1 / (1 + np.take_along_axis(far, best, 1))
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(q_ids), best.shape[1]), "doc_id": ids[best].ravel(), "score": np.round(near.ravel(), 6)})

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cluster, g in b.groupby("cluster"):
                yield pd.DataFrame({"cluster": [cluster], "ids": [g["vec_id"].to_numpy()], "codes": [b"".join(g["codes"])]})

    packed = codes.mapInPandas(lists, "cluster long, ids array<long>, codes binary")
    asked = _valid(queries).mapInPandas(probe, "query_id long, cluster long, q array<double>")
    # A cluster's queries go in groups whose number follows theirs, so that no row of the join grows with it.
    n = queries.count()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(1 + n // QUERY_GROUP)))
    asked = asked.groupBy("cluster", "part").agg(F.collect_list("query_id").alias("q_ids"), F.collect_list("q").alias("q"))
    found = packed.join(F.broadcast(asked) if n * probes <= SENT else asked, "cluster").mapInPandas(scan, "query_id long, doc_id long, score double")
    return top(found, k)


def save(codes: DataFrame, index: IvfPq, path: str) -> int:
    """Store an index below path as its next version, which readers see whole or not at all; the version.

    Codes by cluster and the model's vectors are Parquet tables; the manifest has what they must amount to. An
    index without codes raises, as do codes that load() would not take.
    """
    spark, name = codes.sparkSession, uuid.uuid4().hex
    version, _ = manifest.read(spark, path)
    codes.write.partitionBy("cluster").parquet(f"{path}/codes-{name}")
    rows = [("centroid", 0, i, v.tolist()) for i, v in enumerate(index.centroids)] + [("word", j, i, v.tolist()) for j, w in enumerate(index.words) for i, v in enumerate(w)]
    spark.createDataFrame(rows, "kind string, m long, i long, x array<double>").write.parquet(f"{path}/model-{name}")
    found = _amounts(_read_codes(spark, f"{path}/codes-{name}"), index)
    _check(path, found, index)
    m, words, d = index.words.shape
    shape = {"dim": m * d, "clusters": len(index.centroids), "subvectors": m, "words": words}
    return manifest.publish(spark, path, version, {"codes": f"codes-{name}", "model": f"model-{name}", **shape, "count": found["count"], "digest": found["digest"]})


def _read_codes(spark, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, codes binary, cluster long").parquet(path).select("vec_id", "cluster", "codes")


def _amounts(codes: DataFrame, index: IvfPq) -> dict:
    """What a table of codes amounts to, by one aggregate: counts of rows that break each rule, ids, rows, and a digest of all rows."""
    m, words, _ = index.words.shape
    digits = F.hex("codes")
    most = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.substring(digits, 2 * i + 1, F.lit(2))))
    row = codes.select("*", F.xxhash64("vec_id", "cluster", "codes").cast("decimal(38,0)").alias("h"), (most > f"{words - 1:02X}").alias("beyond"))
    return row.agg(
        F.count("*").alias("count"),
        F.count_distinct("vec_id").alias("ids"),
        F.count_if(F.col("vec_id").isNull() | F.col("cluster").isNull() | F.col("codes").isNull()).alias("nulls"),
        F.count_if(~F.col("cluster").between(0, len(index.centroids) - 1)).alias("clusters"),
        F.count_if(F.octet_length("codes") != m).alias("lengths"),
        F.count_if("beyond").alias("words"),
        F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"),
    ).collect()[0].asDict()


def _check(path: str, found: dict, index: IvfPq) -> None:
    said = {"nulls": "null ids, clusters or codes", "clusters": "clusters that there are not", "lengths": "codes of another length", "words": "codes beyond the trained words"}
    wrong = [f"{found[k]} rows with {x}" for k, x in said.items() if found[k]]
    if found["ids"] != found["count"]:
        wrong.append("repeated ids")
    if not found["count"]:
        wrong.append("no vectors")
    if wrong:
        raise ValueError(f"{path}: not a consistent index: {', '.join(wrong)}")


def load(spark, path: str, version: int | None = None, check: bool = True) -> tuple[DataFrame, IvfPq]:
    """What save() wrote, the latest version by default; an inconsistent index raises ValueError, a missing one FileNotFoundError.

    Ids are unique, codes lie below the trained words, clusters exist, nothing is null, and rows are as many and
    the same as the manifest says. check=False leaves out the pass over the codes. Folders from before
    there were manifests are read as well.
    """
    number, body = manifest.read(spark, path, version)
    names = (body["codes"], body["model"]) if number else ("codes", "model")
    if not number and not manifest.exists(spark, f"{path}/model"):
        raise FileNotFoundError(f"{path}: no index")
    rows = spark.read.parquet(f"{path}/{names[1]}").collect()  # the model
    centroids = matrix([r.x for r in sorted((r for r in rows if r.kind == "centroid"), key=lambda r: r.i)])
    m = 1 + max((r.m for r in rows if r.kind == "word"), default=-1)
    words = [[r.x for r in sorted((r for r in rows if r.kind == "word" and r.m == j), key=lambda r: r.i)] for j in range(m)]
    sizes = {len(w) for w in words} | {-len(x) for w in words for x in w}
    if not m or len(sizes) != 2 or min(sizes) * -m != centroids.shape[1] or not 1 <= max(sizes) <= 256:
        raise ValueError(f"{path}: not a consistent model")
    index, codes = IvfPq(centroids, np.array(words)), _read_codes(spark, f"{path}/{names[0]}")
    shape = (centroids.shape[1], len(centroids), m, index.words.shape[1])
    if number and shape != tuple(body[k] for k in ("dim", "clusters", "subvectors", "words")):
        raise ValueError(f"{path}: the model is not that of the manifest")
    if check:
        found = _amounts(codes, index)
        _check(path, found, index)
        if number and (found["count"], found["digest"]) != (body["count"], body["digest"]):
            raise ValueError(f"{path}: the codes are not those of the manifest")
    return codes, index
