"""Search of inverted lists whose model is a few given vectors: exact distances, or asymmetric ones to codes.

Each point belongs to its nearest centroid, and a query looks at the lists of its nearest few. Queries and points lie
in packed blocks; a task takes a pair of blocks list by list, so no row of the plan is a vector's component, and
none is a pair of vectors unless all pairs are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import dense

SCHEMA = "query_id long, doc_id long, d double"
#: Pairs of a batch that a task gives.
OUT = 500_000


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and a few rows y, to 9 digits."""
    return np.round(np.stack([((x - v) ** 2).sum(1) for v in y], 1), 9)


@dataclass
class Given:
    """centroids [k, d] in the order of their ids; words [n, d] of the residuals, cut in m sub-vectors, with their codes."""

    centroids: np.ndarray
    words: np.ndarray
    m: int
    probes: int

    @classmethod
    def of(cls, points: DataFrame, centroids: int, words: int, m: int, probes: int) -> Given:
        """The vectors whose ids are below centroids, then the residuals of as many ids as there are words."""
        rows = sorted((r.vec_id, r.embedding) for r in points.where(f"vec_id < {centroids + words} AND size(embedding) > 0").select("vec_id", "embedding").collect())
        take = lambda low: np.array([v for i, v in rows if (i < centroids) == low], np.float64)
        c, w = take(True), take(False)
        return cls(c, w - c[_squares(w, c).argmin(1)] if len(c) and len(w) else w, m, probes)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _squares(x, self.centroids).argmin(1)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """[queries, lists]: which lists a query looks at."""
        near = np.argsort(_squares(q, self.centroids), axis=1, kind="stable")[:, : self.probes]
        out = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(out, near, True, 1)
        return out

    def codes(self, rest: np.ndarray) -> np.ndarray:
        """[points, m]: the nearest word of each sub-vector of the residuals, the lowest on ties."""
        parts = zip(np.split(rest, self.m, 1), np.split(self.words, self.m, 1), strict=True)
        return np.stack([_squares(r, w).argmin(1) for r, w in parts], 1)

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """[queries, m, words]: squared distances of the residuals' sub-vectors to the words."""
        parts = zip(np.split(rest, self.m, 1), np.split(self.words, self.m, 1), strict=True)
        return np.stack([np.stack([((r - v) ** 2).sum(1) for v in w], 1) for r, w in parts], 1)


def _kept(far: np.ndarray, ids: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and distance of the k nearest of each row, ties to the lower id; all without a k."""
    if k is None:
        return np.repeat(np.arange(len(far)), len(ids)), np.tile(np.arange(len(ids)), len(far)), far.ravel()
    best = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
    return np.repeat(np.arange(len(far)), best.shape[1]), best.ravel(), np.take_along_axis(far, best, 1).ravel()


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _kept, of squared distances; a matrix product finds which pairs can be among them, and these are measured."""
    sq, sx = (q * q).sum(1)[:, None], (x * x).sum(1)
    about = sq + sx - 2 * q @ x.T
    slack = 1e-12 * (sq + sx.max()) + 1e-8
    most = np.inf if k is None or k >= len(x) else np.partition(about, k - 1, 1)[:, k - 1 : k] + slack
    row, at = np.nonzero(about <= most)
    d = np.concatenate([((q[row[i : i + 50_000]] - x[at[i : i + 50_000]]) ** 2).sum(1) for i in range(0, len(row), 50_000)] or [np.empty(0)])
    d = np.round(d, 9)
    if k is None:
        return row, at, d
    order = np.lexsort((ids[at], d, row))
    row, at, d = row[order], at[order], d[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k], d[place < k]


def distances(queries: DataFrame, points: DataFrame, given: Given, coded: bool, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, d): squared distances to 9 digits of queries and the points of the lists they look at, to the
    points themselves or to their codes; of a block and a list only those of the k nearest if k is given."""
    spark = queries.sparkSession
    if not len(given.centroids) or (coded and not len(given.words)):
        return spark.createDataFrame([], SCHEMA)

    def pair(q_ids, q, ids, x) -> Iterator[pa.RecordBatch]:
        mine, probed = given.lists(x), given.probed(q)
        codes = given.codes(x - given.centroids[mine]) if coded else None
        for c in np.unique(mine).tolist():
            at, asks = np.flatnonzero(mine == c), np.flatnonzero(probed[:, c])
            step = max(1, OUT // len(at))
            for some in (asks[i : i + step] for i in range(0, len(asks), step)):
                if coded:
                    table = given.tables(q[some] - given.centroids[c])
                    far = np.round(sum(table[:, j, codes[at, j]] for j in range(given.m)), 9)
                    row, col, d = _kept(far, ids[at], k)
                else:
                    row, col, d = _nearest(q[some], x[at], ids[at], k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[some][row]), pa.array(ids[at][col]), pa.array(d)], ["query_id", "doc_id", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qd, ci, cd in zip(*(b.column(n) for n in ("q_ids", "q_data", "c_ids", "c_data")), strict=True):
                q_ids, ids = (i.values.to_numpy(zero_copy_only=False) for i in (qi, ci))
                q, x = (np.frombuffer(d.as_buffer()).reshape(len(i), -1) for i, d in ((q_ids, qd), (ids, cd)))
                yield from pair(q_ids, q, ids, x)

    filled = lambda df: df.where("size(embedding) > 0")
    return dense.crossed(filled(queries), filled(points), lambda pairs: pairs.mapInArrow(run, SCHEMA), spread=True)


def search(queries: DataFrame, points: DataFrame, given: Given, coded: bool, k: int) -> DataFrame:
    """(query_id, doc_id, score double, rank long): the k nearest of the lists that a query looks at, score 1 / (1 + d)."""
    order = Window.partitionBy("query_id").orderBy("d", "doc_id")
    best = distances(queries, points, given, coded, k).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return best.select("query_id", "doc_id", F.round(1 / (1 + F.col("d")), 6).alias("score"), "rank")
