"""Rerankers: a model over batches of pairs, one that is trained here on pairs of candidates, and none.

Candidates are (query_id, doc_id, query, content, score, rank). A model sees lists of (query, content) of similar
length and is loaded once for each worker. The trained scorer is linear in features that are plain
columns; its loss counts every pair of a relevant and another candidate of a query, and each Newton
step sums gradient and Hessian over the queries in the tasks, so a few numbers a task reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.bm25 import top
from lodestone.sources.shared import use_checkpoints

#: load() gives a function of a list of (query, content) that returns their scores.
Load = Callable[[], Callable[[list[tuple[str, str]]], list[float]]]
FEATURES = ("score", "coverage", "pairs", "first", "length")
#: Ridge on the weights, Newton steps at most, and the step below which they end.
RIDGE, STEPS, CLOSE = 1e-3, 25, 1e-8


def none(rows: DataFrame) -> DataFrame:
    """No reranking: rerank_score is the score there is."""
    return rows.withColumn("rerank_score", F.col("score").cast("double"))


def batches(rows: DataFrame, load: Load, size: int = 32, profile=None) -> DataFrame:
    """rows with rerank_score of a model, which sees at most size pairs at once, of similar length.

    Pairs of one Arrow batch are put in order of length for the model and back again. profile is a
    ResourceProfile, for a stage that needs other executors than its neighbours (a model on GPUs, say).
    Null texts are empty ones. A model that gives another number of scores than it got pairs raises.
    """
    if size < 1:
        raise ValueError("size is 1 or more")
    keep = [c for c in rows.columns if c != "rerank_score"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in parts:
            model = model or load()
            texts = ([x or "" for x in b.column(c).to_pylist()] for c in ("query", "content"))
            pairs = list(zip(*texts, strict=True))
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
            scores = np.empty(len(pairs))
            for i in range(0, len(order), size):
                some = order[i : i + size]
                given = model([pairs[j] for j in some])
                if len(given) != len(some):
                    raise ValueError(f"{len(given)} scores for {len(some)} pairs")
                scores[some] = given
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*keep, "rerank_score"])

    fields = [*rows.select(*keep).schema.fields]
    schema = type(rows.schema)(fields).add("rerank_score", "double")
    return rows.select(*keep).mapInArrow(run, schema, profile=profile)


def reranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best by rerank_score of each query, with new ranks; ties keep the earlier rank."""
    order = rows.withColumn("_by", F.struct(F.col("rerank_score"), -F.col("rank"))).drop("rank")
    return top(order, k, "_by").drop("_by")


# -- the trained scorer


def features(rows: DataFrame) -> DataFrame:
    """rows with f array<double> of FEATURES: score over the query's first score, share of the query's distinct
    words and pairs of neighbours that the content has, whether it has the first, log of its length.
    Nothing but the content's own words is looked at, however long; empty texts give zeros."""
    words = lambda c: tokens(F.col(c))

    def pairs(w: Column) -> Column:
        return F.transform(F.filter(w, lambda x, i: i > 0), lambda x, i: F.concat_ws(" ", F.get(w, i), x))

    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)
    # Words are lambda variables, so that no optimiser splits a text once for every feature.
    of_pair = F.transform(
        F.array(F.struct(words("query").alias("q"), words("content").alias("d"))),
        lambda x: F.array(
            share(x["q"], x["d"]),
            share(pairs(x["q"]), pairs(x["d"])),
            F.when(F.array_contains(x["d"], F.coalesce(F.get(x["q"], 0), F.lit(""))), 1.0).otherwise(0.0),
            F.log1p(F.size(x["d"])),
        ),
    )
    first = rows.groupBy("query_id").agg(F.max("score").alias("_best"))
    score = F.when(F.col("_best") > 0, F.col("score") / F.col("_best")).otherwise(0.0)
    return rows.join(first, "query_id").withColumn("f", F.concat(F.array(score), F.element_at(of_pair, 1))).drop("_best")


@dataclass
class Scorer:
    """Weights of the standardised features, as one vector over the features as they are."""

    weights: np.ndarray

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with rerank_score; rows have f."""
        parts = F.zip_with("f", F.lit([float(w) for w in self.weights]), lambda x, w: x * w)
        return rows.withColumn("rerank_score", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def pair_sums(x: np.ndarray, relevant: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Loss, gradient and Hessian of log(1 + exp(-w(a - b))) over the pairs of a relevant a and another b, and their number."""
    d = (x[relevant][:, None, :] - x[~relevant][None, :, :]).reshape(-1, x.shape[1])
    z = d @ w
    p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
    return float(np.logaddexp(0, -z).sum()), -(p[:, None] * d).sum(0), (d * (p * (1 - p))[:, None]).T @ d, len(d)


def fit(judged: DataFrame, ridge: float = RIDGE) -> Scorer:
    """A scorer from candidates (query_id, f array<double>, grade): grade > 0 is relevant.

    Queries whose candidates are all relevant, or none, teach nothing; without any other, weights are 0.
    A query's candidates, which a retrieval bounds, are one row. Null grades are not relevant.
    """
    use_checkpoints(judged.sparkSession)
    by = judged.select("query_id", "f", (F.coalesce(F.col("grade"), F.lit(0)) > 0).alias("g"))
    groups = by.groupBy("query_id").agg(F.collect_list(F.struct("f", "g")).alias("c")).where(F.exists("c", lambda x: x["g"]) & F.exists("c", lambda x: ~x["g"]))
    groups = groups.select(F.col("c.f").alias("f"), F.col("c.g").alias("g")).checkpoint()
    size = groups.agg(F.max(F.size(F.get("f", 0)))).collect()[0][0]
    if not size:
        return Scorer(np.zeros(len(FEATURES)))
    each = groups.select(F.explode("f").alias("f")).select(F.posexplode("f").alias("i", "x"))
    moments = {r.i: (r.m, r.s) for r in each.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
    spread = np.array([moments[i][1] if moments[i][1] > 1e-12 else math.inf for i in range(size)])
    w = np.zeros(size)

    def total(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(2 + size + size * size)
            for b in parts:
                for f, g in zip(b["f"], b["g"], strict=True):
                    loss, grad, hess, n = pair_sums(np.stack(f) / spread, np.asarray(g, bool), w)
                    sums += np.concatenate(([loss, n], grad, hess.ravel())) / max(1, n)  # a query counts once, however many pairs
            yield pd.DataFrame({"i": np.arange(len(sums)), "x": sums})

        rows = groups.mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        s = np.array([r.x for r in sorted(rows, key=lambda r: r.i)])
        n = max(1.0, s[1])
        return s[0] / n + ridge / 2 * w @ w, s[2 : 2 + size] / n + ridge * w, s[2 + size :].reshape(size, size) / n + ridge * np.eye(size)

    loss, grad, hess = total(w)
    for _ in range(STEPS):
        step = np.linalg.solve(hess, grad)
        if np.abs(step).max() < CLOSE:
            break
        scale = 1.0
        while True:  # halved until the loss falls
            tried = total(w - scale * step)
            if tried[0] <= loss or scale < 1e-6:
                break
            scale /= 2
        w = w - scale * step
        loss, grad, hess = tried
    return Scorer(w / spread)
