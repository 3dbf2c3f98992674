"""Retrieval quality of ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, n_common long, recall double): exact hits that were found, over k."""
    mark = found.select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(mark, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("hit").alias("n_common"), F.round(F.count("hit") / k, 6).alias("recall"))


def recall(judged: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, n_found, n_relevant, recall) of hits (query_id, rank, grade); 0 where nothing is relevant."""
    by = judged.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("n_found")).join(relevant, "query_id")
    return by.select("query_id", "n_found", "n_relevant", F.round(F.when(F.col("n_relevant") > 0, F.col("n_found") / F.col("n_relevant")).otherwise(0.0), 6).alias("recall"))


def reciprocal_rank(judged: DataFrame) -> DataFrame:
    """(query_id, rr double): one over the rank of the first relevant hit, 0 without one."""
    return judged.groupBy("query_id").agg(F.coalesce(1 / F.min(F.when(F.col("grade") > 0, F.col("rank"))), F.lit(0.0)).alias("rr"))


def ndcg(judged: DataFrame) -> DataFrame:
    """(query_id, ndcg double): gains 2^grade - 1, discounts log2(rank + 1), against the hits' own best order."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    rows = judged.withColumn("ideal", F.row_number().over(best))
    sums = rows.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("got"), F.sum(gain / F.log2(F.col("ideal") + 1)).alias("most"))
    return sums.select("query_id", F.round(F.when(F.col("most") > 0, F.col("got") / F.col("most")).otherwise(0.0), 6).alias("ndcg"))
