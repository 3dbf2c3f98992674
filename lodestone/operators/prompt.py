"""Prompts and readable results from ranked hits (query_id, doc_id, text, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The wording of prompts and results.
SYSTEM = "你是一个知识库问答助手。请根据参考文档回答用户问题；文档中没有相关信息时请如实说明。"
DOCUMENTS, HISTORY, QUESTION = "## 参考文档", "## 对话历史", "## 用户问题"
NOTHING = "未找到相关文档。"


def _joined(hits: DataFrame, line, between: str, name: str) -> DataFrame:
    rows = hits.select("query_id", F.struct("rank", line.alias("line")).alias("r")).groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("query_id", F.array_join(F.col("r.line"), between).alias(name))


def build(queries: DataFrame, hits: DataFrame, system: str = SYSTEM, history: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): system, documents in rank order, history (query_id, history) if there is any, question."""
    docs = _joined(hits, F.concat(F.lit("[文档"), F.col("rank"), F.lit("] "), F.col("text")), "\n", "docs")
    rows = queries.select("query_id", F.col("text").alias("question")).join(docs, "query_id", "left")
    rows = rows.join(history, "query_id", "left") if history is not None else rows.withColumn("history", F.lit(None).cast("string"))
    past = F.when(F.length("history") > 0, F.concat(F.lit(f"{HISTORY}\n"), F.col("history"), F.lit("\n")))
    return rows.select("query_id", F.concat_ws("\n", F.lit(system), F.lit(""), F.lit(DOCUMENTS), F.coalesce("docs", F.lit("")), F.lit(""), past, F.lit(QUESTION), "question").alias("prompt"))


def format_results(queries: DataFrame, hits: DataFrame, width: int = 300) -> DataFrame:
    """(query_id, result): source, score and the beginning of each hit; NOTHING without hits."""
    line = F.concat(F.lit("[文档"), F.col("rank"), F.lit("] (来源: "), F.coalesce("source", F.lit("?")), F.lit(", 相关度: "), F.format_string("%.3f", F.round("score", 3)), F.lit(")\n"), F.substring("text", 1, width))
    return queries.select("query_id").join(_joined(hits, line, "\n\n", "found"), "query_id", "left").select("query_id", F.coalesce("found", F.lit(NOTHING)).alias("result"))
