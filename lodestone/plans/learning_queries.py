"""Queries of models that are learnt from the tables: words without spaces, and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators import bm25, evaluate, rerank, segmenter
from lodestone.plans.text_queries import K, asked, texts
from lodestone.sources.shared import use_checkpoints

#: Words of a question, words in a row that a relevant document shares with the whole item, and candidates of a question.
QUERY_WORDS, SHARED_WORDS, CANDIDATES = 3, 8, 50


def learnt_words(spark, sf_dir):
    """Stretches of letters in the documents that hang together and stand freely."""
    words = segmenter.learn(segmenter.runs(texts(spark, sf_dir), pattern=segmenter.LETTERS))
    return words.select("word", "size", "freq", *(F.round(c, 6).alias(c) for c in ("cohesion", "left", "right")))


def word_segments(spark, sf_dir):
    """Every distinct run of letters in the documents, cut along the likeliest path of learnt words."""
    use_checkpoints(spark)
    runs = segmenter.runs(texts(spark, sf_dir), pattern=segmenter.LETTERS).checkpoint()  # the texts are read once
    cut = segmenter.fitted_cut(runs, segmenter.learn(runs), segmenter.LETTERS)
    return cut.select("run", "n", F.size("pieces").cast("long").alias("n_pieces"), F.array_join("pieces", "|").alias("pieces"))


def _shingles(text: Column) -> Column:
    def of(w):
        return F.transform(F.filter(w, lambda x, i: i >= SHARED_WORDS - 1), lambda x, i: F.array_join(F.slice(w, i + 1, SHARED_WORDS), " "))

    return F.element_at(F.transform(F.array(tokens(text)), of), 1)


def judged(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id, score, rank, f, double, grade int) of BM25's candidates for short questions: the first words of each
    benchmark item. A document is relevant if it has words in a row of the whole item. Written once, without texts."""
    items = asked(spark, sf_dir).withColumn("query", F.substring_index("text", " ", QUERY_WORDS))
    hits = bm25.top(bm25.scores(texts(spark, sf_dir), items.select("query_id", F.col("query").alias("text"))), CANDIDATES)
    rows = hits.join(texts(spark, sf_dir).withColumnRenamed("text", "content"), "doc_id").join(items, "query_id")
    double = F.contains(F.lower("content"), F.lower(F.substring_index("query", " ", 1))).cast("double")
    grade = F.arrays_overlap(_shingles(F.col("text")), _shingles(F.col("content"))).cast("int")
    use_checkpoints(spark)
    return rerank.features(rows).select("query_id", "doc_id", "score", "rank", "f", double.alias("double"), grade.alias("grade")).checkpoint()


def _held_out():
    return F.crc32(F.col("query_id").cast("string")) % 4 == 2


def learned_rerank(spark, sf_dir):
    """The ten best candidates of every query by a scorer that was trained on three queries in four."""
    rows = judged(spark, sf_dir)
    best = rerank.reranked(rerank.fit(rows.where(~_held_out())).scored(rows), K)
    return best.select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def rerank_quality(spark, sf_dir):
    """Mean nDCG@10 over the queries that the scorer has not seen: as BM25 ranks, by the query's first word, and as it ranks itself."""
    rows = judged(spark, sf_dir)
    unseen = rows.where(_held_out())
    ways = {"none": rerank.none(unseen), "first word": unseen.withColumn("rerank_score", F.col("double")), "learned": rerank.fit(rows.where(~_held_out())).scored(unseen)}

    def mean(name: str, scored: DataFrame) -> DataFrame:
        all_ranked = rerank.reranked(scored, CANDIDATES).withColumn("grade", F.when(F.col("rank") <= K, F.col("grade")).otherwise(0))
        return evaluate.ndcg(all_ranked).agg(F.count("*").alias("n_queries"), F.round(F.avg("ndcg"), 6).alias("ndcg")).select(F.lit(name).alias("ranking"), "n_queries", "ndcg")

    return reduce(DataFrame.union, (mean(*x) for x in ways.items()))


QUERIES = (learnt_words, word_segments, learned_rerank, rerank_quality)

ORACLE = {
    "learnt_words": f"""
WITH r AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{segmenter.LETTERS}')) AS run FROM documents) GROUP BY run),
p AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM r),
g AS (SELECT run[i:i + size - 1] AS word, size::INT AS size, CASE WHEN i > 1 THEN run[i - 1:i - 1] ELSE '' END AS b, run[i + size:i + size] AS a, sum(n) AS n
  FROM (SELECT *, unnest(range(1, least({segmenter.LONGEST}, length(run) - i + 1) + 1)) AS size FROM p) GROUP BY ALL),
f AS (SELECT word, size, sum(n)::BIGINT AS freq FROM g GROUP BY ALL HAVING sum(n) >= {segmenter.MIN_COUNT}),
t AS (SELECT sum(freq)::DOUBLE AS total FROM f WHERE size = 1),
c AS (SELECT word, freq, word[1:k] AS x, word[k + 1:] AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size > 1)),
h AS (SELECT c.word, min(ln(c.freq * total / fx.freq / fy.freq)) AS cohesion FROM c JOIN f fx ON fx.word = x JOIN f fy ON fy.word = y CROSS JOIN t GROUP BY c.word),
l AS (SELECT word, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e FROM (SELECT word, b, sum(n)::DOUBLE AS n FROM g GROUP BY ALL) GROUP BY word),
q AS (SELECT word, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS e FROM (SELECT word, a, sum(n)::DOUBLE AS n FROM g GROUP BY ALL) GROUP BY word)
SELECT word, size, freq, round(cohesion, 6) AS cohesion, round(l.e, 6) AS left, round(q.e, 6) AS right FROM f LEFT JOIN h USING (word) JOIN l USING (word) JOIN q USING (word)
WHERE (size = 1 OR cohesion >= {segmenter.COHESION}) AND least(l.e, q.e) >= {segmenter.ENTROPY}""",
}
