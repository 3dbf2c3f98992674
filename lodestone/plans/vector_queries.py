"""Queries over embeddings: exact search, clustering, quantisation, evaluation.

The oracle-checked forms are SQL in which both engines agree: vectors in long form (vec_id, pos,
x), distances as sums over joins. Searches, whose joins would be of the size queries x points, and the
trained forms use the Arrow operators and are tested to agree with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import bm25, dense, evaluate, probed, quantise

K = 10
#: The oracle-checked quantiser: the first vectors are the coarse centroids, the next residuals the words.
CENTROIDS, WORDS, SUBVECTORS, PROBES = 8, 16, 8, 3


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def asked(spark, sf_dir) -> DataFrame:
    """The searches' stated query set: every id divisible by 20."""
    return points(spark, sf_dir).where("vec_id % 20 = 0")


def cosine_topk_batch(spark, sf_dir):
    return dense.search(asked(spark, sf_dir), points(spark, sf_dir), K)


def l2_topk(spark, sf_dir):
    return dense.search(asked(spark, sf_dir), points(spark, sf_dir), K, "l2")


def cosine_topk_single(spark, sf_dir):
    """One query, the mean vector of label 0, by built-in functions: a sort that keeps k rows."""
    mean = points(spark, sf_dir).where("label = 0").select(F.posexplode("embedding").alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    query = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("q"))
    rows = points(spark, sf_dir).crossJoin(F.broadcast(query))  # one row
    score = vectors.dot(vectors.normalised(F.col("embedding")), vectors.normalised(F.col("q")))
    return rows.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(K)


def l2_normalize(spark, sf_dir):
    rows = points(spark, sf_dir).select("vec_id", F.posexplode(vectors.normalised(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long"), F.round("x", 6).alias("x"))


def int8_quantize(spark, sf_dir):
    rows = points(spark, sf_dir).select("vec_id", F.col("embedding").alias("v"), vectors.int8(F.col("embedding")).alias("q"))
    back = F.transform("q.q", lambda x: x * F.col("q.scale"))
    error = F.aggregate(F.zip_with(vectors.doubles(F.col("v")), back, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return rows.select("vec_id", F.round("q.scale", 6).alias("scale"), F.aggregate("q.q", F.lit(0), lambda a, x: a + x).cast("long").alias("q_sum"), F.round(error, 6).alias("mae"))


#: Clauses of the quantisation chain; {lv} is the long form, which the engines spell differently.
LONG = {
    "spark": "SELECT vec_id, pos, CAST(x AS DOUBLE) AS x FROM {emb} LATERAL VIEW posexplode(embedding) AS pos, x",
    "duck": "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings",
}
CHAIN = f"""
cen AS (SELECT vec_id AS cluster, pos, x AS c FROM lv WHERE vec_id < {CENTROIDS}),
cd AS (SELECT l.vec_id, n.cluster, round(sum((l.x - n.c) * (l.x - n.c)), 9) AS d FROM lv l JOIN cen n ON l.pos = n.pos GROUP BY l.vec_id, n.cluster),
near AS (SELECT vec_id, cluster, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM cd),
mine AS (SELECT vec_id, cluster, d FROM near WHERE r = 1),
probe AS (SELECT vec_id AS query_id, cluster, d, r FROM near WHERE r <= {PROBES} AND vec_id % 20 = 0)"""
LLOYD = """
c1 AS (SELECT n.cluster, n.pos, coalesce(m.x, n.c) AS c FROM cen n LEFT JOIN (SELECT a.cluster, l.pos, avg(l.x) AS x FROM mine a JOIN lv l ON l.vec_id = a.vec_id GROUP BY a.cluster, l.pos) m ON m.cluster = n.cluster AND m.pos = n.pos)"""
LLOYD2 = f"""{LLOYD},
d2 AS (SELECT l.vec_id, n.cluster, round(sum((l.x - n.c) * (l.x - n.c)), 9) AS d FROM lv l JOIN c1 n ON l.pos = n.pos GROUP BY l.vec_id, n.cluster),
mine2 AS (SELECT vec_id, cluster, d FROM (SELECT vec_id, cluster, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS r FROM d2) t WHERE r = 1)"""
PQ = f"""
res AS (SELECT l.vec_id, a.cluster, l.pos, l.x - n.c AS x FROM lv l JOIN mine a ON a.vec_id = l.vec_id JOIN cen n ON n.cluster = a.cluster AND n.pos = l.pos),
word AS (SELECT vec_id - {CENTROIDS} AS code, pos, x AS w FROM res WHERE vec_id >= {CENTROIDS} AND vec_id < {CENTROIDS + WORDS}),
wd AS (SELECT r.vec_id, CAST(floor(r.pos / {64 // SUBVECTORS}) AS INT) AS m, w.code, round(sum((r.x - w.w) * (r.x - w.w)), 9) AS d FROM res r JOIN word w ON w.pos = r.pos GROUP BY r.vec_id, CAST(floor(r.pos / {64 // SUBVECTORS}) AS INT), w.code),
code AS (SELECT vec_id, m, code FROM (SELECT vec_id, m, code, row_number() OVER (PARTITION BY vec_id, m ORDER BY d, code) AS r FROM wd) t WHERE r = 1)"""
ADC = f"""
qr AS (SELECT p.query_id, p.cluster, l.pos, l.x - n.c AS x FROM probe p JOIN lv l ON l.vec_id = p.query_id JOIN cen n ON n.cluster = p.cluster AND n.pos = l.pos),
tab AS (SELECT q.query_id, q.cluster, CAST(floor(q.pos / {64 // SUBVECTORS}) AS INT) AS m, w.code, sum((q.x - w.w) * (q.x - w.w)) AS d FROM qr q JOIN word w ON w.pos = q.pos GROUP BY q.query_id, q.cluster, CAST(floor(q.pos / {64 // SUBVECTORS}) AS INT), w.code),
adc AS (SELECT p.query_id, a.vec_id AS doc_id, round(sum(t.d), 9) AS d FROM probe p JOIN mine a ON a.cluster = p.cluster JOIN code c ON c.vec_id = a.vec_id JOIN tab t ON t.query_id = p.query_id AND t.cluster = p.cluster AND t.m = c.m AND t.code = c.code GROUP BY p.query_id, a.vec_id)"""
EXACT = """
ivf AS (SELECT p.query_id, a.vec_id AS doc_id, round(sum((q.x - l.x) * (q.x - l.x)), 9) AS d FROM probe p JOIN mine a ON a.cluster = p.cluster JOIN lv q ON q.vec_id = p.query_id JOIN lv l ON l.vec_id = a.vec_id AND l.pos = q.pos GROUP BY p.query_id, a.vec_id)"""


def _best(rows: str) -> str:
    return f"SELECT query_id, doc_id, round(1 / (1 + d), 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT query_id, doc_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank FROM {rows}) t WHERE rank <= {K}"


#: name -> (clauses, final SELECT), the same text for both engines.
SQL = {
    "centroid_distances": ("", "SELECT vec_id, cluster, round(d, 6) AS d FROM cd"),
    "kmeans_assign_step": ("", "SELECT vec_id, cluster, round(d, 6) AS d FROM mine"),
    "kmeans_update_step": (LLOYD, "SELECT cluster, CAST(pos AS BIGINT) AS pos, round(c, 6) AS c FROM c1"),
    "kmeans_lloyd2": (LLOYD2, "SELECT vec_id, cluster, round(d, 6) AS d FROM mine2"),
    "ivf_probe": ("", "SELECT query_id, cluster, round(d, 6) AS d, CAST(r AS BIGINT) AS rank FROM probe"),
    "ivf_search": (EXACT, _best("ivf")),
    "pq_encode": (PQ, "SELECT vec_id, CAST(m AS BIGINT) AS m, CAST(code AS BIGINT) AS code FROM code"),
    "pq_adc": (f"{PQ}, {ADC}", "SELECT query_id, doc_id, round(d, 6) AS d FROM adc"),
    "ivfpq_search": (f"{PQ}, {ADC}", _best("adc")),
}

#: Of these, the ones whose joins are of the size queries x points: they run over packed blocks instead.
PACKED = ("ivf_search", "pq_adc", "ivfpq_search")


def _chain(name: str):
    clauses, final = SQL[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(f"WITH lv AS ({LONG['spark']}), {', '.join(filter(None, (CHAIN, clauses)))} {final}", emb=points(spark, sf_dir))

    query.__name__ = name
    return query


def _given(spark, sf_dir) -> probed.Given:
    return probed.Given.of(points(spark, sf_dir), CENTROIDS, WORDS, SUBVECTORS, PROBES)


def ivf_search(spark, sf_dir):
    return probed.search(asked(spark, sf_dir), points(spark, sf_dir), _given(spark, sf_dir), False, K)


def pq_adc(spark, sf_dir):
    """All pairs of a query and a code of the lists it looks at, which is what the SQL gives."""
    found = probed.distances(asked(spark, sf_dir), points(spark, sf_dir), _given(spark, sf_dir), True)
    return found.withColumn("d", F.round("d", 6))


def ivfpq_search(spark, sf_dir):
    return probed.search(asked(spark, sf_dir), points(spark, sf_dir), _given(spark, sf_dir), True, K)


def ivfpq_size(spark, sf_dir):
    """Index bytes by the closed form, for the published parameters and this table."""
    n = points(spark, sf_dir).agg(F.count("*").alias("n"), F.first(F.size("embedding")).alias("dim"))
    total = F.lit(4 * 64) * F.col("dim") + F.lit(4 * 16) * F.col("dim") + 4 * F.col("n") + F.col("n") * 8
    return n.select("n", (F.col("n") * 8).alias("codes_bytes"), total.cast("long").alias("index_bytes"), (F.col("n") * F.col("dim") * 4).alias("vector_bytes"))


def kmeans_fit(spark, sf_dir):
    p = points(spark, sf_dir)
    return quantise.assign(p, quantise.fit_kmeans(p, 10))


def _trained(spark, sf_dir):
    p = points(spark, sf_dir)
    index = quantise.fit_ivfpq(p, 16, 16, 6, passes=8)
    return quantise.search(quantise.encode(p, index), index, asked(spark, sf_dir), K, 8)


def ivfpq_trained_search(spark, sf_dir):
    return _trained(spark, sf_dir)


def ann_recall(spark, sf_dir):
    """Recall@10 of the fixed IVF-PQ against exact neighbours."""
    return evaluate.overlap(l2_topk(spark, sf_dir), ivfpq_search(spark, sf_dir), K)


def _judged(spark, sf_dir):
    """Exact neighbours other than the query, with grade 1 for its label and 2 if the ids are near as well."""
    hits = dense.search(asked(spark, sf_dir), points(spark, sf_dir), K + 1).where("doc_id <> query_id").drop("rank")
    hits = bm25.top(hits, K)
    label = points(spark, sf_dir).select("vec_id", "label")
    rows = hits.join(label.toDF("query_id", "q"), "query_id").join(label.toDF("doc_id", "d"), "doc_id")
    same = F.col("q") == F.col("d")
    return rows.select("query_id", "doc_id", "rank", F.when(same & (F.abs(F.col("query_id") - F.col("doc_id")) % 3 == 0), 2).when(same, 1).otherwise(0).alias("grade"))


def _relevant(spark, sf_dir):
    """Number of other vectors of a query's label."""
    p = points(spark, sf_dir)
    by = p.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return asked(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "label").join(by, "label").select("query_id", "n_relevant")


def recall_at_k(spark, sf_dir):
    return evaluate.recall(_judged(spark, sf_dir), _relevant(spark, sf_dir))


def mrr(spark, sf_dir):
    return evaluate.reciprocal_rank(_judged(spark, sf_dir)).agg(F.count("*").alias("n_queries"), F.round(F.avg("rr"), 6).alias("mrr"))


def ndcg(spark, sf_dir):
    return evaluate.ndcg(_judged(spark, sf_dir))


QUERIES = (cosine_topk_batch, cosine_topk_single, l2_topk, l2_normalize, int8_quantize, *(_chain(name) for name in SQL if name not in PACKED), ivf_search, pq_adc, ivfpq_search, ivfpq_size, kmeans_fit, ivfpq_trained_search, ann_recall, recall_at_k, mrr, ndcg)

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"round({_DOT} / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
_PAIRS = f"SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0"
_FAR = "SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0"
_L2 = f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM ({_FAR}) QUALIFY rank <= {K}"
_JUDGED = f"""judged AS (SELECT h.query_id, h.doc_id, h.rank, CASE WHEN q.label = d.label AND abs(h.query_id - h.doc_id) % 3 = 0 THEN 2 WHEN q.label = d.label THEN 1 ELSE 0 END AS grade
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM ({_PAIRS})) WHERE r <= {K + 1} AND doc_id <> query_id) QUALIFY rank <= {K}) h
JOIN embeddings q ON q.vec_id = h.query_id JOIN embeddings d ON d.vec_id = h.doc_id)"""
_LV = f"lv AS ({LONG['duck']})"

ORACLE = {
    **{name: f"WITH {_LV}, {', '.join(filter(None, (CHAIN, clauses)))} {final}" for name, (clauses, final) in SQL.items()},
    "cosine_topk_batch": f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_PAIRS}) QUALIFY rank <= {K}",
    "l2_topk": _L2,
    "cosine_topk_single": f"WITH m AS (SELECT list(x ORDER BY pos) AS embedding FROM (SELECT pos, avg(x) AS x FROM ({LONG['duck']}) JOIN embeddings USING (vec_id) WHERE label = 0 GROUP BY pos)) SELECT a.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN m b ORDER BY score DESC, vec_id LIMIT {K}",
    "l2_normalize": f"WITH {_LV} SELECT vec_id, pos::BIGINT AS pos, round(x / n, 6) AS x FROM lv JOIN (SELECT vec_id, sqrt(sum(x * x)) AS n FROM lv GROUP BY vec_id) USING (vec_id)",
    "int8_quantize": f"WITH {_LV}, s AS (SELECT vec_id, max(abs(x)) / 127 AS scale FROM lv GROUP BY vec_id), q AS (SELECT vec_id, scale, x, greatest(-127, least(127, round_even(x / scale, 0)))::INT AS q FROM lv JOIN s USING (vec_id)) SELECT vec_id, round(any_value(scale), 6) AS scale, sum(q)::BIGINT AS q_sum, round(avg(abs(x - q * scale)), 6) AS mae FROM q GROUP BY vec_id",
    "ivfpq_size": "SELECT count(*) AS n, count(*) * 8 AS codes_bytes, (4 * 64 * 64 + 4 * 16 * 64 + 12 * count(*))::BIGINT AS index_bytes, count(*) * 64 * 4 AS vector_bytes FROM embeddings",
    "ann_recall": f"WITH {_LV}, {CHAIN}, {PQ}, {ADC}, e AS ({_L2}), a AS ({_best('adc')}) SELECT e.query_id, count(a.doc_id) AS n_common, round(count(a.doc_id) / {K}.0::DOUBLE, 6) AS recall FROM e LEFT JOIN a ON a.query_id = e.query_id AND a.doc_id = e.doc_id GROUP BY e.query_id",
    "recall_at_k": f"WITH {_JUDGED}, n AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY label) SELECT query_id, count_if(grade > 0)::BIGINT AS n_found, any_value(n) AS n_relevant, round(CASE WHEN any_value(n) > 0 THEN count_if(grade > 0) / any_value(n)::DOUBLE ELSE 0 END, 6) AS recall FROM judged JOIN embeddings q ON q.vec_id = query_id JOIN n USING (label) GROUP BY query_id",
    "mrr": f"WITH {_JUDGED} SELECT count(*) AS n_queries, round(avg(rr), 6) AS mrr FROM (SELECT query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (grade > 0), 0) AS rr FROM judged GROUP BY query_id)",
    "ndcg": f"WITH {_JUDGED}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM judged) SELECT query_id, round(CASE WHEN sum((pow(2, grade) - 1) / log2(ideal + 1)) > 0 THEN sum((pow(2, grade) - 1) / log2(rank + 1)) / sum((pow(2, grade) - 1) / log2(ideal + 1)) ELSE 0 END, 6) AS ndcg FROM i GROUP BY query_id",
}
