"""Queries over documents: ranking, fusion, chunking, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import chunk_table
from lodestone.functions.text import prefix_key, term_vector
from lodestone.operators import bm25, chunking, dense, prompt
from lodestone.plans import retrieval
from lodestone.sources import files

K = 10
#: The terms of the substring-count embedding.
TERMS = ["the", "of", "and", "ing", "ion", "de", "la", "en", "que", "der", "ung", "ch", "ent", "er", "es", "re"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark table as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def bm25_scores(spark, sf_dir):
    return bm25.scores(texts(spark, sf_dir), asked(spark, sf_dir))


def _best(spark, sf_dir, k: int, **how) -> DataFrame:
    return bm25.top(bm25.scores(texts(spark, sf_dir), asked(spark, sf_dir), k=k, **how), k)


def bm25_topk(spark, sf_dir):
    return _best(spark, sf_dir, K)


def bm25_postings(spark, sf_dir):
    return bm25.postings(texts(spark, sf_dir))


def bm25_term_stats(spark, sf_dir):
    """Document frequency and IDF of every term."""
    n = bm25.corpus_stats(texts(spark, sf_dir))
    df = bm25_postings(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 6).alias("idf"))


def bm25_corpus(spark, sf_dir):
    return bm25.corpus_stats(texts(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


def _deleted(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 1")


def bm25_topk_after_delete(spark, sf_dir):
    return _best(spark, sf_dir, K, deleted=_deleted(spark, sf_dir))


def bm25_topk_after_delete_reference(spark, sf_dir):
    return _best(spark, sf_dir, K, deleted=_deleted(spark, sf_dir), delete_mode="reference")


def _embedded(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).alias("vec_id"), term_vector(F.lower("text"), TERMS).alias("embedding"))


def toy_embedding(spark, sf_dir):
    """The substring-count embedding of every document, one row per component."""
    rows = _embedded(texts(spark, sf_dir), "doc_id").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("pos", "x"))
    return rows.select("doc_id", F.col("pos").cast("long"), F.round("x", 6).alias("x"))


def _dense(spark, sf_dir, k):
    return dense.search(_embedded(asked(spark, sf_dir), "query_id"), _embedded(texts(spark, sf_dir), "doc_id"), k)


def document_dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, K)


def _hybrid(spark, sf_dir, k):
    """Both sides fetch max(3k, 30), then ranks are fused."""
    wide = max(3 * k, 30)
    return bm25.fuse(_dense(spark, sf_dir, wide), _best(spark, sf_dir, wide))


def rrf_rank_fusion(spark, sf_dir):
    return _hybrid(spark, sf_dir, K)


def rrf_hybrid_topk(spark, sf_dir):
    return bm25.top(_hybrid(spark, sf_dir, K), K)


def _first_word(rows: DataFrame) -> Column:
    """1 if the document has the query's first word, else 0."""
    return F.when(F.contains(F.lower("content"), F.lower(F.substring_index("query", " ", 1))), 1.0).otherwise(0.0)


def _pipeline(spark, sf_dir, hybrid: bool) -> DataFrame:
    """The five best of 30 candidates by the reranker, ties in the order of retrieval."""
    chunks = texts(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    pipeline = retrieval.RetrievalPipeline(chunks, retrieval.embed_terms(TERMS), hybrid=hybrid, reranker=_first_word)
    return pipeline.retrieve(asked(spark, sf_dir), 5).select("query_id", "doc_id", F.col("score").alias("rerank_score"), "rank")


def pipeline_dense_rerank(spark, sf_dir):
    """Candidates are widened to 30 before the reranker, then cut to 5."""
    return _pipeline(spark, sf_dir, False)


def pipeline_hybrid_rerank(spark, sf_dir):
    return _pipeline(spark, sf_dir, True)


def chunk_fixed(spark, sf_dir):
    return chunking.fixed(texts(spark, sf_dir))


def chunk_fixed_stats(spark, sf_dir):
    rows = chunk_fixed(spark, sf_dir)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("content")).cast("long").alias("n_chars"), F.max("start_char").alias("last_start"))


def chunk_units(spark, sf_dir):
    return chunking.units(texts(spark, sf_dir))


def chunk_recursive(spark, sf_dir):
    return chunking.with_counts(chunking.recursive(texts(spark, sf_dir)))


def chunk_semantic(spark, sf_dir):
    return chunking.with_counts(chunking.recursive(texts(spark, sf_dir), mode="semantic"))


def chunk_sql(spark, sf_dir):
    """Fixed windows by the table function, with the documents' other columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return chunk_table.chunked(docs)


def list_documents(spark, sf_dir):
    """Sources as files: chunk counts, in the order of their first document."""
    chunks = chunk_fixed(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return chunking.listed(chunks, "source", "doc_id")


def _as_files(spark, sf_dir, suffix: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), F.substring_index("text", " ", 3), F.lit("\r\n"))).otherwise(F.lit(""))
    content = F.encode(F.concat(head, "text"), "UTF-8")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/corpus/"), F.col("doc_id"), F.lit(suffix)).alias("path"), content.alias("content"))


def markdown_title(spark, sf_dir):
    """Documents as Markdown files, every other one with a heading and a CRLF."""
    return files.parse(_as_files(spark, sf_dir, ".md")).select("id", "metadata.title", "metadata.format", "metadata.size_bytes")


def text_document(spark, sf_dir):
    return files.parse(_as_files(spark, sf_dir, ".txt")).select("id", "metadata.title", "metadata.format", "metadata.size_bytes", F.length("content").cast("long").alias("n_chars"))


def prompt_build(spark, sf_dir):
    """A prompt of the five best documents for every query."""
    hits = _best(spark, sf_dir, 5).join(texts(spark, sf_dir), "doc_id")
    return prompt.build(asked(spark, sf_dir), hits)


def search_result_format(spark, sf_dir):
    hits = _best(spark, sf_dir, 5).join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return prompt.format_results(asked(spark, sf_dir), hits)


def prefix_keys(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", prefix_key(F.col("text")).alias("prefix_key"))


QUERIES = (bm25_scores, bm25_topk, bm25_postings, bm25_term_stats, bm25_corpus, bm25_topk_after_delete, bm25_topk_after_delete_reference, toy_embedding, document_dense_topk, rrf_rank_fusion, rrf_hybrid_topk, pipeline_dense_rerank, pipeline_hybrid_rerank, chunk_fixed, chunk_fixed_stats, chunk_units, chunk_recursive, chunk_semantic, chunk_sql, list_documents, markdown_title, text_document, prompt_build, search_result_format, prefix_keys)

TOKENS = r"unnest(list_filter(string_split_regex(lower({}), '\s+'), lambda x: x <> ''))"


def _bm25_sql(base: str = "documents", n: str = "count(*)", live: str = "") -> str:
    """WITH clauses up to s (query_id, doc_id, score)."""
    return rf"""
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, {TOKENS.format("text")} AS term FROM benchmark) GROUP BY ALL),
len AS (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS len FROM {base}),
st AS (SELECT {n} AS n, avg(len) AS avgdl FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TOKENS.format("text")} AS term FROM {base}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
      FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id) CROSS JOIN st {live} GROUP BY query_id, doc_id)"""


def _top_sql(rows: str, k: int) -> str:
    return f"SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {rows}) WHERE rank <= {k}"


def _vector_sql(key: str, name: str, source: str) -> str:
    counts = ", ".join(f"(length(t) - length(replace(t, '{x}', ''))) / {float(len(x))}" for x in TERMS)
    return f"SELECT {key} AS {name}, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS e FROM (SELECT {key}, CASE WHEN list_max(c) > 0 THEN c ELSE list_append(list_resize([0.0::DOUBLE], {len(TERMS) - 1}, 0.0), 0.1) END AS v FROM (SELECT {key}, [{counts}]::DOUBLE[] AS c FROM (SELECT {key}, lower(text) AS t FROM {source})))"


DENSE = f"""
qv AS ({_vector_sql("item_id", "query_id", "benchmark")}),
dv AS ({_vector_sql("doc_id", "doc_id", "documents")}),
ds AS (SELECT query_id, doc_id, round(list_dot_product(qv.e, dv.e), 6) AS score FROM qv CROSS JOIN dv)"""


def _fused_sql(wide: int) -> str:
    return f"{DENSE}, {_bm25_sql()}, r AS (SELECT * FROM ({_top_sql('ds', wide)}) UNION ALL SELECT * FROM ({_top_sql('s', wide)})), f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM r GROUP BY ALL)"


def _rerank_sql(rows: str) -> str:
    return f"""SELECT query_id, doc_id, rerank_score, new_rank AS rank FROM (
SELECT h.query_id, h.doc_id, rerank_score, row_number() OVER (PARTITION BY h.query_id ORDER BY rerank_score DESC, h.rank) AS new_rank FROM (
SELECT h.*, CASE WHEN contains(lower(d.text), lower(split_part(b.text, ' ', 1))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rerank_score FROM ({rows}) h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id) h) WHERE new_rank <= 5"""


FIXED = "SELECT doc_id, unnest(range(0, length(text), 448)) AS start_char, text FROM documents WHERE length(text) > 0"
FILE = "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '# ' || array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') || chr(13) || chr(10) ELSE '' END || text AS c FROM documents)"

#: The fold over units, a step a chunk or unit: reach the farthest unit end that fits, else close the chunk, else take one unit.
RECURSIVE = r"""WITH RECURSIVE u AS (SELECT doc_id, regexp_extract_all(text, '(?s).(?:\n\n|\n|。|\. | )*') AS u FROM documents),
s AS (SELECT doc_id, i, (sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM (SELECT doc_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u)),
e AS (SELECT doc_id, list(e ORDER BY i) AS ends FROM s GROUP BY doc_id),
r AS (SELECT doc_id, ends, 0::BIGINT AS beg, 0::BIGINT AS pos, NULL::BIGINT AS x, NULL::BIGINT AS y, false AS done FROM e UNION ALL
  SELECT doc_id, ends, CASE WHEN emit AND pos - beg > 64 THEN pos - 64 WHEN emit THEN pos ELSE beg END, coalesce(fit, CASE WHEN emit THEN pos ELSE more END),
    CASE WHEN emit THEN beg END, CASE WHEN emit THEN pos END, emit AND more IS NULL
  FROM (SELECT *, fit IS NULL AND pos > beg AS emit FROM (
    SELECT *, list_max(list_filter(ends, lambda v: v > pos AND v - beg <= 512)) AS fit, list_min(list_filter(ends, lambda v: v > pos)) AS more FROM r WHERE NOT done)))
SELECT c.doc_id, (row_number() OVER d - 1)::BIGINT AS ordinal, x AS start_char, substring(text, x + 1, y - x) AS content, c.doc_id || '#' || (row_number() OVER d - 1) AS chunk_id, count(*) OVER (PARTITION BY c.doc_id) AS chunk_count
FROM r c JOIN documents USING (doc_id) WHERE x IS NOT NULL WINDOW d AS (PARTITION BY c.doc_id ORDER BY x)"""

ORACLE = {
    "chunk_recursive": RECURSIVE,
    "bm25_scores": f"WITH {_bm25_sql()} SELECT * FROM s",
    "bm25_topk": f"WITH {_bm25_sql()} {_top_sql('s', K)}",
    "bm25_postings": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TOKENS.format('text')} AS term FROM documents) GROUP BY ALL",
    "bm25_term_stats": f"WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {TOKENS.format('text')} AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf FROM p CROSS JOIN n GROUP BY term",
    "bm25_corpus": r"SELECT count(*) AS n, round(avg(len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))), 6) AS avgdl FROM documents",
    "bm25_topk_after_delete": f"WITH live AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_bm25_sql('live')} {_top_sql('s', K)}",
    "bm25_topk_after_delete_reference": f"WITH gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), {_bm25_sql(n='(SELECT count(*) FROM documents ANTI JOIN gone USING (doc_id))', live='WHERE doc_id NOT IN (SELECT doc_id FROM gone)')} {_top_sql('s', K)}",
    "toy_embedding": f"WITH {DENSE} SELECT doc_id, (generate_subscripts(e, 1) - 1)::BIGINT AS pos, round(unnest(e), 6) AS x FROM dv",
    "document_dense_topk": f"WITH {DENSE} {_top_sql('ds', K)}",
    "rrf_rank_fusion": f"WITH {_fused_sql(30)} SELECT * FROM f",
    "rrf_hybrid_topk": f"WITH {_fused_sql(30)} {_top_sql('f', K)}",
    "pipeline_dense_rerank": f"WITH {DENSE} {_rerank_sql(_top_sql('ds', 30))}",
    "pipeline_hybrid_rerank": f"WITH {_fused_sql(90)} {_rerank_sql(_top_sql('f', 30))}",
    "chunk_fixed": f"SELECT doc_id, (start_char // 448)::BIGINT AS ordinal, start_char, substring(text, start_char + 1, 512) AS content, doc_id || '#' || start_char AS chunk_id FROM ({FIXED})",
    "chunk_fixed_stats": f"SELECT doc_id, count(*) AS n_chunks, sum(length(substring(text, start_char + 1, 512)))::BIGINT AS n_chars, max(start_char) AS last_start FROM ({FIXED}) GROUP BY doc_id",
    "chunk_units": "SELECT doc_id, len(u)::BIGINT AS n_units, length(array_to_string(u, ''))::BIGINT AS n_chars FROM (SELECT doc_id, regexp_extract_all(text, '(?s).(?:\n\n|\n|。|\\. | )*') AS u FROM documents)",
    "chunk_sql": f"SELECT doc_id, lang, source, (start_char // 448)::BIGINT AS ordinal, start_char, substring(text, start_char + 1, 512) AS content FROM ({FIXED}) JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)",
    "list_documents": f"SELECT source AS file_name, count(*) AS n_chunks, min(doc_id) AS first_seen FROM ({FIXED}) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source",
    "markdown_title": f"SELECT '/corpus/' || doc_id || '.md' AS id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_extract(c, '^# ([^\\r\\n]*)', 1)) ELSE doc_id::VARCHAR END AS title, 'markdown' AS format, strlen(c)::BIGINT AS size_bytes FROM {FILE}",
    "text_document": f"SELECT '/corpus/' || doc_id || '.txt' AS id, doc_id::VARCHAR AS title, 'text' AS format, strlen(c)::BIGINT AS size_bytes, length(replace(c, chr(13) || chr(10), chr(10)))::BIGINT AS n_chars FROM {FILE}",
    "prompt_build": f"WITH {_bm25_sql()}, h AS ({_top_sql('s', 5)}) SELECT b.item_id AS query_id, '{prompt.SYSTEM}' || chr(10) || chr(10) || '## 参考文档' || chr(10) || coalesce(p, '') || chr(10) || chr(10) || '## 用户问题' || chr(10) || b.text AS prompt FROM benchmark b LEFT JOIN (SELECT query_id, string_agg('[文档' || rank || '] ' || d.text, chr(10) ORDER BY rank) AS p FROM h JOIN documents d USING (doc_id) GROUP BY query_id) ON query_id = b.item_id",
    "search_result_format": f"WITH {_bm25_sql()}, h AS ({_top_sql('s', 5)}) SELECT b.item_id AS query_id, coalesce(r, '{prompt.NOTHING}') AS result FROM benchmark b LEFT JOIN (SELECT query_id, string_agg('[文档' || rank || '] (来源: ' || d.source || ', 相关度: ' || printf('%.3f', round(score, 3)) || ')' || chr(10) || substring(d.text, 1, 300), chr(10) || chr(10) ORDER BY rank) AS r FROM h JOIN documents d USING (doc_id) GROUP BY query_id) ON query_id = b.item_id",
    "prefix_keys": "SELECT doc_id, substring(sha256(text), 1, 16) AS prefix_key FROM documents",
}
