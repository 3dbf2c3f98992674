"""Times the headline queries and the published retrieval benchmark; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1). BENCH_CPUS: local threads (default 8). BENCH_CSV: a file for the
retrieval figures as well, with a byte order mark.
"""

from __future__ import annotations

import csv
import json
import os
import sys
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from lodestone.operators import dense, quantise  # noqa: E402
from lodestone.plans import catalogue, index_queries, text_queries  # noqa: E402

HEADLINE = ("bm25_topk", "bm25_term_stats", "cosine_topk_batch", "l2_topk", "rrf_hybrid_topk", "pipeline_hybrid_rerank", "chunk_fixed_stats", "chunk_recursive", "prompt_build", "kmeans_fit", "ivfpq_trained_search", "history_text", "prefix_cache_replay", "parse_react_output")


def timed(df: DataFrame) -> float:
    """Seconds to compute every row and column, as a sink would."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def retrieval(spark: SparkSession, n: int = 5000, dim: int = 64, n_queries: int = 100, k: int = 10) -> dict:
    """Exact and IVF-PQ search of random unit vectors with the published parameters, as batches."""
    rng = np.random.default_rng(42)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = unit(rng.standard_normal((n, dim)))
    queries = unit(vectors[rng.choice(n, n_queries, replace=False)] + 0.05 * rng.standard_normal((n_queries, dim)))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()
    corpus, asked = frame(vectors), frame(queries)
    corpus.count(), asked.count()
    out = {}

    def batch(search):
        """Rows and seconds of a search from the call on, packing included; the second of two, when code is compiled."""
        for _ in range(2):
            began = time.perf_counter()
            found = search()
            timed(found)
        return found, time.perf_counter() - began

    exact, out["exact_batch_sec"] = batch(lambda: dense.search(asked, corpus, k))
    began = time.perf_counter()
    index = quantise.fit_ivfpq(corpus, 64, 8, 4, passes=8)
    codes = quantise.encode(corpus, index).cache()
    codes.count()
    out["ivfpq_build_sec"] = time.perf_counter() - began
    found, out["ivfpq_batch_sec"] = batch(lambda: quantise.search(codes, index, asked, k, 8))
    common = exact.join(found, ["query_id", "doc_id"]).count()
    out |= {"exact_qps": n_queries / out["exact_batch_sec"], "ivfpq_qps": n_queries / out["ivfpq_batch_sec"], "ivfpq_recall_at_10": common / (n_queries * k), "exact_bytes": 4 * n * dim, "ivfpq_bytes": index.size(n)}
    return out


def stored_index(spark: SparkSession, sf_dir: str) -> dict:
    """Seconds to build a BM25 index of the documents and to rank all queries with it, the second time."""
    began = time.perf_counter()
    index = index_queries.built(spark, sf_dir)
    out = {"bm25_index_build_sec": time.perf_counter() - began}
    for _ in range(2):
        began = time.perf_counter()
        timed(index.search(text_queries.asked(spark, sf_dir), text_queries.K))
    return out | {"bm25_index_search_sec": time.perf_counter() - began}


def write_csv(rows: dict[str, dict], path: str) -> None:
    """One line for each size."""
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.DictWriter(f, ["size", *next(iter(rows.values()))])
        out.writeheader()
        out.writerows({"size": k, **v} for k, v in rows.items())


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("lodestone-bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    timed(queries["bm25_topk"](spark, sf_dir))  # starts workers and compiles code
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        timed(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - began, 3)
    rounded = lambda d: {k: round(v, 4) for k, v in d.items()}
    sizes = {f"retrieval_{n}x64": rounded(retrieval(spark, n)) for n in (5000, 100_000)}
    if os.environ.get("BENCH_CSV"):
        write_csv(sizes, os.environ["BENCH_CSV"])
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
    print(json.dumps(line | sizes | rounded(stored_index(spark, sf_dir))))
    spark.stop()


if __name__ == "__main__":
    main()
