"""Command line: index a folder, then ask its chunks or chat about them.

    python -m lodestone.cli index --path docs --save index
    python -m lodestone.cli ask "question" --index-path index --hybrid
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators import agent, chunking, prompt, quantise
from lodestone.operators.session import history_text, rewriter
from lodestone.plans import retrieval
from lodestone.plans.text_queries import TERMS
from lodestone.sources import files


def build_index(spark: SparkSession, args: argparse.Namespace) -> int:
    """Scan, parse, chunk, embed and save; the number of chunks."""
    found = files.scan(spark, args.path)
    for r in files.rejected(found).toLocalIterator():
        print(f"skipped {r.path}: {r.reason}")
    docs = files.parse(found).select(F.col("id").alias("doc_id"), F.col("content").alias("text"), "metadata")
    chunks = chunking.recursive(docs, args.chunk_size, args.chunk_overlap, args.mode).join(docs.select("doc_id", "metadata"), "doc_id")
    rows = chunks.select(F.xxhash64("chunk_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "ordinal", "content", "metadata", retrieval.embed_terms(TERMS)(F.col("content")).alias("embedding"))
    files.save_chunks(rows, f"{args.save}/chunks")
    saved = files.load_chunks(spark, f"{args.save}/chunks")
    if args.backend == "ivfpq":
        vectors = saved.select(F.col("chunk_id").alias("vec_id"), "embedding")
        index = quantise.fit_ivfpq(vectors, args.n_clusters, args.n_subvectors, args.n_bits)
        quantise.save(quantise.encode(vectors, index), index, f"{args.save}/ivfpq")
    return saved.count()


def open_pipeline(spark: SparkSession, args: argparse.Namespace) -> retrieval.RetrievalPipeline:
    chunks = files.load_chunks(spark, f"{args.index_path}/chunks")
    index = retrieval.IvfPqIndex(*quantise.load(spark, f"{args.index_path}/ivfpq"), args.n_probe) if args.backend == "ivfpq" else None
    index = index or retrieval.ExactIndex(chunks.select(F.col("chunk_id").alias("vec_id"), "embedding"))
    return retrieval.RetrievalPipeline(chunks, retrieval.embed_terms(TERMS), index, hybrid=args.hybrid, reranker=retrieval.contains_reranker if args.rerank else None, rerank_top_n=args.rerank_top_n)


def found_text(spark: SparkSession, pipeline: retrieval.RetrievalPipeline, query: str, k: int) -> str:
    queries = spark.createDataFrame([(0, query)], "query_id long, text string")
    hits = pipeline.retrieve(queries, k).select("query_id", "doc_id", F.col("content").alias("text"), "rank", "score", F.col("metadata.file_name").alias("source"))
    return prompt.format_results(queries, hits).collect()[0].result


def ask(spark: SparkSession, args: argparse.Namespace, llm=None) -> str:
    seen = found_text(spark, open_pipeline(spark, args), args.query, args.top_k)
    if seen == prompt.NOTHING:
        return seen
    answer = (llm or agent.MockLLM()).generate(f"{prompt.SYSTEM}\n\n{prompt.DOCUMENTS}\n{seen}\n\n{prompt.QUESTION}\n{args.query}")
    return f"{answer}\n\n{seen}" if args.show_sources else answer


def chat(spark: SparkSession, args: argparse.Namespace, llm=None, lines=None) -> list[str]:
    """Answer lines until /exit; /clear forgets, /docs lists the files, /cache tells how often prefixes were seen before."""
    pipeline, llm, memory, out = open_pipeline(spark, args), llm or agent.MockLLM(), [], []

    def list_documents() -> str:
        listed = chunking.listed(pipeline.chunks.select(F.col("metadata.file_name").alias("file_name"), "document_id"), "file_name", "document_id")
        return json.dumps({r.file_name: r.n_chunks for r in listed.toLocalIterator()}, ensure_ascii=False)

    tools = {
        "search_knowledge_base": ("在知识库中搜索相关文档", lambda query, top_k=5: found_text(spark, pipeline, query, int(top_k)), (("query", "string", ""), ("top_k", "integer", ""))),
        "list_documents": ("列出知识库中的文档", list_documents, ()),
    }
    rewrite, bot = rewriter(llm.generate), agent.ReActAgent(llm, tools, memory)
    for line in lines if lines is not None else iter(input, "/exit"):
        if line in ("/exit", "/quit"):
            break
        if line == "/clear":
            memory.clear()
            continue
        if line == "/docs":
            text = list_documents()
        elif line == "/cache":
            text = json.dumps({"uses": len(bot.uses), "hits": sum(hit for _, hit in bot.uses)})
        else:
            text = bot.run(rewrite(line, [history_text(memory)] if memory else []))
        out.append(text)
        print(text)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("--path", required=True)
    p.add_argument("--save", required=True)
    p.add_argument("--chunk-size", type=int, default=512)
    p.add_argument("--chunk-overlap", type=int, default=64)
    p.add_argument("--mode", choices=("reference", "semantic"), default="reference")
    p.add_argument("--backend", choices=("numpy", "ivfpq"), default="numpy")
    p.add_argument("--n-clusters", type=int, default=256)
    p.add_argument("--n-subvectors", type=int, default=16)
    p.add_argument("--n-bits", type=int, default=8)
    for name in ("ask", "chat"):
        p = sub.add_parser(name)
        if name == "ask":
            p.add_argument("query")
            p.add_argument("--top-k", type=int, default=5)
            p.add_argument("--show-sources", action="store_true")
        p.add_argument("--index-path", required=True)
        p.add_argument("--backend", choices=("numpy", "ivfpq"), default="numpy")
        p.add_argument("--n-probe", type=int, default=8)
        p.add_argument("--hybrid", action="store_true")
        p.add_argument("--rerank", action="store_true")
        p.add_argument("--rerank-top-n", type=int, default=30)
    return top


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args.command == "index":
        print(f"{build_index(spark, args)} chunks")
    elif args.command == "ask":
        print(ask(spark, args))
    else:
        chat(spark, args)


if __name__ == "__main__":
    main()
