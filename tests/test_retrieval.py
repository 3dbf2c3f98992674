"""The retrieval pipeline, the command line and driver-side state."""

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions.text import prefix_key
from lodestone.operators import agent, dialogue, session
from lodestone.operators.segments import Bm25Index
from lodestone.plans import retrieval
from lodestone.plans.text_queries import TERMS
from lodestone.sources import files

BASIS = {"水果": [1.0, 0.0, 0.0], "手机": [0.0, 1.0, 0.0]}


@pytest.fixture(scope="module")
def pieces(spark):
    chunks = spark.createDataFrame([(0, "普通 水果 介绍", [1.0, 0.0, 0.0]), (1, "手机 精确型号 X100 参数", [0.0, 1.0, 0.0]), (2, "其他 内容", [0.9, 0.1, 0.0])], "chunk_id long, content string, embedding array<double>")
    index = retrieval.ExactIndex(chunks.select(F.col("chunk_id").alias("vec_id"), "embedding"))
    return chunks.drop("embedding"), index, lambda text: F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))


def ids(rows):
    return [r.doc_id for r in rows.orderBy("rank").collect()]


def test_modes(spark, pieces):
    chunks, index, embedding = pieces
    q = spark.createDataFrame([(7, "X100")], "query_id long, text string")
    make = lambda **k: retrieval.RetrievalPipeline(chunks, embedding, index, **k)
    assert (make().mode, make(hybrid=True, reranker=retrieval.contains_reranker).mode) == ("dense", "hybrid+rerank")
    assert ids(make().retrieve(q, 2)) == [0, 2]
    assert ids(make(hybrid=True).retrieve(q, 2)) == [1, 0]
    assert ids(make(reranker=retrieval.contains_reranker).retrieve(q, 2)) == [1, 0]
    assert make(reranker=retrieval.contains_reranker).retrieve(q, 0).collect() == []
    with pytest.raises(ValueError):
        make(rerank_top_n=0)


def test_model_embeddings_are_batched(spark):
    embedding = retrieval.embed_batches(lambda: lambda texts: [[len(t), 1] for t in texts])
    rows = spark.createDataFrame([("ab",), (None,)], "t string").select(embedding(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [[2.0, 1.0], [0.0, 1.0]]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Title\nthe otter of the river\n")
    (tmp_path / "in" / "b.txt").write_text("entirely different englische zeile\n" * 30)
    save = str(tmp_path / "index")
    for backend in ("numpy", "ivfpq"):
        assert cli.build_index(spark, cli.parser().parse_args(["index", "--path", str(tmp_path / "in"), "--save", save, "--chunk-size", "100", "--chunk-overlap", "10", "--backend", backend, "--n-clusters", "2"])) >= 3
        args = ["--index-path", save, "--backend", backend, "--hybrid", "--rerank"]
        out = cli.ask(spark, cli.parser().parse_args(["ask", "otter", "--show-sources", *args]))
        assert out.split("\n\n")[1].startswith("[文档1] (来源: a.md") and "otter" in out
    llm = agent.MockLLM('<tool_call>{"name": "search_knowledge_base", "arguments": {"query": "otter", "top_k": 1}}</tool_call>', "Final Answer: found")
    said = cli.chat(spark, cli.parser().parse_args(["chat", *args]), llm, ["/docs", "where is it", "/clear", "/cache", "/exit", "never"])
    assert said[1:] == ["found", '{"uses": 2, "hits": 1}'] and '"a.md": 1' in said[0] and "otter" in llm.prompts[1]


def test_recall_and_prefixes(spark):
    lru, fifo = dialogue.Recall(2), dialogue.Recall(2, "fifo")
    for c in (lru, fifo):
        assert [c("a", lambda: 1), c("b", lambda: 2), c("a", lambda: 9), c("c")] == [(1, False), (2, False), (1, True), (None, False)]
    assert ("a" in lru, "b" in lru, "a" in fifo, "b" in fifo) == (True, False, False, True)
    for wrong in ((0, "lru"), (2, "mru")):
        with pytest.raises(ValueError):
            dialogue.Recall(*wrong)
    llm = agent.MockLLM("r")
    ask, uses = session.with_prefixes(llm.generate, 2)
    assert ask("p", "s", "|") == session.streamed(session.with_prefixes(llm.generate_stream)[0]("p", "t")) == "r"
    assert llm.prompts == ["p|s", "pt"]
    for prefix in "pqrp":
        ask(prefix, "")
    trace = session.trace(spark, uses)
    assert [r.hit for r in trace.orderBy("seq").collect()] == [False, True, False, False, False]
    assert dialogue.hit_rates(trace).collect()[0].asDict() == {"session": 0, "hits": 1, "misses": 4, "hit_rate": 0.2}
    replayed = dialogue.replay(trace.drop("hit"), 2)
    assert sorted(map(tuple, replayed.collect())) == sorted(map(tuple, trace.collect()))
    prefix = spark.createDataFrame([("x",)], "t string").select(prefix_key(F.col("t")).alias("k")).collect()[0].k
    session_key, seen = session.with_prefixes(llm.generate)
    session_key("x", "")
    assert seen == [(prefix, False)]


def test_cached_embeddings():
    calls = []
    cached = session.embedding_cache(lambda ts: calls.append(ts) or [len(t) for t in ts], 2)
    assert cached(["ab", "ab", "c"]) == [2, 2, 1] and cached(["c"]) == [1] and cached([]) == []
    assert calls == [["ab", "c"]]
    assert cached(["ab", "ddd", "eeee"]) == [2, 3, 4] and cached(["c", "ab"]) == [1, 2]
    assert calls[1:] == [["ddd", "eeee"], ["c", "ab"]]


def test_history_and_rewriting():
    messages = [{"role": r, "content": t} for r, t in (("system", "s"), ("user", "u"), ("assistant", "a"))]
    assert session.history_text(messages, 3) == session.history_text(messages, 0, 1) == "用户: u\n助手: a"
    llm = agent.MockLLM(' "" ', " 'better question' ")
    rewrite = session.rewriter(llm.generate)
    assert session.rewriter(None)("q", ["h"]) == rewrite("q") == "q"
    assert [rewrite("q", ["h"]), rewrite("q", ["h"]), rewrite("p", ["h"]), rewrite("p", ["x", "h"])] == ["q", "q", "better question", "better question"]
    assert len(llm.prompts) == 3

    def fails(text, **options):
        raise RuntimeError

    assert session.rewriter(fails)("q", ["h"]) == "q"


def test_agent_prompts_share_a_prefix():
    llm = agent.MockLLM('<tool_call>{"name": "none"}</tool_call>', "nothing", "Final Answer: yes", "Final Answer: again")
    bot = agent.ReActAgent(llm, {})
    assert bot.run("first") == "nothing" and bot.run("second") == "yes"
    assert [hit for _, hit in bot.uses] == [False, True, True]
    assert all(p.startswith(bot.prefix()) for p in llm.prompts) and "助手: nothing" in llm.prompts[2]
    assert [s["type"] for s in bot.steps] == ["final_answer"]


def test_indexes_grow_and_are_stored(spark, pieces, tmp_path):
    _, index, _ = pieces
    vectors = index.vectors.selectExpr("vec_id", "embedding")
    grown = retrieval.ExactIndex(vectors)
    grown.add(spark.createDataFrame([(9, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>"))
    q = spark.createDataFrame([(1, [0.0, 0.1, 1.0])], "vec_id long, embedding array<double>")
    assert (len(grown), ids(grown.search(q, 1))) == (4, [9])
    grown.save(str(tmp_path / "exact"))
    assert ids(retrieval.ExactIndex.load(spark, str(tmp_path / "exact")).search(q, 2)) == ids(grown.search(q, 2))
    built = retrieval.IvfPqIndex.build(vectors, 2, 2, 1, 2)
    with pytest.raises(RuntimeError):
        built.add(vectors)
    built.save(str(tmp_path / "pq"))
    again = retrieval.IvfPqIndex.load(spark, str(tmp_path / "pq"), 2)
    assert len(again) == len(built) == 3 and ids(again.search(q, 2)) == ids(built.search(q, 2))
    for kind in (retrieval.ExactIndex, retrieval.IvfPqIndex):
        with pytest.raises(FileNotFoundError):
            kind.load(spark, str(tmp_path / "none"))


def test_stored_sparse_index_and_batched_reranker(spark, pieces, tmp_path):
    chunks, index, embedding = pieces
    q = spark.createDataFrame([(7, "X100")], "query_id long, text string")
    stored = Bm25Index(spark, str(tmp_path))
    stored.add(chunks.selectExpr("chunk_id AS doc_id", "content AS text"))
    make = lambda **k: retrieval.RetrievalPipeline(chunks, embedding, index, **k)
    assert ids(make(hybrid=True, sparse=stored).retrieve(q, 2)) == ids(make(hybrid=True).retrieve(q, 2)) == [1, 0]
    model = retrieval.BatchedReranker(lambda: lambda pairs: [float(q in c) for q, c in pairs], 2)
    assert ids(make(reranker=model).retrieve(q, 2)) == ids(make(reranker=retrieval.contains_reranker).retrieve(q, 2)) == [1, 0]


def test_answers_from_a_table_without_metadata(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the otter", "d")], "chunk_id long, content string, document_id string")
    files.save_chunks(rows.withColumn("embedding", retrieval.embed_terms(TERMS)(F.col("content"))), f"{tmp_path}/chunks")
    said = cli.ask(spark, cli.parser().parse_args(["ask", "otter", "--show-sources", "--index-path", str(tmp_path)]))
    assert "the otter" in said
    with pytest.raises(ValueError):
        files.save_chunks(rows.drop("content"), f"{tmp_path}/bad")
        files.load_chunks(spark, f"{tmp_path}/bad")
