"""Golden values, edges and invariants of the operators."""

import json
import math
import random
from collections import OrderedDict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as textual
from lodestone.functions import vectors
from lodestone.operators import agent, bm25, chunking, dense, dialogue, evaluate, prompt, quantise
from lodestone.sources import files
from lodestone.streaming import ingest


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, rank long")


# Fusion, evaluation


def test_fusion_adds_reciprocal_ranks(spark):
    out = bm25.fuse(ranked(spark, [(1, 7, 1), (1, 8, 2)]), ranked(spark, [(1, 7, 3), (1, 8, 2), (1, 9, 1)]))
    assert {r.doc_id: r.score for r in out.collect()} == {7: round(1 / 61 + 1 / 63, 6), 8: round(2 / 62, 6), 9: round(1 / 61, 6)}


def test_quality_of_a_known_ranking(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 0), (1, 4, 1), (2, 1, 0)], "query_id long, rank long, grade int")
    assert {r.query_id: r.ndcg for r in evaluate.ndcg(rows).collect()} == {1: 0.639909, 2: 0.0}
    assert {r.query_id: r.rr for r in evaluate.reciprocal_rank(rows).collect()} == {1: 0.5, 2: 0.0}
    relevant = spark.createDataFrame([(1, 2), (2, 0)], "query_id long, n_relevant long")
    assert {r.query_id: r.recall for r in evaluate.recall(rows.where("rank <= 3"), relevant).collect()} == {1: 0.5, 2: 0.0}


# BM25


def brute_bm25(docs, query):
    toks = {k: (t or "").lower().split() for k, t in docs}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for term in query.lower().split():
        df = sum(term in t for t in toks.values())
        for k, t in toks.items():
            if tf := t.count(term):
                out[k] = out.get(k, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    return {k: round(s, 6) for k, s in out.items()}


DOCS = [(1, "the cat sat on the mat"), (2, "The dog"), (3, ""), (4, None), (5, "a cat and a dog and a cat"), (6, "unrelated words")]


def test_bm25_edges(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    asked = [(1, "cat cat dog"), (2, "nowhere"), (3, ""), (4, "The")]
    got = {}
    for r in bm25.scores(docs, spark.createDataFrame(asked, "query_id long, text string")).collect():
        got.setdefault(r.query_id, {})[r.doc_id] = r.score
    assert got == {k: b for k, q in asked if (b := brute_bm25(DOCS, q))}


def test_bm25_deletes(spark):
    docs, q = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(1, "cat dog")], "query_id long, text string")
    gone = spark.createDataFrame([(5,), (99,)], "doc_id long")
    exact = {r.doc_id: r.score for r in bm25.scores(docs, q, deleted=gone).collect()}
    assert exact == brute_bm25([d for d in DOCS if d[0] != 5], "cat dog")
    assert set(r.doc_id for r in bm25.scores(docs, q, deleted=gone, delete_mode="reference").collect()) == {1, 2}
    with pytest.raises(ValueError):
        bm25.scores(docs, q, delete_mode="x")


@pytest.mark.parametrize("k", [0, -1])
def test_top_of_nothing(spark, k):
    rows = spark.createDataFrame([(1, 2, 0.5)], "query_id long, doc_id long, score double")
    assert bm25.top(rows, k).collect() == []
    assert dense.search(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), k).collect() == []


# Chunking

LITERALS = ["\n\nabc", " abc", "a\n\n\nb", "x\n    code", "", "世界。 x", "a. b.  c", None, "plain"]


def test_fixed_windows(spark):
    docs = spark.createDataFrame(list(enumerate(LITERALS + ["0123456789" * 20])), "doc_id long, text string")
    got = {}
    for r in chunking.fixed(docs, 50, 10).collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.content, r.chunk_id, r.ordinal))
    for k, t in enumerate(LITERALS + ["0123456789" * 20]):
        want = [(x, t[x : x + 50], f"{k}#{x}", x // 40) for x in range(0, len(t or ""), 40)]
        assert sorted(got.get(k, [])) == want
    with pytest.raises(ValueError):
        chunking.fixed(docs, 10, 10)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=60), st.integers(1, 20), st.integers(0, 12))
def test_spans_cover_the_text_in_order(lengths, size, overlap):
    out = chunking.spans(lengths, size, overlap)
    total = sum(lengths)
    assert (out[0][0], out[-1][1]) == (0, total) if total else out == []
    for (a, b), (c, d) in zip(out, out[1:]):
        assert a < c <= b < d


@pytest.mark.parametrize("mode", ["reference", "semantic"])
def test_recursive_chunks_are_slices(spark, mode):
    rng = random.Random(4)
    texts = LITERALS + ["".join(rng.choices(["word", " ", ". ", "\n", "\n\n", "。", "x" * 30], k=200)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {}
    for r in chunking.with_counts(chunking.recursive(docs, 40, 8, mode)).orderBy("doc_id", "ordinal").collect():
        by.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(texts):
        chunks, at = by.get(k, []), 0
        for n, c in enumerate(chunks):
            assert c.content == t[c.start_char : c.start_char + len(c.content)] and c.start_char <= at
            assert (c.chunk_id, c.chunk_count) == (f"{k}#{n}", len(chunks))
            at = c.start_char + len(c.content)
        assert at == len(t or "")
        assert mode == "semantic" or all(len(c.content) <= 48 for c in chunks)


# Files


def test_scan_parse_and_rejects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("intro\r\n# 测试标题 \r\nbody # no".encode())
    (tmp_path / "sub" / "B.MD").write_text("no heading")
    (tmp_path / "c.txt").write_text("# not a title\nline")
    (tmp_path / "d.pdf").write_text("x")
    (tmp_path / "e.md").write_text("# \nempty")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    found = files.scan(spark, str(tmp_path))
    got = {r.metadata.file_name: (r.metadata.title, r.metadata.format, r.metadata.size_bytes, r.content) for r in files.parse(found).collect()}
    assert got == {"a.md": ("测试标题", "markdown", 33, "intro\n# 测试标题 \nbody # no"), "B.MD": ("B", "markdown", 10, "no heading"), "c.txt": ("c", "text", 18, "# not a title\nline"), "e.md": ("", "markdown", 8, "# \nempty")}
    everything = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in files.rejected(everything).collect()} == {"d.pdf": "unsupported format", "bad.txt": "not UTF-8"}


def test_parser_registry(spark):
    assert (files.get_parser("x/A.Markdown"), files.get_parser("y.log")) == ("markdown", "text")
    with pytest.raises(ValueError):
        files.get_parser("test.pdf")
    files.register_parser((".pdf",), "pdf", lambda path, text: F.lit("?"))
    try:
        rows = spark.createDataFrame([("/x/test.pdf", bytearray(b"ab"))], "path string, content binary")
        assert files.parse(rows).collect()[0].metadata.title == "?"
    finally:
        files._PARSERS.pop(0)


def test_chunk_tables_and_backends(spark, tmp_path):
    files.save_chunks(spark.createDataFrame([(1, "a")], "doc_id long, content string"), str(tmp_path / "t"))
    assert files.load_chunks(spark, str(tmp_path / "t")).select("metadata.file_name").collect()[0].file_name is None
    assert [files.backend("i.ivfpq"), files.backend("i.npz"), files.backend("i.npz", "ivfpq")] == ["ivfpq", "numpy", "ivfpq"]
    with pytest.raises(ValueError):
        files.backend("x", "other")


# Vectors


def clustered():
    rng = np.random.default_rng(42)
    centres = rng.standard_normal((4, 8))
    return [(c * 12 + i, [float(x) for x in centres[c] / np.linalg.norm(centres[c]) + 0.02 * rng.standard_normal(8)]) for c in range(4) for i in range(12)]


def test_exact_search_ties_zero_vectors_and_dimensions(spark):
    schema = "vec_id long, embedding array<double>"
    corpus = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [0.0, 5.0]), (5, None)], schema)
    q = spark.createDataFrame([(9, [3.0, 0.0])], schema)
    assert [(r.doc_id, r.score) for r in dense.search(q, corpus, 9).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0), (4, 0.0)]
    assert [(r.doc_id, r.score) for r in dense.search(q, corpus, 2, "l2").orderBy("rank").collect()] == [(1, 1.0), (3, 4.0)]
    with pytest.raises(Exception, match="dimensions"):
        dense.search(spark.createDataFrame([(9, [1.0])], schema), corpus, 1).collect()
    with pytest.raises(ValueError):
        dense.search(q, corpus, 1, "other")


def test_quantised_index(spark, tmp_path):
    points = spark.createDataFrame(clustered(), "vec_id long, embedding array<double>")
    index = quantise.fit_ivfpq(points, 4, 2, 4)
    codes = quantise.encode(points, index)
    assert index.size(48) == 928 and {len(r.codes) for r in codes.collect()} == {2}
    found = quantise.search(codes, index, points, 5, n_probe=2).collect()
    assert len(found) == 240 and sum(r.query_id // 12 == r.doc_id // 12 for r in found) >= 230
    quantise.save(codes, index, str(tmp_path / "index"))
    loaded, again = quantise.load(spark, str(tmp_path / "index"))
    assert np.array_equal(again.centroids, index.centroids) and np.array_equal(again.words, index.words)
    assert sorted(map(str, quantise.search(loaded, again, points, 5, 2).collect())) == sorted(map(str, found))
    for bad in ({"n_bits": 9}, {"n_subvectors": 3}, {"n_clusters": 0}):
        with pytest.raises(ValueError):
            quantise.fit_ivfpq(points, **({"n_clusters": 4, "n_subvectors": 2, "n_bits": 4} | bad))


def test_all_lists_and_a_word_per_vector_are_exact(spark):
    points = spark.createDataFrame(clustered()[:16], "vec_id long, embedding array<double>")
    index = quantise.fit_ivfpq(points, 1, 1, 8)
    exact = {(r.query_id, r["rank"]): r.doc_id for r in dense.search(points, points, 3, "l2").collect()}
    found = {(r.query_id, r["rank"]): r.doc_id for r in quantise.search(quantise.encode(points, index), index, points, 3, 9).collect()}
    assert found == exact


def test_kmeans_edges(spark):
    points = spark.createDataFrame(clustered(), "vec_id long, embedding array<double>")
    centroids = quantise.fit_kmeans(points, 4)
    groups = {}
    for r in quantise.assign(points, centroids).collect():
        groups.setdefault(r.cluster, set()).add(r.vec_id // 12)
    assert len(quantise.fit_kmeans(points.where("vec_id < 3"), 10)) == 3
    far = quantise.lloyd(quantise._packed(points), np.array([[[0.0] * 8, [99.0] * 8]]), 2)
    assert far[0, 1].tolist() == [99.0] * 8


def test_vector_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [-1.0, -0.2, 0.0, 0.3, 0.9])], "a array<double>, z array<double>, x array<float>").select(vectors.normalised(F.col("a")).alias("a"), vectors.normalised(F.col("z")).alias("z"), vectors.int8(F.col("x")).alias("q"), vectors.int8(F.col("z")).alias("n"), vectors.squared_distance(F.col("a"), F.col("z")).alias("d")).collect()[0]
    assert (row.a, row.z, row.d) == ([0.6, 0.8], [0.0, 0.0], 25.0)
    assert row.q.q == [-127, -25, 0, 38, 114] and row.n.q == [0, 0]


# Dialogue and agent


def test_histories(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "system", "only")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.history for r in dialogue.history_text(m, 2).collect()} == {1: "用户: u\n助手: a", 2: ""}
    assert dialogue.last_messages(m, 0, max_turns=1).count() == 3


def test_working_memory(spark):
    log = [(1, 1, "set", "a", "x"), (1, 2, "set", "a", "y"), (1, 3, "set", "b", "z"), (1, 4, "pop", "b", None), (2, 1, "set", "a", "q"), (2, 2, "clear", None, None), (2, 3, "set", "c", "r"), (3, 1, "pop", "m", None)]
    got = dialogue.working_memory(spark.createDataFrame(log, "conv_id long, seq long, op string, key string, value string")).collect()
    assert sorted((r.conv_id, r.key, r.value) for r in got) == [(1, "a", "y"), (2, "c", "r")]


@pytest.mark.parametrize("policy", ["lru", "fifo"])
def test_replays(spark, policy):
    rng = random.Random(1)
    trace = [(s, i, rng.choice("abcdef")) for s in range(5) for i in range(60)]
    want = {}
    for s, i, k in trace:
        cache = want.setdefault(s, OrderedDict())
        want[s, i] = k in cache
        if k in cache and policy == "lru":
            cache.move_to_end(k)
        cache.setdefault(k)
        if len(cache) > 3:
            cache.popitem(last=False)
    got = dialogue.replay(spark.createDataFrame(trace, "session long, seq long, key string"), 3, policy).collect()
    assert {(r.session, r.seq): r.hit for r in got} == {k: v for k, v in want.items() if isinstance(k, tuple)}


OUTPUTS = [
    ('<tool_call>{"name": "f", "arguments": {"a": {"b": 1}}}</tool_call>', "action"),
    ('<tool_call>{"name": "f"}</tool_call> Final Answer: no', "action"),
    ("<tool_call>{broken}</tool_call>", "unknown"),
    ("<tool_call>{broken}</tool_call>\nFinal Answer: yes", "final_answer"),
    ("thought\nFINAL ANSWER ：两行\n回答 ", "final_answer"),
    ("Thought: a\njust text\nAction: x", "final_answer"),
    ("Thought: a\nObservation: b", "unknown"),
    ("", "unknown"),
]


def test_outputs_are_parsed_alike_in_plans_and_on_the_driver(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(OUTPUTS)], "i int, t string")
    for r in df.select("i", dialogue.parse_output(F.col("t")).alias("p")).collect():
        text, kind = OUTPUTS[r.i]
        here = dialogue.read_output(text)
        assert r.p.type == here["type"] == kind
        assert (r.p.tool_name, r.p.content) == (here.get("tool_name"), here.get("content"))
        assert r.p.arguments is None or json.loads(r.p.arguments) == here["arguments"]


def test_agent_loop():
    tools = {"echo": ("says it", lambda text: f"<{text}>", (("text", "string", "what"),))}
    llm = agent.MockLLM('<tool_call>{"name": "echo", "arguments": {"text": "hi"}}</tool_call>', "Final Answer: done")
    memory = []
    bot = agent.ReActAgent(llm, tools, memory)
    assert bot.run("q") == "done" and "<hi>" in llm.prompts[1]
    assert [m["role"] for m in memory] == ["user", "assistant"] and bot.memory is memory
    endless = agent.MockLLM('<tool_call>{"name": "none", "arguments": {}}</tool_call>')
    assert agent.ReActAgent(endless, tools, max_steps=3).run("q").startswith("<tool_call>") and len(endless.prompts) == 4
    assert "错误" in agent.observation(tools, "echo", {"wrong": 1}) and "错误" in agent.observation({}, "echo", {})
    assert '<tool name="echo">' in agent.shown(tools) and agent.shown({}) == "(没有可用的工具)"
    assert "".join(agent.MockLLM("ab").generate_stream("x")) == "ab"


def test_prompts_with_and_without_history(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, text string")
    hits = spark.createDataFrame([(1, 5, "b", 2, 0.25, None), (1, 4, "a", 1, 0.5, "src")], "query_id long, doc_id long, text string, rank long, score double, source string")
    past = spark.createDataFrame([(1, "用户: x")], "query_id long, history string")
    got = {r.query_id: r.prompt for r in prompt.build(q, hits, "sys", past).collect()}
    assert got[1] == "sys\n\n## 参考文档\n[文档1] a\n[文档2] b\n\n## 对话历史\n用户: x\n\n## 用户问题\nwhy?"
    assert "对话历史" not in got[2]
    shown = {r.query_id: r.result for r in prompt.format_results(q, hits).collect()}
    assert shown == {1: "[文档1] (来源: src, 相关度: 0.500)\na\n\n[文档2] (来源: ?, 相关度: 0.250)\nb", 2: prompt.NOTHING}


def test_budgets_and_text_columns(spark):
    rows = spark.createDataFrame([(1024,), (4096,), (8192,)], "n long").select("n", dialogue.kv_payload_mib(F.col("n")).alias("mib"), dialogue.kv_budget(F.col("n")).alias("b")).collect()
    assert [r.mib for r in rows] == [36.0, 144.0, 288.0]
    assert [(r.b.free_slots, r.b.low, r.b.max_chunks) for r in rows] == [(3072, False, 5), (0, True, 1), (-4096, True, 1)]
    row = spark.createDataFrame([("  x ", "the cat", "")], "s string, t string, e string").select(textual.strip(F.col("s")).alias("s"), textual.term_vector(F.col("t"), ["the", "a"]).alias("v"), textual.term_vector(F.col("e"), ["the", "a"]).alias("e")).collect()[0]
    assert [round(x, 6) for x in row.v] == [round(1 / math.sqrt(2), 6)] * 2 and row.e == [0.0, 1.0]


def test_ingestion_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest_chunks(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "progress"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    spark.createDataFrame([(3, "new")], docs.schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest_chunks(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
