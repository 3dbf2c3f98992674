"""Learning words, the likeliest path, positions of unknown characters, and search in Chinese."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, segmenter
from lodestone.operators.segmenter import FOLLOWS, Segmenter
from lodestone.operators.segments import Bm25Index

SENTENCES = ["自注意力机制的计算复杂度是O(n²d)", "Transformer 使用多头注意力机制", "位置编码使用正弦和余弦函数"]
WORDS = "自 注意力 机制 的 计算 复杂度 是 使用 多头 位置 编码 正弦 和 余弦 函数".split()


def corpus(n=3000, seed=4):
    """Lines of words in random order, without spaces."""
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 9))) + rng.choice(["。", " x", ""]) for _ in range(n)]


@pytest.fixture(scope="module")
def known(spark):
    runs = segmenter.runs(spark.createDataFrame([(t,) for t in corpus()], "text string")).cache()
    return segmenter.fitted(runs, segmenter.learn(runs, cohesion=1.0, entropy=1.0))


def brute(known, run):
    """The best of all ways to cut a run."""
    found = []
    for cuts in product([0, 1], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        parts = [run[a:b] for a, b in zip(at, at[1:])]
        p = [known.words.get(w, known.unknown if len(w) == 1 else None) for w in parts]
        if None not in p:
            found.append((sum(p), parts))
    return max(found)[0], [parts for p, parts in found if p == max(found)[0]]


def test_words_are_found(known):
    assert set(WORDS) <= set(known.words) and not {"意力", "注意", "杂度", "力机"} & set(known.words)


def test_path_is_the_best_of_all():
    rng = random.Random(7)
    for _ in range(300):
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): math.log(rng.random()) for _ in range(12)}
        known = Segmenter(words, -4.0)
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 10)))
        got = known.path(run)
        p, ways = brute(known, run)
        assert "".join(got) == run and sum(words.get(w, -4.0) for w in got) == pytest.approx(p) and (len(ways) > 1 or got == ways[0])
    assert Segmenter({}, -1.0).path("ab") == ["a", "b"] and Segmenter({}, -1.0).path("") == []


def test_positions_are_the_best_of_all(known):
    floor = min(known.emit["S"].values(), default=-20.0) - 1
    for chars in ["力", "力机", "计正函", "和复数杂", "没有见过"]:
        def p(states):
            if states[0] not in "BS" or states[-1] not in "ES" or any(b not in FOLLOWS[a] for a, b in zip(states, states[1:])):
                return -math.inf
            return known.start[states[0]] + sum(known.emit[s].get(c, floor) for s, c in zip(states, chars)) + sum(known.move[a + b] for a, b in zip(states, states[1:]))
        got = known.positions(chars)
        assert p(got) == pytest.approx(max(p("".join(s)) for s in product("BMES", repeat=len(chars))))
    assert Segmenter({}, -1.0).cut("新词") == ["新", "词"]


def test_edges_of_texts(spark, known):
    """Null and empty texts, mixed scripts, very long runs, repeated rows."""
    rows = [(1, None), (2, ""), (3, " ,。"), (4, "ABC x1 计算x2"), (5, "计算复杂度" * 4000), (6, SENTENCES[0]), (6, SENTENCES[0])]
    got = spark.createDataFrame(rows, "doc_id int, text string").select("doc_id", known(F.col("text")).alias("w")).collect()
    by = {r.doc_id: r.w for r in got}
    assert (by[1], by[2], by[3], by[4]) == ([], [], [], ["abc", "x1", "计算", "x2"])
    assert by[5] == ["计算", "复杂度"] * 4000 and by[6][:6] == ["自", "注意力", "机制", "的", "计算", "复杂度"] and len(got) == 7


def test_empty_corpus(spark):
    runs = segmenter.runs(spark.createDataFrame([], "text string"))
    known = segmenter.fitted(runs, segmenter.learn(runs))
    assert known.cut("计算") == ["计", "算"] and segmenter.cut_runs(runs, known).count() == 0


def test_chinese_queries_find_their_sentence(spark, known, tmp_path):
    docs = spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "计算复杂度"), (2, "位置编码"), (3, "任意查询")], "query_id long, text string")
    found = bm25.top(bm25.scores(docs, asked, tokenizer=known), 2)
    want = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in found.collect())
    assert [x[:3] for x in want] == [(1, 1, 0), (2, 1, 2)]
    assert bm25.scores(docs, asked).count() == 0  # words between spaces find nothing
    index = Bm25Index(spark, str(tmp_path), tokenizer=known)
    index.add(docs)
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in index.search(asked, 2).collect()) == want


def test_paths_are_found_once(spark, monkeypatch):
    """Runs that a segmenter is fitted to are cut as by cut_runs(), unknown characters included, from one walk of the dictionary."""
    runs = segmenter.runs(spark.createDataFrame([(t,) for t in [*corpus(400), "没有见过的计算", "余没弦"]], "text string")).cache()
    words = segmenter.learn(runs, cohesion=1.0, entropy=1.0).cache()
    want = {r.run: (r.n, r.pieces) for r in segmenter.cut_runs(runs, segmenter.fitted(runs, words)).collect()}
    walked = spark.sparkContext.accumulator(0)
    path = Segmenter.path

    def counting(self, run):
        walked.add(1)
        return path(self, run)

    def cut_runs(counted, first, plain=segmenter._cut):
        return plain(counted, F.col("run"), first, lambda s, x: s.closed(counting(s, x)))

    monkeypatch.setattr(segmenter, "cut_runs", cut_runs)
    got = {r.run: (r.n, r.pieces) for r in segmenter.fitted_cut(runs, words).collect()}
    assert got == want and walked.value == len(want) and any(len(w) == 1 and w in "没有见过" for _, p in want.values() for w in p)
