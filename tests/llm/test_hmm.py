"""The hidden Markov model against sums over all paths and a plain Python unigram."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hmm
from lodestone.llm.common import documents, held_out


def small(rng, states=3, size=5):
    p = lambda *n: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(n))
    return hmm.Model(p(states), p(states, states), p(states, size))


def test_forward_and_counts_are_sums_over_all_paths():
    rng = np.random.default_rng(2)
    m = small(rng)
    seqs = [rng.integers(0, 5, n) for n in (5, 4, 4, 1)]
    ids, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    starts = np.cumsum(lengths) - lengths
    got = hmm.Model(np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)))
    logs = hmm.forward(m, ids, starts, lengths)
    assert math.isclose(hmm.expected(m, ids, starts, lengths, got), logs.sum())
    want = hmm.Model(np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5)))
    for s, log in zip(seqs, logs, strict=True):
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            paths[path] = m.start[path[0]] * math.prod(m.step[a, b] for a, b in zip(path, path[1:])) * math.prod(m.emit[j, x] for j, x in zip(path, s, strict=True))
        total = sum(paths.values())
        assert math.isclose(log, math.log(total))
        for path, p in paths.items():
            want.start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want.step[a, b] += p / total
            for j, x in zip(path, s, strict=True):
                want.emit[j, x] += p / total
    for a, b in ((got.start, want.start), (got.step, want.step), (got.emit, want.emit)):
        assert np.allclose(a, b)


def test_training_raises_the_likelihood_and_beats_the_base(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    hmm.use_checkpoints(spark)
    rows = docs.select(F.col("doc_id").alias("key"), F.lit(False).alias("held_out"), "text")
    vocab = hmm.vocabulary(hmm.token_counts(rows), head=2000)
    seqs = hmm.sequences(rows, vocab).checkpoint()
    model, logs = hmm.train(seqs, vocab, states=4, passes=3)
    assert logs == sorted(logs)
    for p in (model.start, model.step, model.emit):
        assert np.allclose(p.sum(-1), 1)
    assert ((vocab.unseen() > 0) & (vocab.unseen() <= 1)).all()


def brute(rows):
    """{row: (held_out, n_tokens, n_known, train_tokens, base)}"""
    out = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    toks = [hmm.tokens(t or "") for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, toks, strict=True) if not out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(out(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, toks, strict=True)]


def probability(model, vocab, count, text):
    """log10 probability of a text by sums over all states, token by token."""

    def emitted(token):
        if token in vocab.head:
            return model.emit[:, vocab.head[token]]
        k = hmm.token_class(token)
        n = sum(c for t, c in count.items() if t not in vocab.head and hmm.token_class(t) == k)
        v = sum(1 for t in count if t not in vocab.head and hmm.token_class(t) == k)
        within = (count[token] - vocab.discount) / n if count[token] else vocab.discount * v / n if n else 1.0
        return model.emit[:, len(vocab.head) + k] * within

    log, state = 0.0, model.start
    for i, token in enumerate(hmm.tokens(text)):
        state = (state @ model.step if i else state) * emitted(token)
        log += math.log10(state.sum())
        state = state / state.sum()
    return log


def check(df, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    monkeypatch.setattr(hmm.vocabulary, "__defaults__", (head,))
    seen, train, vocabulary = {}, hmm.train, hmm.vocabulary
    monkeypatch.setattr(hmm, "train", lambda *a: seen.setdefault("model", train(*a)))
    monkeypatch.setattr(hmm, "vocabulary", lambda *a: seen.setdefault("vocab", vocabulary(*a)))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = hmm.language_scores(df, held_out(F.col("doc_id"), 7), states=3, passes=2).collect()
    assert len(got) == len(rows)
    want = sorted(zip([r[0] for r in rows], brute(rows), strict=True), key=str)
    for (key, (held, n, known, total, base)), r in zip(want, sorted(got, key=lambda r: str((r.doc_id, (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)))), strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (key, held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score <= 1e-9
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2 for w in hmm.tokens(t or ""))
    short = {(i, t) for i, t in rows if len(t or "") < 500}
    for i, t in sorted(short, key=str)[:40]:
        want = probability(seen["model"][0], seen["vocab"], count, t or "")
        assert any(math.isclose(r.score, want, rel_tol=1e-9, abs_tol=1e-9) for r in got if r.doc_id == i)
    return got


def test_cutoff_is_the_lowest_count_that_few_reach(spark):
    rng = np.random.default_rng(3)
    for values in ([1] * 50, [int(x) for x in rng.zipf(1.3, 1500).clip(max=10**15)], [7], [], list(range(900)), [3] * 10 + [4] * 5 + [10**12] * 3):
        df = spark.createDataFrame(list(Counter(values).items()), "c long, n long")
        for most in (0, 2, 49, 50, 1000):
            got = hmm.cutoff(df, most, 3)
            assert got == min(t for t in {3, *(v + 1 for v in values)} if t >= 3 and sum(v >= t for v in values) <= most)


@pytest.mark.parametrize("head", [300, hmm.HEAD])
def test_documents(spark, sf_dir, monkeypatch, head):
    got = check(documents(spark, sf_dir), monkeypatch, head)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edge_rows(spark, monkeypatch):
    rows = [(1, None), (1, ""), (2, "A b"), (2, "A b"), (None, "b é\x0bb"), (9, "new words held out"), (12, "x " * 30000)]
    check(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string"), monkeypatch, 3)


def test_nothing_to_learn_from(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.language_scores(empty, F.lit(False)).collect() == []
    rows = hmm.language_scores(spark.createDataFrame([(1, "a b")], empty.schema), F.lit(True)).collect()
    assert (rows[0].n_known, rows[0].train_tokens, rows[0].base_score) == (0, 0, 0.0)


def test_probabilities_of_all_tokens_sum_to_one(spark):
    """Head symbols, known tail tokens and one unseen token per class share the whole of a state's mass."""
    hmm.use_checkpoints(spark)
    counted = hmm.token_counts(documents(spark, "/root/testdata/sf0.001"))
    vocab = hmm.vocabulary(counted, head=100)
    tail = [(bytes(r.token), r.c) for r in counted.collect() if bytes(r.token) not in vocab.head]
    mass = np.zeros(hmm.CLASSES)
    for t, c in tail:
        mass[hmm.token_class(t)] += (c - vocab.discount) / vocab.class_n[hmm.token_class(t)]
    mass += vocab.unseen()
    assert np.allclose(mass, 1)
