"""Toxicity: decoding against all paths, held-out accuracy, obfuscated and edge rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity
from lodestone.llm.common import documents, held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id"), 4))
    return toxicity.fit(documents(spark, SF), labels)


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    costs = rng.random((toxicity.ALPHABET,) * 3) * 4
    for token in ("1d10t", "w0rthle$$", "stuuupiid", "a.b-c", "$$x!", "|1|"):
        best = None
        for path in itertools.product(*toxicity.lattice(token)):
            word = "".join(s for s, _ in path)
            codes = [0, 0, *(ord(c) - 96 for c in word), 0]
            cost = sum(x for _, x in path) + sum(costs[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            best = min(best or (cost, word), (cost, word))
        assert toxicity.decode(token, costs)[0] == best[1]


def test_viterbi_is_exact_on_long_runs_of_symbols():
    rng = np.random.default_rng(4)
    costs = rng.random((toxicity.ALPHABET,) * 3) * 12
    for _ in range(30):
        token = "".join(rng.choice(list("|1!0@$3a7+(b"), 24))
        best = {(0, 0): 0.0}  # by dynamic programming over all states
        for ways in toxicity.lattice(token):
            step = {}
            for (a, b), cost in best.items():
                for string, extra in ways:
                    x, y, c = a, b, cost + extra
                    for letter in string:
                        k = ord(letter) - 96
                        c, x, y = c + costs[x, y, k], y, k
                    step[x, y] = min(step.get((x, y), np.inf), c)
            best = step
        least = min(c + costs[a, b, 0] for (a, b), c in best.items())
        word = toxicity.decode(token, costs)[0]
        a, b, c = 0, 0, 0.0
        found = toxicity.walk([*toxicity.lattice(token)], costs)
        assert found[0] == word
        # The word found costs as little as any path: align it with the lattice again.
        reach = {(0, 0, 0): 0.0}
        for ways in toxicity.lattice(token):
            step = {}
            for (at, a, b), cost in reach.items():
                for string, extra in ways:
                    if word.startswith(string, at):
                        x, y, c = a, b, cost + extra
                        for letter in string:
                            k = ord(letter) - 96
                            c, x, y = c + costs[x, y, k], y, k
                        key = (at + len(string), x, y)
                        step[key] = min(step.get(key, np.inf), c)
            reach = step
        assert abs(min(c + costs[a, b, 0] for (at, a, b), c in reach.items() if at == len(word)) - least) < 1e-9


def test_logistic_line_is_the_best_one():
    rng = np.random.default_rng(1)
    for sharp in (0.3, 2.0, 30.0):
        x1, x2 = rng.random(400) * 7, rng.random(400) * 30
        y = (rng.random(400) < 1 / (1 + np.exp(-sharp * (x1 - 4)))).astype(int)
        y[rng.random(400) < 0.02] ^= 1
        w = np.array(toxicity.logistic(list(zip(x1, x2, [1] * 400, y))))

        def worth(v):
            z = v[0] + v[1] * x1 + v[2] * x2
            return (y * z - np.logaddexp(0, z)).sum() - ((v - [-2, 1, 0]) ** 2).sum() / 2

        for d in np.eye(3) * 0.01:
            assert worth(w) >= worth(w + d) and (w[np.argmax(d)] == 0 or worth(w) >= worth(w - d))


def test_clean_documents_stay(spark, model):
    scored = toxicity.score(documents(spark, SF), model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("toxic = 0").collect()
    assert sum(r.score < toxicity.THRESHOLD for r in scored) >= 0.99 * len(scored)


@pytest.mark.parametrize("n", [20, 70, 1000, 100_000])
def test_stretches_and_spacing_of_any_length(model, n):
    seen = toxicity.Evidence(model)
    fill = "and the thing is that " * (n // 22)
    for hidden in ("id" + "i" * n + "ot", "i" + "." * n + "diot", "m" + "o" * n + "r" + "o" * n + "n", "i d i o t " * (n // 10 + 1), " ".join("idiot" * (n // 10 + 1)), ".".join("moron" * (n // 10 + 1))):
        assert model.probability(seen.of(f"it was {hidden} again")) >= toxicity.THRESHOLD
    assert model.probability(seen.of(" ".join(fill.replace(" ", "")))) < toxicity.THRESHOLD


def test_held_out_labels(spark, model):
    scored = toxicity.score(documents(spark, SF), model).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where(held_out(F.col("doc_id"), 4)).collect()
    hit = [r for r in scored if r.score >= toxicity.THRESHOLD]
    assert all(0 <= r.score <= 1 for r in scored)
    assert sum(r.toxic for r in hit) >= 0.9 * len(hit)
    assert sum(r.toxic for r in hit) >= 0.85 * sum(r.toxic for r in scored)


@pytest.mark.parametrize("hidden", ["idiot", "1d1ot", "i.d.i.o.t", "i d i o t", "IDIOOOOT!!", "m0ron", "W0RTHLESS", "$cum", "pa-the-tic"])
def test_obfuscated_words_score_like_plain_ones(model, hidden):
    seen = toxicity.Evidence(model)
    text = f"the thing was {hidden} and that is the end of it"
    assert model.probability(seen.of(text)) >= toxicity.THRESHOLD
    assert model.probability(seen.of("the thing was 2024 and that is the end. Of it!!! $$$ a a a a")) < toxicity.THRESHOLD


def test_edge_rows(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "idiot loser", "x"), (2, "moron " * 30000, "x"), (2, "a" * 100000 + "1b", "x")], "doc_id long, text string, score string")
    rows = toxicity.score(df, model).collect()
    assert [r.doc_id for r in rows] == [1, 1, None, 2, 2]
    assert rows[0].score == rows[1].score == model.residual
    assert min(rows[2].score, rows[3].score) > 0.5 > rows[4].score


def test_rows_below_the_threshold_keep_their_columns(spark, model):
    df = spark.createDataFrame([(1, "the idiot and the loser", "x"), (1, "clean", "y"), (None, None, "z")], "doc_id long, text string, score string")
    assert sorted(map(str, toxicity.below(df, model).collect())) == sorted(map(str, df.where("score <> 'x'").collect()))


def test_without_labels_or_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    bare = toxicity.fit(docs, none)
    assert {r.score for r in toxicity.score(docs.limit(5), bare).collect()} == {0.0}
    empty = docs.where("doc_id < 0")
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []
