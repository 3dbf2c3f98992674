"""The trained scorer's derivatives and order, and models in batches."""

import numpy as np
import pytest

from lodestone.operators import rerank
from lodestone.plans import learning_queries

ROWS = "query_id long, doc_id long, query string, content string, score double, rank long, extra string"


def test_gradient_and_hessian_by_finite_differences():
    rng = np.random.default_rng(5)
    x, g, w = rng.normal(size=(9, 4)), np.array([1, 0, 0, 1, 0, 0, 0, 1, 0], bool), rng.normal(size=4)
    loss, grad, hess, n = rerank.pair_sums(x, g, w)
    assert n == 18 and loss == pytest.approx(sum(np.log1p(np.exp(-(a - b) @ w)) for a in x[g] for b in x[~g]))
    e = 1e-5
    for i in range(4):
        d = np.eye(4)[i] * e
        up, down = rerank.pair_sums(x, g, w + d), rerank.pair_sums(x, g, w - d)
        assert grad[i] == pytest.approx((up[0] - down[0]) / (2 * e), rel=1e-6)
        assert hess[i] == pytest.approx((up[1] - down[1]) / (2 * e), rel=1e-6)


def test_features(spark):
    rows = spark.createDataFrame([(1, 1, "a b c", "A b x c", 4.0, 1, ""), (1, 2, "a b c", None, 2.0, 2, ""), (2, 3, "", "a", 0.0, 1, ""), (1, 4, "a b c", "w " * 50_000, 1.0, 3, "")], ROWS)
    got = {r.doc_id: r.f for r in rerank.features(rows).collect()}
    assert got[1] == pytest.approx([1, 1, 0.5, 1, np.log(5)]) and got[2] == pytest.approx([0.5, 0, 0, 0, 0]) and got[3] == pytest.approx([0, 0, 0, 0, np.log(2)])
    assert got[4] == pytest.approx([0.25, 0, 0, 0, np.log(50_001)])


def test_what_is_learnt(spark):
    """A feature that decides gets the weight; the slope is zero there; nothing to learn gives zeros."""
    rng = np.random.default_rng(8)
    data = []
    for q in range(40):
        for d in range(8):
            f = rng.normal(size=3)
            data.append((q, f.tolist(), int(f[1] + 0.5 * rng.normal() > 0.7)))
    df = spark.createDataFrame(data, "query_id long, f array<double>, grade int").repartition(3)
    got = rerank.fit(df).weights
    assert got[1] > 5 * abs(got[0]) and got[1] > 5 * abs(got[2])
    x, groups = np.array([f for _, f, _ in data]), {}
    for i, (q, _, g) in enumerate(data):
        groups.setdefault(q, []).append((i, g))
    spread = np.array([x[[i for q in groups.values() for i, _ in q if 0 < sum(g for _, g in q) < len(q)]][:, j].std() for j in range(3)])
    sets = [(x[[i for i, _ in q]] / spread, np.array([g for _, g in q], bool)) for q in groups.values() if 0 < sum(g for _, g in q) < len(q)]
    w = got * spread
    slope = sum(rerank.pair_sums(a, b, w)[1] / rerank.pair_sums(a, b, w)[3] for a, b in sets) / len(sets) + rerank.RIDGE * w
    assert slope == pytest.approx([0, 0, 0], abs=1e-6)
    assert (rerank.fit(df.where("grade = 0")).weights == 0).all() and (rerank.fit(df.limit(0)).weights == 0).all()


def test_batches(spark):
    """Scores go to their rows, batches are bounded and of like length, and the model is loaded once a worker."""
    rows = spark.createDataFrame([(1, i, "q" if i else None, "x" * ((i * 37) % 101), float(i), i + 1, None) for i in range(60)], ROWS).coalesce(1)

    def load():
        calls = []

        def model(pairs):
            calls.append(1)
            assert len(pairs) <= 7 and [len(b) for _, b in pairs] == sorted(len(b) for _, b in pairs)
            return [len(b) + 1000 * (a == "") + len(calls) * 0 for a, b in pairs]

        return model

    got = rerank.batches(rows, load, 7)
    assert got.columns == [*rows.columns, "rerank_score"]
    assert {r.doc_id: r.rerank_score for r in got.collect()} == {i: (i * 37) % 101 + 1000.0 * (i == 0) for i in range(60)}
    assert rerank.batches(got, load, 7).columns == got.columns and rerank.batches(rows.limit(0), load).count() == 0
    with pytest.raises(Exception, match="1 scores for"):
        rerank.batches(rows, lambda: lambda pairs: [1.0], 7).collect()
    with pytest.raises(ValueError):
        rerank.batches(rows, load, 0)


def test_reranked_and_none(spark):
    rows = spark.createDataFrame([(1, 5, "q", "c", 3.0, 1, ""), (1, 6, "q", "c", 2.0, 2, ""), (1, 7, "q", "c", 2.0, 3, "")], ROWS)
    assert [(r.doc_id, r.rank) for r in rerank.reranked(rerank.none(rows), 2).orderBy("rank").collect()] == [(5, 1), (6, 2)]
    tied = rows.selectExpr("*", "1.0D AS rerank_score")
    assert [r.doc_id for r in rerank.reranked(tied, 3).orderBy("rank").collect()] == [5, 6, 7] and rerank.reranked(tied, 0).count() == 0


def test_unseen_queries_are_ranked_better_than_by_the_double(spark):
    got = {r.ranking: r.ndcg for r in learning_queries.rerank_quality(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"none", "first word", "learned"} and got["learned"] > got["first word"] and got["learned"] >= got["none"] - 0.02
