"""Searches of given lists send packed vectors, however many pairs a query set has."""

import numpy as np
import pytest

from lodestone.operators import probed
from lodestone.plans import vector_queries


@pytest.mark.parametrize("name", vector_queries.PACKED)
def test_no_row_is_a_component(spark, sf_dir, name):
    """What is shuffled are blocks and the nearest, not vectors' components joined with pairs."""
    df = {q.__name__: q for q in vector_queries.QUERIES}[name](spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Join Inner" not in plan.replace("Join Cross", "")


@pytest.mark.parametrize("coded", [False, True])
def test_copies_and_missing_vectors(spark, coded):
    """Equal vectors rank by id over several blocks; null and empty vectors are left out, as is a query without any."""
    x = np.random.default_rng(3).integers(-3, 4, (30, 8)).astype(float)
    rows = [(i, x[i].tolist()) for i in range(30)] + [(100 + i, x[20].tolist()) for i in range(50)] + [(31, None), (40, []), (60, None)]
    points = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = points.where("vec_id % 20 = 0")
    given = probed.Given.of(points, 4, 6, 2, 2)
    ids = np.array([i for i, v in rows if v])
    v = np.array([v for _, v in rows if v])
    d = lambda a, b: np.round(((a[:, None] - b[None]) ** 2).sum(2), 9)
    cen = v[:4]
    mine = d(v, cen).argmin(1)
    words = v[4:10] - cen[mine[4:10]]
    rest = v - cen[mine]
    codes = np.stack([d(rest[:, j : j + 4], words[:, j : j + 4]).argmin(1) for j in (0, 4)], 1)
    pairs = {}
    for q in np.flatnonzero(ids % 20 == 0):
        for c in np.argsort(d(v[q : q + 1], cen)[0], kind="stable")[:2]:
            for p in np.flatnonzero(mine == c):
                to = v[p] if not coded else cen[c] + np.concatenate([words[codes[p, 0], :4], words[codes[p, 1], 4:]])
                pairs[ids[q], ids[p]] = round(float(((v[q] - to) ** 2).sum()), 9)
    got = {(r.query_id, r.doc_id): r.d for r in probed.distances(queries, points, given, coded).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - pairs[k]) < 1e-8 for k in pairs)
    best = {(r.query_id, r["rank"]): r.doc_id for r in probed.search(queries, points, given, coded, 10).collect()}
    for q in {q for q, _ in pairs}:
        want = sorted((e, p) for (a, p), e in pairs.items() if a == q)[:10]
        assert [best[q, i + 1] for i in range(len(want))] == [p for _, p in want]
