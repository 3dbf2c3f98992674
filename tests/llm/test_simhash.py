"""SimHash components against all-pairs brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm import simhash
from lodestone.llm.common import documents, use_checkpoints


def brute_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{node: lowest node reachable} for a list of fingerprints, nodes being places."""
    x = np.array(prints, np.uint64)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 4):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(x))]


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = sorted(docs.select("doc_id", "text").collect())
    prints = [brute_print(r.text) for r in rows]
    want = [rows[k].doc_id for k in brute_components(prints)]
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()}
    assert [got[r.doc_id] for r in rows] == list(zip(prints, want, strict=True))


def test_edge_rows(spark):
    df = spark.createDataFrame([(5, None, "x"), (3, "", "x"), (9, " \n", "x"), (7, "Abc d", "x"), (8, "aBC D", "x"), (7, "Abc d", "x"), (None, "lone words here", "x"), (2, "w " * 50000, "x")], "doc_id long, text string, fp string")
    rows = sorted(((r.doc_id, r.fp, r.component) for r in simhash.near_duplicates(df).collect()), key=str)
    by = [(a, c) for a, _, c in rows]
    assert sorted(by, key=str) == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (7, 7), (None, None), (2, 2)], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("bits", range(5))
def test_linked_fingerprints_share_a_key(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in x], np.uint64)
    a, b = (set(zip(at.tolist(), key.tolist(), strict=True)) for at, key in (simhash.keys(x), simhash.keys(x ^ flips)))
    assert {i for i, _ in a & b} == set(range(len(x)))


def test_dense_groups_and_chains(spark):
    """A ball of near fingerprints, a long chain of links, and bystanders."""
    use_checkpoints(spark)
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**63))
    ball = {centre ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(1500)}
    chain, at = [], int(rng.integers(0, 2**63))
    for k in range(60):
        at ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        chain.append(at)
    prints = list(dict.fromkeys([*ball, *chain, *map(int, rng.integers(0, 2**63, 500))]))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "name long, node long")
    edges = simhash.links(nodes.select(F.col("node").alias("fp"))).checkpoint()
    assert edges.count() < 60 * len(prints)
    got = {r.node: r.root for r in simhash.components(edges, nodes).collect()}
    want = brute_components(prints)
    assert [got.get(s, k) for k, s in enumerate(signed)] == want
