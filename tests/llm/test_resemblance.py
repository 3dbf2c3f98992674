"""Near-duplicates of the pipeline's stage against all pairs of shingle sets."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from lodestone.llm import resemblance
from lodestone.llm.common import documents, use_checkpoints


def brute(texts):
    """The lowest place reachable from each text by links of 5-word Jaccard similarity 0.8."""
    sets, inverted, root = [], defaultdict(list), list(range(len(texts)))
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in inverted[g])
        for g in s:
            inverted[g].append(i)
        for j, n in common.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = [rows[k].doc_id for k in brute([r.text for r in rows])]
    got = {r.doc_id: r.component for r in resemblance.near_duplicates(docs).collect()}
    assert [got[r.doc_id] for r in rows] == want


def test_stage_links_copies_of_resemblance_080_to_095(spark):
    """Copies with one to four words of 100 changed at the end of a stretch, blank and repeated rows."""
    use_checkpoints(spark)
    texts = []
    for k in range(30):
        w = [f"w{k}x{i}" for i in range(100)]
        edited = list(w)
        for j in range(k % 4 + 1):
            edited[20 * j + 10] = f"other{j}"
        texts += [" ".join(w), " ".join(edited)]
    texts += [None, "", "few words", "Few  words", "a b c d e f"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(set(brute(texts)))
    assert len(want) < 60
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, df, "").collect()) == want


def test_large_bands_in_blocks(spark, monkeypatch):
    """Chains of edits and a large group of copies of a copy, compared in many small blocks."""
    import random

    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(150):  # about half are near the base, all are near some other
        w = list(base)
        for j in rng.sample(range(12), rng.randrange(4)):
            w[5 * j] = f"e{rng.randrange(3)}"
        texts.append(" ".join(w))
    for k in range(4):
        w = [f"c{k}x{i}" for i in range(80)]
        for j in range(30):
            w[(7 * j) % 80] = f"d{k}x{j}"
            texts.append(" ".join(w))
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in resemblance.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and 8 < len(set(want)) < 200


def test_forest_spans_dense_groups():
    import numpy as np

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**64, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, 185, replace=False), rng.integers(0, 2**64, 4, dtype=np.uint64)))) for _ in range(300)]
    edges = resemblance.forest(list(range(300)), sets)
    assert len(edges) == 299 and len({b for _, b in edges}) == 299


def test_candidates_by_simhash(spark):
    """Fingerprints under Golay keys link near copies, and whole sets verify them."""
    use_checkpoints(spark)
    long = [f"w{i}" for i in range(600)]
    texts = [" ".join(long), " ".join(long[:-1]), " ".join(long[:300]), "", None, "a b", " ".join(f"v{i}" for i in range(90))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [resemblance.shingles(t or "") for t in texts]
    nodes = spark.createDataFrame([(k, resemblance.np.array([resemblance.majority(s)], "u8").view("i8").item(), len(s)) for k, s in enumerate(sets)], "node long, fp long, size long")
    found = {tuple(sorted(r)) for r in resemblance._by_simhash(nodes).collect()}
    assert (0, 1) in found and not any(3 in r or 4 in r for r in found)
    root = {r.doc_id: r.component for r in resemblance.near_duplicates(df).collect()}
    assert root == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}
