"""Fingerprints against a plain Python sketch."""

import hashlib
import random
import re
import struct

from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm import fingerprint
from lodestone.llm.common import documents
from lodestone.llm.queries import op3_fingerprints


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def chain(*values):
    h = 42
    for v in values:
        h = xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, int) and abs(v) < 2**20 else "<q", v), h)
    return signed(h)


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not w:
        return []
    if len(w) < 5:
        hashes = [chain(len(w), *w)]
    else:
        long = lambda a, b: signed(xxh64_intdigest(struct.pack("<q", b), xxh64_intdigest(struct.pack("<q", a), 42)))
        h = [chain(x) for x in w]
        two = [long(a, b) for a, b in zip(h, h[1:])]
        hashes = [long(long(two[i], two[i + 2]), h[i + 4]) for i in range(len(w) - 4)]
    every = sorted(set(hashes))
    return [x for i, x in enumerate(every) if i < 32 or x < -(2**63) + 2**61]


def upto(a, b):
    """Both up to the lower cut."""
    cut = min(2**63 if len(x) < 32 else max(x[-1], -(2**63) + 2**61 - 1) for x in (a, b))
    return ({h for h in x if h <= cut} for x in (a, b))


def share(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    x, y = upto(a, b)
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def check(df):
    rows = sorted({(r.doc_id, r.text or "") for r in df.collect()}, key=lambda r: (r[0] is not None, r[0] or 0, chain(r[1])))
    got = {(r.doc_id, r.text): r for r in fingerprint.edited(df).collect()}
    assert len(got) == len(set(rows))
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        r = got[i, text]
        assert (r.edited, r.sketch, r.edited_sketch, r.next_sketch) == (new, brute(text), brute(new), brute(after))


def test_documents(spark, sf_dir):
    check(documents(spark, sf_dir))


def test_sparse_negative_and_null_ids(spark):
    texts = ["", None, "a b", "a b c d e", "ä ö ü ß é " * 40, "x", "one two three four five six seven", " ", "w " * 3000]
    ids = [-5, 0, 127, 128, 129, 10**6, 10**12, -(10**9), None]
    check(spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts)], "doc_id long, text string, key string"))


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(4, "abcdefgh ijk")], "doc_id long, text string")
    check(one)
    assert fingerprint.edited(one.where("doc_id > 4")).collect() == []


def test_query(spark, sf_dir):
    rows = op3_fingerprints(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    order = sorted(texts)
    for r in rows:
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x % 2**64:016X}" for x in brute(text))
        assert abs(r.near_edited - share(brute(text), brute(new))) < 1e-12
        assert abs(r.near_next - share(brute(text), brute(after))) < 1e-12
    assert sum(r.near_edited for r in rows) > 0.6 * len(rows) > 6 * sum(r.near_next for r in rows)


def test_merge_is_the_sketch_of_both_parts(spark):
    texts = ["a b c d e f g h", "k l m n o p q " * 9, "", "a b c d e z", " ".join(f"x{i}" for i in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("s", fingerprint.sketch(F.col("text")))
    for n in range(1, 6):
        both = df.where(f"i < {n}").agg(fingerprint.merge(F.collect_list("s")).alias("s")).collect()[0].s
        every = sorted({x for t in texts[:n] for x in brute(t)})
        assert both == [x for i, x in enumerate(every) if i < 32 or x < -(2**63) + 2**61]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment_of_unequal_documents(spark):
    rng = random.Random(5)
    rows = []
    for n, m in ((12, 30), (12, 400), (60, 400), (60, 4000), (400, 4000), (1500, 3000)):
        for _ in range(25):
            long = [f"w{rng.randrange(10**6)}" for _ in range(m)]
            at = rng.randrange(m - n)
            half = long[at : at + n // 2] + [f"v{rng.randrange(10**6)}" for _ in range(n - n // 2)]
            rows += [(n, m, " ".join(x), " ".join(long)) for x in (long[at : at + n], half)]
    df = spark.createDataFrame(rows, "n int, m int, a string, b string")
    a, b = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))
    wrong = {}
    for r in df.select("*", a.alias("x"), b.alias("y")).select("*", fingerprint.containment(F.col("x"), F.col("y")).alias("c"), fingerprint.resemblance(F.col("x"), F.col("y")).alias("j")).collect():
        x, y = shingles(r.a), shingles(r.b)
        true = len(x & y) / min(len(x), len(y))
        if true == 1:
            assert r.c in (None, 1.0) and (r.c == 1 or r.n < 20)
        if r.m < 32:
            assert (r.c, r.j) == (true, len(x & y) / len(x | y))
        if r.c is not None and r.n >= 60:
            wrong.setdefault((r.n, r.m), []).append(r.c - true)
    assert all(abs(sum(w) / len(w)) < 0.1 for w in wrong.values())


def test_many_rows_of_one_id_and_sparse_ids(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.xxhash64("id")).otherwise(7).alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.hex(F.xxhash64("id", F.lit(1))), F.when(F.col("id") % 7 == 0, F.repeat(F.hex("id"), 5))).alias("text"))
    df = df.union(df.where("doc_id = 7").limit(50))
    check(df)
