"""Mixing against plain Python water filling and highest quotients."""

import heapq
import re

from pyspark.sql import functions as F

from lodestone.llm import mixing
from lodestone.llm.common import documents


def water(sizes):
    """Targets by repeated resharing; sizes in source order."""
    weight = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while len(full) < len(sizes):
        rest = total - sum(3 * sizes[i] for i in full)
        each = rest / sum(weight[i] for i in range(len(sizes)) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and each * weight[i] > 3 * sizes[i]}
        target = [3 * sizes[i] if i in full else each * weight[i] for i in range(len(sizes))]
        if not over:
            break
        full |= over
    return target


def check(df):
    rows = mixing.mix(df).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in df.collect()]
    assert sorted(r["size"] for r in rows) == sorted(words)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, water([sizes[s] for s in order]), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS, (s, taken[s], want[s])
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, rows))


def test_documents(spark):
    check(documents(spark, "/root/testdata/sf0.01"))


def test_hot_null_and_capped_sources(spark):
    rows = [(i, "w " * (50 + i % 7), "hot") for i in range(900)] + [(1000 + i, "w " * 10, None) for i in range(5)] + [(2000 + i, "é w\n" * 8, s) for i, s in enumerate(["", "n", "=n", "A", "a", "ä"])]
    rows += [(3000, None, "none"), (None, "one two", "A"), (None, "one two", "A")]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")))


def test_small_capped_sources_over_many_shards(spark):
    source = F.when(F.col("id") < 99_000, "hot").when(F.col("id") < 99_100, "b").when(F.col("id") < 99_103, "c").otherwise("a")
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 21 + 10).cast("int")).alias("text"), source.alias("source"))
    check(df)


def test_empty_and_blank_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], empty.schema)
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_apportionment_is_highest_quotients(spark):
    weights = [0.0, 5.0, 5.0, 1.0, 120.5, 7.25, 7.25, 0.4, 33.0]
    for seats in (0, 1, 7, 40, 1000):
        df = spark.createDataFrame([(0, i, w, seats) for i, w in enumerate(weights)], "g int, i int, w double, seats long")
        got = {r.i: r.got for r in mixing.apportion(df, ["g"], ["i"], "w", "seats").collect()}
        won, heap = [0] * len(weights), [(-w, i) for i, w in enumerate(weights) if w]
        heapq.heapify(heap)
        for _ in range(seats):
            _, i = heapq.heappop(heap)
            won[i] += 1
            heapq.heappush(heap, (-weights[i] / (2 * won[i] + 1), i))
        assert [got[i] for i in range(len(weights))] == won
