"""Shards: exact sizes, gapless slots, uniformity, and what its draws must add up to."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, sharding
from lodestone.llm.common import documents


def laws(rows, n, n_shards):
    by = Counter(r.shard for r in rows)
    assert sorted((by[i] for i in range(n_shards)), reverse=True) == sharding.sizes(n, n_shards)
    for i in range(n_shards):
        assert sorted(r.slot for r in rows if r.shard == i) == list(range(by[i]))


def test_rows_of_the_matrix_add_up():
    sizes = [0, 5, 700, 1, 0, 33, 4000, 17]
    before = np.concatenate(([0], np.cumsum(sizes)))
    shards = sharding.sizes(sum(sizes), 5)
    rows = [sharding.matrix_row(before, i, shards, 7) for i in range(len(sizes))]
    assert [sum(r) for r in rows] == sizes and [sum(c) for c in zip(*rows, strict=True)] == shards
    assert rows[2] == sharding.matrix_row(before, 2, shards, 7)


def test_large_populations_are_drawn_alike():
    """The sampler for large populations has the moments of the hypergeometric law, and its bounds."""
    rng = np.random.default_rng(1)
    for good, bad, drawn in [(60, 140, 50), (5, 5, 10), (0, 9, 3), (9, 0, 3), (1000, 10, 500)]:
        x = np.array([sharding.hypergeometric(rng, good, bad, drawn, large=0) for _ in range(3000)])
        n = good + bad
        mean, var = drawn * good / n, drawn * good / n * bad / n * (n - drawn) / max(1, n - 1)
        assert x.min() >= max(0, drawn - bad) and x.max() <= min(good, drawn)
        assert abs(x.mean() - mean) <= 5 * (var / 3000) ** 0.5 + 1e-9 and abs(x.var() - var) <= 0.2 * var + 1e-9
    big = sharding.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 5 * 10**10)
    assert abs(big - 2 * 10**10) < 10 * (5e10 * 0.24 * 0.5) ** 0.5


def test_every_place_is_as_likely(spark):
    """Over many seeds, each of 12 rows of three unequal partitions is in each (shard, slot) equally often, and pairs of rows meet as often as they should."""
    df = spark.range(12).select("id", (F.col("id") > 8).cast("int").alias("p")).repartition(3, "p").cache()
    runs, at, together = 50, Counter(), 0
    for seed in range(runs):
        rows = {r.id: (r.shard, r.slot) for r in sharding.shuffled(df, 3, seed, block_rows=2).collect()}
        at.update(rows.items())
        together += rows[0][0] == rows[1][0]
    assert sum((at[i, (s, k)] - runs / 12) ** 2 / (runs / 12) for i in range(12) for s in range(3) for k in range(4)) < 200  # 121 degrees of freedom
    assert abs(together / runs - 3 / 11) < 0.25


@pytest.mark.parametrize("n_rows", [0, 1, 5, 803])
def test_sizes_slots_and_columns(spark, n_rows):
    """Empty and small tables, repeated rows, nulls, clashing names."""
    df = spark.range(n_rows, numPartitions=5).select(F.when(F.col("id") % 3 > 0, F.lit(7)).alias("part"), F.lit(None).cast("string").alias("slot"), F.lit("x").alias("row"))
    got = sharding.shuffled(df, 8, block_rows=20)
    assert got.columns == ["part", "slot", "row", "shard"]
    rows = got.collect()
    laws(rows, n_rows, 8)
    assert Counter(r.part for r in rows) == Counter(r.part for r in df.collect())


def test_reruns_and_bad_arguments(spark):
    df = spark.range(500, numPartitions=4)
    a, b, c = (sorted(map(tuple, sharding.shuffled(df, 3, s).collect())) for s in (1, 1, 2))
    assert a == b != c
    with pytest.raises(ValueError):
        sharding.shuffled(df, 0)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    rows = queries.op13_sharding(spark, sf_dir).collect()
    laws(rows, len(texts), 8)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
