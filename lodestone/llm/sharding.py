"""Uniform shuffling into shards of exact sizes, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn first, as if all rows had been
shuffled at once: a row of the matrix has the partition's size, a column the shard's. A partition then
permutes its rows locally, which deals the counts of its row to them, and sends them off; each shard
permutes what it gets. Every assignment of rows to places is then equally likely, and no shard misses
its size.

The matrix is never held whole. It is halved along the partitions, each halving a hypergeometric
draw whose seed is its place, so a task draws its own row in log2(partitions) steps from the sizes
of the partitions. A shard's permutation is two steps as well: rows scatter over blocks at random,
and blocks are ordered by random keys; a place is the rows of the blocks before and the place in
the block. So no shard has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import packed, unpacked, use_checkpoints

SEED = 20240301
#: Mean rows of a block, which one task sorts.
BLOCK_ROWS = 100_000
#: Populations from here on are beyond numpy's own sampler.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int, large: int = LARGE) -> int:
    """Good ones among drawn of good + bad without replacement, for populations of any size.

    From large on: inversion over 12 deviations about the mode, whose weights are products of ratios.
    """
    if good < large and bad < large:
        return int(rng.hypergeometric(good, bad, drawn))
    n = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (n + 2)))
    wide = 20 + int(12 * np.sqrt(max(1.0, drawn * (good / n) * (bad / n) * ((n - drawn) / max(1, n - 1)))))
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - drawn + k[:-1] + 1)
    weight = np.concatenate(([0.0], np.cumsum(step)))
    share = np.cumsum(np.exp(weight - weight.max()))
    return int(k[np.searchsorted(share, rng.random() * share[-1], side="right")])


def split(rng: np.random.Generator, columns: list[int], drawn: int) -> list[int]:
    """How many of drawn rows each column gets, when all places are dealt at random."""
    out, left = [], sum(columns)
    for c in columns:
        left -= c
        got = hypergeometric(rng, c, left, drawn)
        out.append(got)
        drawn -= got
    return out


def matrix_row(before: np.ndarray, i: int, shards: list[int], seed: int) -> list[int]:
    """Row i of the communication matrix: rows of partition i for each shard.

    before[j] is the number of rows in the partitions before j, with the total at the end. The same
    arguments give the same row in any task.
    """
    low, high, columns = 0, len(before) - 1, shards
    while high - low > 1:
        mid = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), columns, int(before[mid] - before[low]))
        if i < mid:
            high, columns = mid, left
        else:
            low, columns = mid, [c - x for c, x in zip(columns, left, strict=True)]
    return columns


def sizes(n: int, n_shards: int) -> list[int]:
    """Rows of each shard, at most one apart, larger ones first."""
    return [n // n_shards + (i < n % n_shards) for i in range(n_shards)]


def shuffled(df: DataFrame, n_shards: int, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with shard int (0 to n_shards - 1) and slot long (gapless from 0 in each shard), uniformly at random.

    Shard sizes differ by one at most. Rows may be anything, equal rows and nulls included: they are
    dealt out as they stand, each to a place of its own, and their columns may have any names (shard
    and slot are replaced). Fewer rows than shards leave the last shards empty; an empty table gives
    no rows. The rows are checkpointed, since what a task draws goes with the place of a row in its
    partition; the same seed and the same partitions then give the same result, also when tasks run
    again. Keep wide columns out and join them afterwards.

    The driver holds one number for each partition of df, 8 bytes for its megabytes.
    """
    if n_shards < 1 or block_rows < 1:
        raise ValueError("n_shards and block_rows are 1 or more")
    use_checkpoints(df.sparkSession)
    rows = packed(df).withColumn("part", F.spark_partition_id()).checkpoint()
    counts = dict(rows.groupBy("part").count().collect())
    before = np.concatenate(([0], np.cumsum([counts.get(i, 0) for i in range(1 + max(counts, default=-1))], dtype=np.int64)))
    shards = sizes(int(before[-1]), n_shards)
    blocks = -(-max(shards) // block_rows) or 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, rng, at = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if places is None:
                part = b.column("part")[0].as_py()
                rng = np.random.default_rng([seed, part])
                places = rng.permutation(np.repeat(np.arange(n_shards, dtype=np.int32), matrix_row(before, part, shards, seed)))
            n = b.num_rows
            new = [pa.array(places[at : at + n]), pa.array(rng.integers(blocks, size=n, dtype=np.int32)), pa.array(rng.integers(2**63 - 1, size=n))]
            yield pa.RecordBatch.from_arrays([b.column("row"), *new], ["row", "shard", "block", "draw"])
            at += n

    kind = rows.schema["row"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"row {kind}, shard int, block int, draw long")
    by_block = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("draw"))
    put = dealt.withColumn("place", place.cast("long")).join(F.broadcast(starts), ["shard", "block"])  # a row for each 100,000 rows
    return put.select(*unpacked(df.columns, {"shard": F.col("shard"), "slot": F.col("start") + F.col("place") - 1}))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
