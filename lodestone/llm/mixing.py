"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target in words: its share of the whole by weight, stopped at a multiple of
its own size, the excess reshared by weight (water filling, solved in closed form over the sorted
caps). The whole is then dealt out in blocks of equal words to the sources, and what a source has won
to its shards word by word, by the highest quotients weight / (2 * seats + 1). Words of a source's
blocks are at most MAX_PASSES times its size, so the deciding divisor is 1 / MAX_PASSES at least, and
no shard can win more than MAX_PASSES times its own size: every source takes exactly its blocks.
Within a shard, documents lie in a seeded order; the shard's quota takes whole passes over them and
then the first words.

Shards are hash groups of documents whose number follows the corpus, so no source, however hot,
meets in one task. The only single-task steps are over the table of sources; what one source
brings to a task is its list of shards, which MAX_SHARDS bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import use_checkpoints, words

WEIGHTS = (5, 2, 1)
#: Words of a block; a source's quota misses its target by about one block at most.
BLOCK_WORDS = 16
#: A source is taken so many times at most.
MAX_PASSES = 3
#: Mean documents per shard while there are fewer than MAX_SHARDS.
SHARD_DOCS = 400
MAX_SHARDS = 65536
SEED = "mix-1"


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def apportion(parties: DataFrame, group: list[str], tie: list[str], weight: str, seats: str) -> DataFrame:
    """parties with got: seats of its group (long column seats) that each party wins.

    Highest quotients weight / (2a + 1), ties to the lower tie columns. The deciding divisor lies
    between total / (seats + n/2) and total / (seats - n/2), so all but about 2n of the seats of n
    parties are settled at once and only the others are ranked. Parties of weight 0 win nothing.
    """
    alone = Window.partitionBy(*group)
    p = parties.withColumns({"_w": F.sum(weight).over(alone), "_n": F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(alone)})
    share = lambda t: F.col(weight) * t / F.col("_w")
    some = (F.col(weight) > 0) & (F.col(seats) > 0)
    p = p.withColumns({
        "_lo": F.when(some, F.greatest(F.lit(0.0), F.ceil(share(F.col(seats) - F.col("_n") / 2 - 1) - 0.5))).otherwise(0).cast("long"),
        "_hi": F.when(some, F.floor(share(F.col(seats) + F.col("_n") / 2 + 1) + 0.5) + 1).otherwise(0).cast("long"),
    })
    p = p.withColumn("_open", F.col(seats) - F.sum("_lo").over(alone))
    tried = p.where("_hi > _lo").withColumn("_a", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(weight) / (2 * F.col("_a") + 1)), *tie)
    won = tried.withColumn("_r", F.row_number().over(order)).where("_r <= _open").groupBy(*group, *tie).agg(F.count("*").alias("_won"))
    return p.join(won, [*group, *tie], "left").withColumn("got", F.col("_lo") + F.coalesce("_won", F.lit(0))).drop("_w", "_n", "_lo", "_hi", "_open", "_won")


def targets(sources: DataFrame) -> DataFrame:
    """(skey, source_size) of each source to (skey, source_size, target double).

    Sources are weighed in the order of skey; the level of the water is the first at which the
    sources with lower caps per weight are full and no other is.
    """
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("skey"))
    s = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    s = s.withColumns({"cap": (MAX_PASSES * F.col("source_size")).cast("double"), "total": F.sum("source_size").over(everything).cast("double")})
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "skey")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)), "at": F.row_number().over(by)})
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("at", "level"))).over(everything)
    s = s.withColumn("water", F.coalesce(first["level"], F.lit(0.0)))
    return s.select("skey", "source_size", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size long, source_size long, target double, taken long) per input row.

    size counts the ASCII-white-space separated words (null: 0); taken is how many of them the mix
    takes, repeats counted, at most MAX_PASSES times size. A null source is a source of its own,
    the last one. Sources without words have target 0. Equal rows (same id) lie next to each other
    in the seeded order, so reruns agree. An empty table gives no rows. Texts are counted whole,
    however long; other columns are not looked at.
    """
    use_checkpoints(df.sparkSession)
    rows = df.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("="), F.col(source).cast("string"))).alias("skey"),
        F.size(words(F.col(text))).cast("long").alias("size"),
        _hash(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"),
    ).checkpoint()
    n = rows.count()
    shards = min(MAX_SHARDS, max(1, -(-n // SHARD_DOCS)))
    rows = rows.withColumn("shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % shards)
    sizes = rows.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"))
    quota = targets(sizes.groupBy("skey").agg(F.sum("shard_size").alias("source_size")))
    quota = quota.withColumns({"g": F.lit(0), "seats": F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / BLOCK_WORDS).cast("long")})
    quota = apportion(quota, ["g"], ["skey"], "target", "seats").select("skey", "source_size", "target", F.least(F.col("got") * BLOCK_WORDS, F.col("source_size") * MAX_PASSES).alias("won"))
    dealt = apportion(sizes.join(quota, "skey"), ["skey"], ["shard"], "shard_size", "won")
    dealt = dealt.select("skey", "shard", "shard_size", "source_size", "target", F.col("got").alias("words"))
    order = Window.partitionBy("skey", "shard").orderBy(F.substring("h", 9, 24), "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(dealt, ["skey", "shard"])
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    rest = F.col("words") - F.col("passes") * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.withColumn("passes", passes.cast("long")).select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"))
