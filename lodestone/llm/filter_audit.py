"""How filters interact: a histogram of failure masks, and every order of the filters read off it.

Each document's failures become one mask. Documents are counted by part and mask, at most 2^filters
cells a part, and what any order of the filters would keep, remove or have removed already follows
from the cells alone: no order reads a document again.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound, words

#: letter -> condition under which a text fails, from struct(n_words, n_distinct, n_capitals, n_chars, marked).
#: The filter against repeated texts comes last, and is no condition on one text.
RULES = {
    "A": lambda m: m["n_words"] < 200,
    "B": lambda m: 100 * m["n_distinct"] < 50 * m["n_words"],
    "C": lambda m: 100 * m["n_capitals"] > 2 * m["n_chars"],
    "D": lambda m: m["marked"],
}
REPEATED = "E"
COUNTS = ("n", "good", "toxic")


def measures(text: Column) -> Column:
    """What the rules look at, as one struct; a null text measures as an empty one."""
    t = F.coalesce(text, F.lit(""))
    of_words = bound(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    return bound(
        of_words,
        lambda w: F.struct(
            w["n"].alias("n_words"),
            w["distinct"].alias("n_distinct"),
            (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).alias("n_capitals"),
            F.length(t).alias("n_chars"),
            t.rlike(r"[#$%&*|]").alias("marked"),
        ),
    )


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source", rules: dict = RULES) -> DataFrame:
    """(part string, mask int, n, good, toxic long): documents of each part by the filters they fail.

    Bit i of mask is rule i; the next one is set if a smaller key has the identical text anywhere in
    the table, in any part. A null text is an empty one and a null part the empty string; a row
    without a key neither repeats a text nor is repeated. Repeated rows count each, and none of
    them repeats another, as no key is smaller. good and toxic count documents that labels (doc_id,
    quality, toxic) marks 1 in any of its rows; null or absent labels mark nothing. Empty tables give
    no rows, and columns that are not named are not read.

    Texts travel as digests. Equal rows are counted before they are dealt out by key and digest, so
    that a text, a key or a part that a third of all rows have is spread over all tasks.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    failed = bound(measures(F.col(text)), lambda m: reduce(lambda a, b: a + b, (F.when(rule(m), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules.values()))))
    rows = docs.select(F.col(key).alias("key"), F.sha2(t, 256).alias("digest"), F.coalesce(F.col(part), F.lit("")).alias("part"), failed.alias("mask"))
    rows = rows.groupBy("key", "digest", "part", "mask").agg(F.count("*").alias("n"))
    # Reading n keeps this branch's shuffle the same as the other's, so that it is reused.
    first = rows.groupBy("digest").agg(F.min(F.when(F.col("n") > 0, F.col("key"))).alias("first"))
    rows = rows.join(first, (rows["digest"] == first["digest"]) & (rows["key"] == first["first"]), "left").select("key", "part", "n", F.when(F.col("key").isNotNull() & F.col("first").isNull(), F.col("mask") + (1 << len(rules))).otherwise(F.col("mask")).alias("mask"))
    marked = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = labels.groupBy(F.col("doc_id").alias("labelled")).agg(marked("quality"), marked("toxic"))
    rows = rows.join(known, rows["key"] == known["labelled"], "left")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def orders(counted: DataFrame, letters: str = "".join(RULES) + REPEATED) -> DataFrame:
    """Every part, order of the filters and step, zeros included: (part, filter_order string, step int
    from 1, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley long).

    kept is left after the step; removed goes at it; redundant fails its filter but has gone before;
    unique_fails fails no other filter; good_lost and toxic_lost are labelled documents among the
    removed; shapley is what the step's filter removes, summed over all orders. A part's cells, at most
    2^filters, are one row, which the orders are read off in place. No cells give no rows.
    """
    bit = F.create_map(*(x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))))
    by_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    every = F.explode(F.lit(["".join(p) for p in permutations(letters)])).alias("filter_order")
    rows = by_part.select("part", "cells", every)
    rows = rows.select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    places = F.split("filter_order", "")
    rows = rows.withColumns({"own": F.element_at(bit, F.get(places, F.col("step") - 1)), "before": F.aggregate(F.slice(places, 1, F.col("step") - 1), F.lit(0), lambda a, c: a + F.element_at(bit, c))})

    def total(count: str, condition) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(condition(c["mask"]), c[count]).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    here = lambda m: fails(m) & ~gone(m)
    rows = rows.select(
        "part",
        "filter_order",
        "step",
        "own",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
