"""Threshold-scaled sketches of documents.

A sketch keeps every hash of a text's five-word shingles below a fixed fraction of the hash range,
and the LEAST smallest hashes in any case, so that short texts have a sketch as well. Sketches of
parts merge by union. Two sketches are compared up to the lower of their cuts, up to which both are
complete, so the share of one found in the other estimates containment however unequal the
documents are. Where a short text has no hash below the cut of a long one, nothing is known of its
containment. Everything is built-in DataFrame functions; a sketch is an array of sorted longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import bound, use_checkpoints, words

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
#: So many of the smallest hashes are kept in any case; texts with fewer are kept whole.
LEAST = 32
BELOW = -(2**63) + 2**64 // SCALE


def _hashes(w: Column) -> Column:
    """Hashes of all shingles of an array of words; fewer words are one shingle, none give none."""
    n = F.size(w) - (SHINGLE - 1)
    pair = lambda a, b: F.xxhash64(a, b)
    five = bound(
        F.transform(w, lambda x: F.xxhash64(x)),
        lambda h: bound(
            F.zip_with(F.slice(h, 1, n + 2), F.slice(h, 2, n + 2), pair),
            lambda twos: F.zip_with(F.zip_with(F.slice(twos, 1, n), F.slice(twos, 3, n), pair), F.slice(h, 5, n), pair),
        ),
    )
    none = F.array().cast("array<bigint>")
    return F.when(F.size(w) == 0, none).when(n < 1, F.array(F.xxhash64(F.size(w), w))).otherwise(five)


def _keep(h: Column) -> Column:
    """The sketch of an array of hashes."""

    def full(low: Column) -> Column:
        return F.when(F.size(low) >= LEAST, low).otherwise(F.slice(F.sort_array(F.array_distinct(h)), 1, LEAST))

    return bound(F.sort_array(F.array_distinct(F.filter(h, lambda x: x < BELOW))), full)


def sketch(text: Column) -> Column:
    """The sketch of a text; null and blank texts have an empty one. Equal words give equal sketches."""
    return bound(words(text), lambda w: bound(_hashes(w), _keep))


def merge(sketches: Column) -> Column:
    """The sketch of the union of the shingles of an array of sketches."""
    return bound(F.flatten(sketches), _keep)


def _cut(a: Column) -> Column:
    """The hash up to which a sketch is complete: no bound for a text that is kept whole."""
    return F.when(F.size(a) < LEAST, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(BELOW - 1), F.element_at(a, -1)))


def _compared(a: Column, b: Column, body) -> Column:
    """body(hashes of a, of b, in both), counted up to the lower cut; two empty sketches are alike."""

    def upto(cut: Column) -> Column:
        def counts(pair: Column) -> Column:
            return bound(F.struct(F.size(pair["a"]).alias("a"), F.size(pair["b"]).alias("b"), F.size(F.array_intersect(pair["a"], pair["b"])).alias("both")), lambda n: body(n["a"], n["b"], n["both"]))

        return bound(F.struct(F.filter(a, lambda x: x <= cut).alias("a"), F.filter(b, lambda x: x <= cut).alias("b")), counts)

    found = bound(F.least(_cut(a), _cut(b)), upto)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(found)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles that the other has, null where the sketches
    say nothing of it; exact for two texts that are kept whole."""
    return _compared(a, b, lambda x, y, both: F.when(F.least(x, y) > 0, both / F.least(x, y)))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; exact for two texts that are kept whole."""
    return _compared(a, b, lambda x, y, both: both / (x + y - both))


def printed(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


#: What tells documents apart: whether they have a key, the key (or 0), a hash of the text.
ID = ("known", "key", "hash")


def _successors(ids: DataFrame) -> DataFrame:
    """ids (ID, ...; rows are different) with next: struct of the ID of the row after it, the first one after the last.

    Rows are dealt to ranges by sampled keys and ordered there. Only the first row of each range meets
    the others' in one task.
    """
    placed = ids.repartitionByRange(*ID).withColumn("part", F.spark_partition_id()).checkpoint()
    own = F.struct(*ID)
    every = Window.partitionBy(F.lit(0))
    heads = placed.groupBy("part").agg(F.min(own).alias("head"))
    heads = heads.select(F.col("part").alias("of"), F.coalesce(F.lead("head").over(every.orderBy("part")), F.min("head").over(every)).alias("head"))
    inside = Window.partitionBy("part").orderBy(*ID)
    led = placed.withColumn("after", F.lead(own).over(inside)).join(heads, F.col("part") == F.col("of"))
    return led.withColumn("next", F.coalesce("after", "head")).drop("part", "of", "after", "head")


def edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, edited, sketch, edited_sketch, next_sketch) per input row.

    edited replaces the last quarter of a text's code points by the first as many of the next
    document's. Documents follow by key, null keys first, those of one key by a hash of their text;
    the first one follows the last. Repeated rows are one document, and are many again at the end.
    Null texts are empty; texts are whole however long; an empty table gives no rows; other columns
    are not looked at. A document sends its text once, and to the one before it the part that is
    needed there.
    """
    use_checkpoints(df.sparkSession)
    rows = df.select(F.col(key).isNotNull().alias("known"), F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    ids = rows.select(*ID, F.floor(F.length("text") / 4).cast("int").alias("cut")).distinct()
    to = [F.col(c).alias(f"to_{c}") for c in ID]
    before = _successors(ids).select(*to, "cut", *(F.col("next").getField(c).alias(f"next_{c}") for c in ID))
    docs = rows.groupBy(*ID).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    same = lambda name: [F.col(c) == F.col(f"{name}_{c}") for c in ID]
    # Reading n keeps this branch's shuffle the same as the other's, so that it is reused.
    given = docs.join(before, same("next")).where("n > 0")
    given = given.select(*(f"to_{c}" for c in ID), F.substring(F.col("text"), F.lit(1), F.col("cut")).alias("start"), sketch(F.col("text")).alias("next_sketch"))
    pairs = docs.join(given, same("to"))
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - F.floor(F.length("text") / 4).cast("int"))
    out = pairs.withColumn("edited", F.concat(kept, "start")).withColumns({"sketch": sketch(F.col("text")), "edited_sketch": sketch(F.col("edited"))})
    # Copies come back in groups, so that no array has as many elements as there are copies.
    group = F.lit(1 << 16)
    out = out.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, group.cast("long"))))
    out = out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.least(group, F.col("n") - F.col("from")).cast("int"))))
    return out.select(F.when(F.col("known"), F.col("key")).alias(key), "text", "edited", "sketch", "edited_sketch", "next_sketch")
