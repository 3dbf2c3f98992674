"""Line dedup by a fixed-depth template tree.

A line's tokens with digits are variable fields. The tree parses a line by its number of tokens,
then by its DEPTH leading tokens. At a leaf the different lines are compared place by place: a token
that fewer than MIN_DOCUMENTS of them, or fewer than one in SHARE, have at its place is a variable
field as well. A line stands for two templates, then: all of its tokens, and its tokens without the
variable fields of the leaf, if these are at most one token in MOST_VARIABLE.

A template recurs if it comes in at least MIN_DOCUMENTS different texts of which either the lines of
such templates make up no more than half (their other lines show that they are not copies of each
other), or that have different lines around it. Copies of a document share most of their lines in
the same surroundings and so make no template recur, while boilerplate does, one line or a block of
them. Recurring lines stay in the first document that has them, and are dropped from all others.

Everything is built-in DataFrame functions. What is shuffled for the counts are 64-bit hashes, not
lines; only leaves that have enough different lines send the hashes of their tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound, packed, unpacked, use_checkpoints, words, written

DEPTH = 3
#: Leaves are looked at in lines of so many tokens after the leading ones.
LEAST_REST = 4
MIN_DOCUMENTS = 5
SHARE = 4
MOST_VARIABLE = 3
VARIABLE = "<*>"
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
#: Leaves are told apart by so many values before the exact join; the broadcast is of no more rows.
LEAF_BUCKETS = 1 << 17


def _lines(text: Column) -> Column:
    """Array of (line, at, context) of the lines with a word; context hashes the lines around it."""
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    filled = F.filter(numbered, lambda s: s["line"].rlike(r"[^\x20\x09-\x0D]"))
    beside = lambda a, k: F.coalesce(F.get(a, k)["line"], F.lit("\n"))
    return bound(filled, lambda a: F.transform(a, lambda s, k: F.struct(s["line"].alias("line"), s["at"].alias("at"), F.xxhash64(beside(a, k - 1), beside(a, k + 1)).alias("context"))))


def _masked(line: Column) -> Column:
    """The line's tokens, those with digits replaced."""
    return words(F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, VARIABLE)).otherwise(line))


def _whole(w: Column) -> Column:
    return F.xxhash64(F.lit("line"), F.size(w), w)


def _leaf(w: Column) -> Column:
    """Hash of the leaf of a line's tokens, null for short lines."""
    return F.when(F.size(w) >= DEPTH + LEAST_REST, F.xxhash64(F.lit("leaf"), F.size(w), F.slice(w, 1, DEPTH)))


def _marks(text: Column) -> Column:
    """Array of (at, context, size, whole, leaf, tokens, total) of a text's lines.

    tokens are 32-bit hashes of the tokens after the leading ones, total is the text's words.
    """

    def mark(s: Column) -> Column:
        rest = lambda w: F.when(F.size(w) >= DEPTH + LEAST_REST, F.transform(F.slice(w, F.lit(DEPTH + 1), F.size(w)), lambda x: F.hash(x)))
        return bound(_masked(s["line"]), lambda w: F.struct(s["at"].alias("at"), s["context"].alias("context"), F.size(w).cast("long").alias("size"), _whole(w).alias("whole"), _leaf(w).alias("leaf"), rest(w).alias("tokens")))

    def summed(a: Column) -> Column:
        total = F.aggregate(a, F.lit(0).cast("long"), lambda n, m: n + m["size"])
        return bound(total, lambda t: F.transform(a, lambda m: F.struct(*(m[x].alias(x) for x in ("at", "context", "size", "whole", "leaf", "tokens")), t.alias("total"))))

    return bound(F.transform(_lines(text), mark), summed)


def _meet(rows: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """rows joined with few (one row for each value of on). The join is dealt by other values than the
    counts were, so that both sides are plain shuffles and adaptive execution may split a hot value's rows."""
    return rows.join(few.withColumn("_on", F.bitwise_not(on)).drop(on), F.bitwise_not(rows[on]) == F.col("_on")).drop("_on")


def _generalised(seen: DataFrame) -> DataFrame:
    """(whole, template) of the lines that have a template without their leaf's variable fields."""
    leaves = seen.where("leaf IS NOT NULL").select("leaf", "whole").distinct().groupBy("leaf").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_DOCUMENTS).checkpoint()
    bucket = lambda leaf: F.pmod(leaf, F.lit(LEAF_BUCKETS))
    # At most LEAF_BUCKETS rows whatever the corpus: a filter before the exact join, which alone decides.
    some = F.broadcast(leaves.select(bucket(F.col("leaf")).alias("bucket")).distinct())
    each = seen.where("leaf IS NOT NULL").select("leaf", "whole", "tokens")
    each = each.join(some, bucket(F.col("leaf")) == F.col("bucket"), "left_semi").dropDuplicates(["leaf", "whole"])
    lines = _meet(each, leaves, "leaf").checkpoint()
    at = lines.select("leaf", "m", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    fixed = F.when((F.col("n") >= MIN_DOCUMENTS) & (F.col("n") * SHARE >= F.col("m")), F.col("token"))
    places = at.groupBy("leaf", "place").agg(F.collect_list(fixed).alias("fixed"))  # SHARE tokens at most
    places = places.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("place", "fixed"))).alias("places"))
    kept = F.zip_with("tokens", F.col("places.fixed"), lambda t, fixed: F.when(F.array_contains(fixed, t), t).otherwise(F.lit(0)))
    out = _meet(lines, places, "leaf").select("whole", "leaf", kept.alias("kept"))
    out = out.withColumn("masked", F.size(F.filter("kept", lambda x: x == 0)))
    fit = (F.col("masked") > 0) & (F.col("masked") * MOST_VARIABLE <= F.size("kept") + DEPTH)
    return out.where(fit).select("whole", F.xxhash64(F.lit("fields"), "leaf", "kept").alias("template"))


def _marked(seen: DataFrame, least: int) -> DataFrame:
    """(key, hash, at, context, size, total, template) of the lines whose template comes in enough different texts."""
    columns = ["key", "hash", "at", "context", "size", "total"]
    lines = seen.select(*columns, F.col("whole").alias("template"))
    fields = _generalised(seen).checkpoint()
    lines = lines.unionByName(_meet(seen, fields, "whole").select(*columns, "template"))
    often = lines.select("template", "hash").distinct().groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return _meet(lines, often.select("template"), "template").checkpoint()


def drop_recurring(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_DOCUMENTS, dropped: str | None = "_dropped") -> DataFrame:
    """df with its recurring lines taken out of text, and the numbers of those lines as a column named by dropped, if it is.

    Every input row stays, with all its columns; a null text stays null, and a text may become
    empty. Lines without a word are never dropped. Rows are told apart by key and text: repeated
    rows are one document and lose the same lines. The first document is the one of lowest key
    (null keys last). Templates meet by 64-bit hashes. Very long texts and lines are whole; a text's
    lines are in one row of one task. An empty table gives no rows. Other columns may have any name;
    one of the name in dropped is replaced.
    """
    use_checkpoints(df.sparkSession)
    rows = packed(df)
    of = lambda c: F.col("row").getField(c)
    texts = rows.where(of(text).isNotNull()).select(of(key).alias("key"), of(text).alias("text"))
    seen, delete = written(texts.select("key", F.xxhash64("text").alias("hash"), F.inline(_marks(F.col("text")))))
    try:
        marked = _marked(seen, least)
    finally:
        delete()
    # Texts of which no more than half is in such lines.
    share = marked.groupBy("hash", "at").agg(F.max("size").alias("size"), F.max("total").alias("total")).groupBy("hash")
    own = share.agg((2 * F.sum("size") <= F.max("total")).alias("own"))
    doc = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    by = _meet(marked, own, "hash").groupBy("template", "hash").agg(F.min(doc).alias("doc"), F.min("context").alias("context"), F.max("own").alias("own"))
    # By context first: a common template's rows are then summed in each task before they meet.
    by = by.groupBy("template", "context").agg(F.min("doc").alias("first"), F.count_if("own").alias("n"))
    recurring = by.groupBy("template").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count("*").alias("around"))
    recurring = recurring.where((F.col("n") >= least) | (F.col("around") >= least)).select("template", "first")
    gone = _meet(marked, recurring, "template").where(doc != F.col("first"))
    gone = gone.groupBy("key", "hash").agg(F.sort_array(F.collect_set("at")).alias("dropped"))
    gone = gone.select(F.col("key").alias("of_key"), F.col("hash").alias("of_hash"), "dropped")
    rows = rows.withColumn("hash", F.xxhash64(of(text)))
    joined = rows.join(gone, of(key).eqNullSafe(F.col("of_key")) & (F.col("hash") == F.col("of_hash")), "left")

    def kept(lines: Column) -> Column:
        ends = F.concat("dropped", F.array(F.size(lines)))
        return bound(ends, lambda e: F.flatten(F.transform(e, lambda d, i: bound(F.coalesce(F.get(e, i - 1), F.lit(-1)), lambda p: F.slice(lines, p + 2, d - p - 1)))))

    new = F.when(F.col("dropped").isNull(), of(text)).otherwise(F.array_join(bound(F.split(of(text), "\n", -1), kept), "\n"))
    numbers = {dropped: F.coalesce("dropped", F.array().cast("array<int>"))} if dropped else {}
    return joined.select(*unpacked(df.columns, {text: new, **numbers}))
