"""Quality rules as a bitmask ledger.

ledger() evaluates every rule once per document and stores the failure bits beside the
measurements. Policies are versioned sets of rules; applying another version, or asking what each
rule of a policy does alone, reads only the ledger. Everything is built-in DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, bound, words

SYMBOLS = "#*$%&|<>"

#: name -> condition under which a document fails; the bit is the place in this dictionary.
#: Append only: bits of stored ledgers keep their meaning.
RULES = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "shouting": lambda: 10 * F.col("n_exclaims") > F.col("n_words"),
    "capitals": lambda: 10 * F.col("n_capitals") > 4 * F.col("word_chars"),
    "repeated_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words")),
}
BASE = ("few_words", "repeated_windows")
POLICIES = {"v1": BASE, "v2": (*BASE, "symbols", "shouting", "capitals", "repeated_lines", "word_length")}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_capitals")


def bits(policy: str) -> int:
    """The mask of a policy version."""
    names = list(RULES)
    return sum(1 << names.index(x) for x in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _windows(w: Column) -> Column:
    """A 64-bit hash of every three consecutive words."""
    n = F.size(w) - 2
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    joined = bound(hashes, lambda h: F.zip_with(F.zip_with(F.slice(h, 1, n), F.slice(h, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(h, 3, n), lambda ab, c: F.xxhash64(ab, c)))
    return F.when(n > 0, joined).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words that lie in windows which occur twice or more: sorts (hash, place), keeps places whose
    neighbour has the same hash, and adds up what each adds to the covered stretch."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = bound(
        pairs,
        lambda s: F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))),
            lambda x: x["i"],
        ),
    )
    return bound(
        F.sort_array(places),
        lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x),
    )


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the MEASURES) of each row. A null text measures as an empty one; nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = words(F.col(text))
    of_words = bound(w, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), bound(_windows(x), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_covered(h))).alias("repeats")))
    of_lines = bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    rows = df.select(
        F.col(key),
        of_words.alias("w"),
        of_lines.alias("l"),
        _without(t, SPACES).alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).alias("n_symbols"),
        (F.length(t) - _without(t, "!")).alias("n_exclaims"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("n_capitals"),
    )
    named = rows.withColumns({"n_words": F.col("w.n"), "n_repeat_words": F.col("w.repeats"), "n_lines": F.col("l.n"), "n_dup_lines": F.col("l.dup")})
    return named.select(key, *(F.col(m).cast("bigint").alias(m) for m in MEASURES))


def ledger(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, failed, the MEASURES): bit i of failed is set if rule i of RULES fails.

    One row per input row. Null or blank texts have no words and fail few_words; repeated rows give
    repeated rows, null keys stay, an empty table gives no rows. Texts are whole however long; other
    columns are not read.
    """
    failed = reduce(lambda a, b: a.bitwiseOR(b), (F.when(rule(), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())))
    return measure(df, key, text).select(key, failed.cast("bigint").alias("failed"), *MEASURES)


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with kept: no rule of the policy fails."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(bits(policy))) == 0)


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_alone) for each rule of a policy: documents that fail it, and those that
    would be kept if it were dropped.

    Documents are first counted by their masked bits (at most 2^rules groups), so the shuffle does
    not grow with the input. An empty ledger gives zero counts.
    """
    names, mask = list(RULES), bits(policy)
    counted = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).count()
    aggs = [f(F.when(c, F.col("count")).otherwise(0)).alias(f"{k}_{x}") for x in POLICIES[policy] for b in [1 << names.index(x)] for k, c, f in (("failed", F.col("bits").bitwiseAND(F.lit(b)) != 0, F.sum), ("alone", F.col("bits") == b, F.sum))]
    rows = F.array(*(F.struct(F.lit(x).alias("rule"), F.coalesce(F.col(f"failed_{x}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"alone_{x}"), F.lit(0)).alias("n_alone")) for x in POLICIES[policy]))
    return counted.agg(*aggs).select(F.inline(rows))
