"""The rule ledger against a plain Python count."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.llm.common import documents

TEXTS = [None, "", " \t\n", "a b c a b c", "x " * 60, "one two three\none two three\n\nfour", "A!! B!! " * 40, "é ﬁ \x0b z\x1f", "the cat sat on the mat and the cat sat on the hat " * 3, "long " * 20000]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def same(df):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.measure(df).collect()}
    want = {r.doc_id: brute(r.text) for r in df.select("doc_id", "text").collect()}
    assert got == want


def test_edge_texts(spark):
    same(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"))


def test_all_documents(spark, sf_dir):
    same(documents(spark, sf_dir))


def test_extra_columns_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b", 1, 9), (None, "a b", 1, 9)], "doc_id long, text string, n_words int, failed int")
    rows = quality.ledger(df).collect()
    assert [(r.doc_id, r.n_words, r.failed & 1) for r in rows] == [(None, 2, 1)] * 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.apply_policy(quality.ledger(df), "v2").count() == 0
    assert {(r.n_failed, r.n_alone) for r in quality.ablation(quality.ledger(df), "v2").collect()} == {(0, 0)}


def test_ablation_is_what_dropping_a_rule_does(spark, sf_dir):
    book = quality.ledger(documents(spark, sf_dir)).cache()
    rows = {r.rule: r for r in quality.ablation(book, "v2").collect()}
    mask, names = quality.bits("v2"), list(quality.RULES)
    for rule, r in rows.items():
        bit = 1 << names.index(rule)
        assert r.n_failed == book.where(F.col("failed").bitwiseAND(F.lit(bit)) != 0).count()
        assert r.n_alone == book.where(F.col("failed").bitwiseAND(F.lit(mask)) == bit).count()


def test_verdict_follows_the_labels(spark):
    """Documents of good quality that pass the base rules stay; poor ones go (sf0.01)."""
    sf = "/root/testdata/sf0.01"
    kept = quality.apply_policy(quality.ledger(documents(spark, sf)), "v2")
    rows = kept.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.failed & quality.bits("v1") == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_unknown_policy(spark):
    with pytest.raises(KeyError):
        quality.bits("v9")
