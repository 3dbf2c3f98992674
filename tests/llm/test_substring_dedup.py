"""Substring dedup against a plain Python pass in rank order."""

import random
import re

import pytest

from lodestone.llm import substring_dedup
from lodestone.llm.common import documents
from lodestone.llm.queries import op10_substring_dedup

ENDS = {"sentence": r"[.!?]+[ \t]+|[.!?]*\n+", "line": r"\n+", "paragraph": r"\n[ \t]*\n+"}


def brute(rows, unit, least):
    """{(key, text): (text left, [(start, stop, first)])}."""
    first, parts = {}, {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        bounds, at = [], 0
        for m in re.finditer(ENDS[unit], text):
            bounds.append((at, at := m.end()))
        if at < len(text):
            bounds.append((at, len(text)))
        marks = []
        for k, (x, y) in enumerate(bounds):
            norm = " ".join(text[x:y].lower().split())
            keeper = first.setdefault(norm, (key, text, k)) if norm else None
            marks.append("blank" if not norm else None if keeper == (key, text, k) else ("gone", keeper[0]))
        left, spans, k = "", [], 0
        while k < len(bounds):
            j = k
            while j < len(bounds) and marks[j] is not None and (marks[j] != "blank" or j > k):
                j += 1
            n = sum(len(text[x:y].split()) for x, y in bounds[k:j])
            for i in range(k, j):
                if n >= least and marks[i] != "blank":
                    spans.append((*bounds[i], marks[i][1]))
                else:
                    left += text[slice(*bounds[i])]
            if j == k:
                left += text[slice(*bounds[k])]
                j += 1
            k = j
        parts[key, text] = left, spans
    return parts


def check(df, unit="sentence", least=8):
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    want = brute(rows, unit, least)
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.removed]) for r in substring_dedup.drop_repeats(df, unit=unit, least=least).collect()), key=str)
    assert got == sorted(((k, *want[k, t]) for k, t in rows), key=str)
    return want


@pytest.mark.parametrize("unit", ["sentence", "line"])
@pytest.mark.parametrize("least", [1, substring_dedup.MIN_WORDS])
def test_documents(spark, sf_dir, unit, least):
    assert any(spans for _, spans in check(documents(spark, sf_dir), unit, least).values())


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    want = brute(rows, "sentence", substring_dedup.MIN_WORDS)
    got = {r.doc_id: (r.text, r.n_removed, [tuple(x) for x in r.removed]) for r in op10_substring_dedup(spark, sf_dir).collect()}
    assert got == {k: (want[k, t][0], len(want[k, t][1]), want[k, t][1]) for k, t in rows}


def test_passage_inside_lines(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage = ". ".join(prose(10) for _ in range(6)) + "."
    rows = [(k, f"{prose(9)} {passage} {prose(7)}. {prose(30)}\n{prose(5)}") for k in range(6)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hash int")
    want = check(df)
    for k, t in rows[1:]:
        assert sum(y - x for x, y, _ in want[k, t][1]) > 0.6 * len(passage)
        assert {f for *_, f in want[k, t][1]} == {0}
    assert want[rows[0]] == (rows[0][1], [])


def test_edge_rows(spark):
    line = "this is one line of exactly nine words here."
    rows = [(3, None), (None, line), (None, line), (4, ""), (5, " \n\n"), (2, f"{line}\n{line.upper()}\nOf. Is."), (7, "Of. Is. Of.\n"), (7, f"{line}\n\n{line}"), (9, "long " * 40000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty_table_and_unknown_unit(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.drop_repeats(df).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.drop_repeats(df, unit="word")
