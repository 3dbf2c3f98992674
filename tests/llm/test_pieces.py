"""Encoding, decoding and prefix counts against the library itself."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lodestone.llm import pieces, token_counts
from lodestone.llm.common import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "th", "er", "ing", " ", "  ", "   ", " " * 17, "\n", "\n\n", "é", "ß", "你好", "€", "😀", "▁", "\t", "<s>", "</s>", "<unk>", "<0x41>", "0x", "the ", "of ", "ations", "　", "ﬁ", "\x00", "\x01"]
EDGES = [None, "", " ", "  a  b ", "\n\n a", "▁a ▁", "x" * 5000, " " * 3000, *(" " * k for k in range(1, 70)), *("a" * k for k in range(1, 40))]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(5)
    return EDGES + ["".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(3000)]


def test_round_trip_is_the_library(spark, library, samples):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(samples)], "doc_id long, text string, ids string")
    for r in pieces.round_trip(df, PATH).collect():
        ids = library.encode(samples[r.doc_id] or "")
        assert (r.ids, r.decoded) == (ids, library.decode(ids))


def test_documents(spark, library):
    docs = documents(spark, "/root/testdata/sf0.01")
    want = {r.doc_id: library.encode(r.text) for r in docs.collect()}
    coded = pieces.encode(docs, PATH)
    assert {r.doc_id: r.ids for r in coded.collect()} == want
    assert {r.doc_id: r.text for r in pieces.decode(coded, PATH).collect()} == {k: library.decode(v) for k, v in want.items()}
    counted = {r.doc_id: r for r in token_counts.token_counts(docs, PATH, 100).collect()}
    for r in docs.collect():
        assert counted[r.doc_id].n_tokens == len(want[r.doc_id])
        fit = counted[r.doc_id].fitting_chars
        assert len(library.encode(r.text[:fit])) <= 100
        assert fit == len(r.text) or len(library.encode(r.text[: fit + 1])) > 100


def test_decode_of_any_ids(spark, library):
    rng = random.Random(6)
    rows = [[rng.randrange(3, 32000) for _ in range(rng.randint(0, 12))] for _ in range(300)] + [[], [3 + 0xE2, 3 + 0x82], [3 + 0xFF, 300], [1, 300, 2]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(-1, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in pieces.decode(df, PATH).collect()}
    assert got.pop(-1) == ""
    assert got == {i: library.decode(r) for i, r in enumerate(rows)}


def test_every_prefix_count(spark, library, samples):
    some = [t for t in samples[:400] if len(t or "") < 400]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in token_counts.prefix_counts(df, PATH).collect():
        text = some[r.doc_id] or ""
        assert r.counts == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


def test_repeated_rows_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "ab"), (None, "ab"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.n_tokens, r.fitting_chars) for r in token_counts.token_counts(df, PATH, 0).collect()] == [(None, 1, 0), (None, 1, 0), (1, 0, 0)]
    assert pieces.round_trip(df, PATH).count() == 3
    for f in (pieces.encode, pieces.round_trip, token_counts.prefix_counts):
        assert f(df.where("doc_id = 7"), PATH).collect() == []


def test_words_tables_are_emptied(monkeypatch, library):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 3)
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 3)
    m, c = pieces.PieceModel(PATH), token_counts.PrefixCounter(PATH)
    for text in ("one two three four five", "six one two", "three nine ten"):
        assert m.encode([text])[0].tolist() == library.encode(text)
        assert c.count([text], 2)[0].tolist() == [len(library.encode(text))]


def test_ids_outside_of_the_vocabulary():
    with pytest.raises(ValueError):
        pieces.model(PATH).decode(np.array([32000]), np.array([1]))
