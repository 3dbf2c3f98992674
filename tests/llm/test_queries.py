"""The thin queries: digests, limits and columns against the library and plain Python."""

import hashlib
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lodestone.llm import queries, token_counts, toxicity
from lodestone.llm.common import documents
from tests.llm.test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in documents(spark, "/root/testdata/sf0.001").collect()}


def test_pieces_and_counts(spark, sf_dir, texts, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op1_sentencepiece(spark, sf_dir).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    monkeypatch.setattr(queries, "TOKEN_LIMIT", 500)
    rows = queries.op7_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts) and {r.over_limit for r in rows} == {True, False}
    for r in rows:
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 500)


def test_simhash(spark, sf_dir, texts):
    order = sorted(texts)
    prints = [brute_print(texts[k]) for k in order]
    want = {k: (f"{p:016x}", order[c]) for k, p, c in zip(order, prints, brute_components(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash(spark, sf_dir).collect()} == want


def test_toxicity_and_language_columns(spark, sf_dir, texts):
    out = lambda i, k: zlib.crc32(str(i).encode()) % k == 2
    rows = queries.op2_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= toxicity.THRESHOLD) and r.held_out == out(r.doc_id, 4)
    scored = queries.op8_lm_scoring(spark, sf_dir)
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(scored.columns)
    assert all(r.held_out == out(r.doc_id, 7) and r.n_tokens == 1 + len(texts[r.doc_id].encode().lower().split()) for r in scored.collect())


def test_labels_of_the_held_out_fold_are_not_used(spark, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    flipped.write.parquet(str(tmp_path / "labels.parquet"))
    documents(spark, sf_dir).write.parquet(str(tmp_path / "documents.parquet"))
    a, b = (sorted(map(tuple, queries.op2_toxicity(spark, d).collect())) for d in (sf_dir, str(tmp_path)))
    assert a == b


def test_worker_tables_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_PAIRS", 300)
    counter = token_counts.PrefixCounter(public_tokenizers.path(queries.PIECES))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECES))
    most = 0
    for k in range(40):
        batch = [f"{'x' * (5000 if k == 7 else 5)}{k} word{k * 37} über{k} {chr(97 + k % 26) * k}"]
        assert counter.count(batch, 10**6)[0].tolist() == [len(sp.encode(batch[0]))]
        most = max(most, len(counter.pairs))
        assert k != 8 or len(counter.flat) < 1000
    assert most < 2000
