"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, fingerprint, hmm, line_dedup, mixing, oracles, pieces, quality, sharding, simhash, substring_dedup, time_partitions, token_counts, toxicity
from lodestone.llm.common import documents, held_out
from lodestone.sources.shared import shared_folder

PIECES = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
SHARDS = 8


def hex256(value):
    return F.sha2(value, 256)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text."""
    coded = pieces.round_trip(documents(spark, sf_dir), public_tokenizers.path(PIECES))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        hex256("decoded").alias("decoded_sha256"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the lowest id of its component of near-duplicates."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by prefix dynamic programming, and how much of it 4096 tokens hold."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    keyed = docs.select(F.struct("doc_id", "n_bytes").alias("row"), "text")
    counted = token_counts.token_counts(keyed, public_tokenizers.path(PIECES), TOKEN_LIMIT, key="row")
    return counted.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fitting_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by a model that has seen the labels of three folds in four."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"), 4)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled fingerprints of every text and of its edited text, and their likeness."""
    pairs = fingerprint.edited(documents(spark, sf_dir))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        hex256("edited").alias("edited_sha256"),
        fingerprint.printed(a).alias("fingerprint"),
        fingerprint.printed(b).alias("edited_fingerprint"),
        F.coalesce(fingerprint.containment(a, b), fingerprint.resemblance(a, b)).alias("near_edited"),
        F.coalesce(fingerprint.containment(a, c), fingerprint.resemblance(a, c)).alias("near_next"),
        fingerprint.resemblance(a, b).alias("resemblance_edited"),
        fingerprint.resemblance(a, c).alias("resemblance_next"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every whole text and the verdict of the newest policy."""
    judged = quality.apply_policy(quality.ledger(documents(spark, sf_dir)), "v2")
    base = F.col("failed").bitwiseAND(F.lit(quality.bits("v1"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "n_lines", "n_exclaims", "n_capitals")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when sources are mixed to target weights."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole text by a hidden Markov model of six folds in seven."""
    return hmm.language_scores(documents(spark, sf_dir), held_out(F.col("doc_id"), 7))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of recurring templates."""
    return line_dedup.drop_recurring(documents(spark, sf_dir)).select("doc_id", "text", F.size("_dropped").cast("long").alias("n_dropped"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that an earlier one has, and where they were."""
    left = substring_dedup.drop_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), "removed")


def click_moment(ts, click_id):
    """When a click counts as made: some are years back, some at the start of their week; without an id, as it says."""
    k = F.crc32(F.encode(click_id.cast("string"), "UTF-8")) % 128
    days = ((k + 6) * (k + 6) * (k + 6)).cast("int")
    week = F.trunc(ts.cast("date"), "week").cast("timestamp_ntz")
    return F.when(k < 16, ts - F.make_dt_interval(days)).when(k > 111, week).otherwise(ts)


def op11_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of before March in files by stretches of time, then the folder rewritten for all clicks."""
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    early = F.col("arrived_at") < F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    moment = click_moment(F.col("ts"), F.col("click_id"))
    return time_partitions.grow_layout(clicks, early, moment, ["arrived_at", "click_id"], shared_folder(spark, "time-partitions"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters do in every one of their 120 orders, by source."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.orders(filter_audit.cells(documents(spark, sf_dir), labels))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose counts are at most one apart, uniformly shuffled."""
    text = F.col("text")
    rows = documents(spark, sf_dir).select("doc_id", sharding.text_size(text).alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"))
    dealt = sharding.shuffled(rows, SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_fingerprints, op4_quality_rules, op5_mixing, op6_simhash, op7_token_counts, op8_lm_scoring, op9_line_dedup, op10_substring_dedup, op11_time_partitions, op12_filter_audit, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLE)
