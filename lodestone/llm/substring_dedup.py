"""Substring dedup by hashing units of text.

A text is cut into units (sentences within lines by default, since shared passages start and end
inside lines; whole lines or paragraphs on request). Units are normalised (case, white space) and
hashed to 128 bits; digests are grouped over all documents, the earliest ranked occurrence is
kept, and others are removed, with their offsets in the original text. Chance repeats of short
units are told from repeated text by runs: neighbouring repeated units go together, and only if
they have enough words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, texts

#: What ends a unit; it belongs to the unit before it.
UNITS = {
    "sentence": re.compile(r"[.!?]+[ \t]+|[.!?]*\n+"),
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n[ \t]*\n+"),
}
#: A run of repeated units with fewer words stays: it is a boilerplate line or two, or chance, and no passage.
MIN_WORDS = 25


def cuts(text: str, unit: str) -> list[int]:
    """Ends of the units: they cover the text without gaps."""
    ends = [m.end() for m in UNITS[unit].finditer(text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return ends


def _units(df: DataFrame, key: str, text: str, unit: str) -> DataFrame:
    """(key, hash, ordinal, hi, lo): digests of all units with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for b in slices(batches, "text"):
            row, ordinal, digests, whole = [], [], [], []
            for i, t in enumerate(texts(b)):
                whole.append(xxh3_64_intdigest(t.encode()) - 2**63)
                start = 0
                for k, end in enumerate(cuts(t, unit)):
                    if words := t[start:end].lower().split():
                        row.append(i)
                        ordinal.append(k)
                        digests.append(xxh3_128_digest(" ".join(words).encode()))
                    start = end
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(whole, pa.int64()).take(at), pa.array(ordinal, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["key", "hash", "ordinal", "hi", "lo"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, hash long, ordinal int, hi long, lo long")


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "sentence", least: int = MIN_WORDS) -> DataFrame:
    """(key, text, removed array<struct<start, stop, first>>) per input row.

    text is what is left; removed has the code-point offsets of each removed unit in the original
    text, and the key of the document that keeps it. Occurrences are ranked by key (null keys
    last), then by place; a unit also repeats within one document. Rows are told apart by key and
    text, so repeated rows are one document and keep the same. Null texts count as empty. Units
    meet by 128-bit digests. Hot units are counted by partial aggregation, and the join on digests
    has one row per digest on one side, so that its other side may be split. Texts are whole however
    long, one at a time; an empty table gives no rows; other columns are not looked at.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    units = _units(df, key, text, unit)
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "hash", "ordinal")
    firsts = units.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # The join is dealt by other values than the counts, so that both of its sides are plain shuffles
    # and adaptive execution may split what a hot digest brings to one task.
    firsts = firsts.select(F.bitwise_not("hi").alias("not_hi"), F.bitwise_not("lo").alias("not_lo"), "first")
    repeats = units.join(firsts, (F.bitwise_not("hi") == F.col("not_hi")) & (F.bitwise_not("lo") == F.col("not_lo"))).where(rank != F.col("first"))
    gone = repeats.groupBy("key", "hash").agg(F.sort_array(F.collect_set(F.struct("ordinal", F.col("first.key").alias("first")))).alias("gone"))
    kind = df.schema[key].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            whole = [xxh3_64_intdigest(t.encode()) - 2**63 for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts(b)), pa.array(whole, pa.int64())], ["key", "text", "hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            left, spans = [], []
            for t, repeated in zip(texts(b), b.column(2).to_pylist(), strict=True):
                if not repeated:
                    left.append(t)
                    spans.append([])
                    continue
                ends = cuts(t, unit)
                first = {r["ordinal"]: r["first"] for r in repeated}
                bounds = list(zip([0, *ends], ends, strict=False))
                kept, mine, run, n = [], [], [], 0
                for k, (x, y) in enumerate([*bounds, (len(t), len(t))]):
                    blank = x < y and not t[x:y].strip()
                    if k in first or (blank and run):
                        run.append((x, y, k))
                        n += len(t[x:y].split())
                        continue
                    for a, z, j in run:
                        if n >= least and j in first:
                            mine.append({"start": a, "stop": z, "first": first[j]})
                        else:
                            kept.append(t[a:z])
                    run, n = [], 0
                    kept.append(t[x:y])
                left.append("".join(kept))
                spans.append(mine)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("first", b.schema.field(0).type)])))], ["key", "text", "removed"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(digest, f"key {kind}, text string, hash long")
    joined = rows.join(gone.select(F.col("key").alias("k"), F.col("hash").alias("h"), "gone"), F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left")
    return joined.select("key", "text", "gone").mapInArrow(cut, f"key {kind}, text string, removed array<struct<start:int,stop:int,first:{kind}>>").withColumnRenamed("key", key)
