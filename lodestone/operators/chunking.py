"""Chunkers: documents (doc_id, text) to rows of (doc_id, ordinal, start_char, content, chunk_id)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Separators that close a unit, longest first where one begins another.
SEPARATORS = ("\n\n", "\n", "。", ". ", " ")


def unit_pattern(separators: tuple[str, ...] = SEPARATORS) -> str:
    """One character with all separators that follow it."""
    return f"(?s).(?:{'|'.join(re.escape(s).replace(chr(92) + chr(10), chr(10)).replace(chr(92) + ' ', ' ') for s in separators)})*"


def fixed(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of size characters that start every size - overlap characters; an empty text has none."""
    if size - overlap <= 0:
        raise ValueError("overlap must be less than size")
    text = docs.where(F.length("text") > 0)
    at = F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))).alias("start_char")
    rows = text.select("doc_id", "text", at)
    return rows.select("doc_id", (F.col("start_char") / (size - overlap)).cast("long").alias("ordinal"), F.col("start_char").cast("long"), F.substring(F.col("text"), F.col("start_char") + 1, F.lit(size)).alias("content"), F.concat_ws("#", "doc_id", "start_char").alias("chunk_id"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, n_units long, n_chars long): the recursive splitter's units and what they cover."""
    found = F.regexp_extract_all(F.col("text"), F.lit(unit_pattern()), F.lit(0))
    return docs.select("doc_id", F.size(found).cast("long").alias("n_units"), F.coalesce(F.length(F.array_join(found, "")), F.lit(0)).cast("long").alias("n_chars"))


def spans(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks that a greedy merge of units with these lengths gives.

    A unit that does not fit closes the chunk; the next one starts with the closed chunk's last
    overlap characters if it is longer than that.
    """
    out, start, at = [], 0, 0
    for n in lengths:
        if at > start and at - start + n > size:
            out.append((start, at))
            start = at - overlap if at - start > overlap else at
        at += n
    if at > start:
        out.append((start, at))
    return out


def _semantic(text: str, size: int, separators: tuple[str, ...]) -> list[int]:
    """Lengths of units that are split no further once they fit in size."""
    if len(text) <= size or not separators:
        return [len(text)] if len(text) <= size else [size] * (len(text) // size) + [len(text) % size] * bool(len(text) % size)
    parts = [p for p in re.split(f"(?<={re.escape(separators[0])})", text) if p]
    return [n for p in parts for n in ([len(p)] if len(p) <= size else _semantic(p, size, separators[1:]))]


def recursive(docs: DataFrame, size: int = 512, overlap: int = 64, mode: str = "reference") -> DataFrame:
    """Greedily merged units. mode "reference" merges single characters with their separators; "semantic"
    keeps paragraphs, lines and sentences whole that fit. Chunks are contiguous slices of the text."""
    if mode not in ("reference", "semantic"):
        raise ValueError("mode is reference or semantic")
    if size <= 0 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    find = re.compile(unit_pattern()).finditer

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                lengths = [m.end() - m.start() for m in find(text)] if mode == "reference" else _semantic(text, size, SEPARATORS)
                rows += [(key, k, x, text[x:y], f"{key}#{k}") for k, (x, y) in enumerate(spans(lengths, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start_char", "content", "chunk_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(fold, f"doc_id {kind}, ordinal long, start_char long, content string, chunk_id string")


def with_counts(chunks: DataFrame) -> DataFrame:
    """Chunks with chunk_count long of their document."""
    return chunks.withColumn("chunk_count", F.count("*").over(Window.partitionBy("doc_id")))


def listed(chunks: DataFrame, name: str, position: str) -> DataFrame:
    """(file_name, n_chunks long) by first position; a missing name is "?"."""
    by = chunks.groupBy(F.coalesce(F.col(name), F.lit("?")).alias("file_name")).agg(F.count("*").alias("n_chunks"), F.min(position).alias("first_seen"))
    return by.orderBy("first_seen", "file_name")
