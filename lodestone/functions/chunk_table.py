"""Chunking from SQL: a table function that takes any table with a text, and any chunker by name.

    SELECT * FROM chunk(TABLE(documents), 'recursive', 512, 64)

All other columns of the table come back with every chunk, so metadata is carried along.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lodestone.operators import chunking

#: (text, size, overlap) to (start, end) of each chunk.
Chunker = Callable[[str, int, int], list[tuple[int, int]]]


def _fixed(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    return [(i, min(len(text), i + size)) for i in range(0, len(text), size - overlap)]


def _recursive(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    return chunking.spans([m.end() - m.start() for m in re.finditer(chunking.unit_pattern(), text)], size, overlap)


def _semantic(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    return chunking.spans(chunking._semantic(text, size, chunking.SEPARATORS), size, overlap)


CHUNKERS: dict[str, Chunker] = {"fixed": _fixed, "recursive": _recursive, "semantic": _semantic}
ADDED = ("ordinal", "start_char", "content")


class Chunk:
    """chunk(table, chunker, size, overlap): the table's columns but text, and ordinal, start_char bigint, content string.

    The table needs a column text, of strings; null and empty texts have no chunks. Columns that are named as the
    added ones are refused, as are unknown chunkers and an overlap that is not below the size.
    """

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.kept = [f.name for f in analyzed.schema.fields[: -len(ADDED)]] if analyzed else []

    @staticmethod
    def analyze(table: AnalyzeArgument, chunker: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "text" not in table.dataType.names:
            raise ValueError("chunk() takes a table with a column text")
        if chunker.value not in CHUNKERS:
            raise ValueError(f"no chunker {chunker.value}; there are {', '.join(CHUNKERS)}")
        if size.value is None or overlap.value is None or not 0 <= overlap.value < size.value:
            raise ValueError("size is positive and overlap less than size")
        clash = set(ADDED) & set(table.dataType.names)
        if clash:
            raise ValueError(f"the table has columns {', '.join(sorted(clash))} already")
        schema = StructType([f for f in table.dataType.fields if f.name != "text"])
        for name, kind in zip(ADDED, (LongType(), LongType(), StringType()), strict=True):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, row: Row, chunker: str, size: int, overlap: int) -> Iterator[tuple]:
        text, kept = row["text"] or "", [row[c] for c in self.kept]
        for i, (start, end) in enumerate(CHUNKERS[chunker](text, size, overlap)):
            yield *kept, i, start, text[start:end]


def register(spark: SparkSession) -> None:
    """Make chunk() known to the session's SQL."""
    spark.udtf.register("chunk", udtf(Chunk))


def chunked(docs: DataFrame, chunker: str = "fixed", size: int = 512, overlap: int = 64) -> DataFrame:
    """chunk() of a DataFrame."""
    register(docs.sparkSession)
    return docs.sparkSession.sql("SELECT * FROM chunk(TABLE(SELECT * FROM {docs}), :chunker, :size, :overlap)", args={"chunker": chunker, "size": size, "overlap": overlap}, docs=docs)
