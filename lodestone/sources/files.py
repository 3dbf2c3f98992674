"""Files to documents: recursive scan, parsers by suffix, and index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes by format.
MARKDOWN = (".md", ".markdown")
TEXT = (".txt", ".text", ".log", ".csv", ".json", ".xml")
#: What a directory scan takes.
SCANNED = (".md", ".markdown", ".txt")
#: The line ends that end a title.
LINE_END = r"\n\x0b\x0c\x1c\x1d\x1e\x85  "


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _stem(path: Column) -> Column:
    return F.regexp_replace(_file_name(path), r"(?<=.)\.[^.]*$", "")


def _markdown(path: Column, text: Column) -> Column:
    """The first line that starts with "# ", else the file's stem."""
    line = rf"(?:^|[{LINE_END}])# ([^{LINE_END}]*)"
    return F.when(text.rlike(line), F.regexp_replace(F.regexp_extract(text, line, 1), r"^\s+|\s+$", "")).otherwise(_stem(path))


def _plain(path: Column, text: Column) -> Column:
    return _stem(path)


Title = Callable[[Column, Column], Column]
_PARSERS: list[tuple[tuple[str, ...], str, Title]] = [(MARKDOWN, "markdown", _markdown), (TEXT, "text", _plain)]


def register_parser(suffixes: tuple[str, ...], kind: str, title: Title) -> None:
    """Put a parser before those there are; the first that takes a suffix parses it."""
    _PARSERS.insert(0, (tuple(s.lower() for s in suffixes), kind, title))


def get_parser(path: str) -> str:
    """The format that parses a path; ValueError if none does."""
    for suffixes, kind, _ in _PARSERS:
        if path.lower().endswith(suffixes):
            return kind
    raise ValueError(f"no parser for {path}")


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SCANNED) -> DataFrame:
    """(path, content binary) of all files below a folder with one of the suffixes, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").where(_suffix(F.col("path")).isin(*suffixes))


def parse(files: DataFrame) -> DataFrame:
    """(id, content, metadata struct<file_path, file_name, title, format, size_bytes>) of (path, content binary).

    Line ends become \\n; size_bytes is that of the file. Files that no parser takes, or that are no
    UTF-8, are left to rejected().
    """
    rows = files.where(_kind().isNotNull() & _text().isNotNull()).select("path", _kind().alias("format"), F.regexp_replace(_text(), "\r\n?", "\n").alias("text"), F.octet_length("content").cast("long").alias("size_bytes"))
    title = F.lit(None).cast("string")
    for suffixes, _, f in reversed(_PARSERS):
        title = F.when(_suffix(F.col("path")).isin(*suffixes), f(F.col("path"), F.col("text"))).otherwise(title)
    meta = F.struct(F.col("path").alias("file_path"), _file_name(F.col("path")).alias("file_name"), title.alias("title"), "format", "size_bytes")
    return rows.select(F.col("path").alias("id"), F.col("text").alias("content"), meta.alias("metadata"))


def rejected(files: DataFrame) -> DataFrame:
    """(path, reason) of the files that parse() leaves out."""
    reason = F.when(_kind().isNull(), "unsupported format").when(_text().isNull(), "not UTF-8")
    return files.select("path", reason.alias("reason")).where("reason is not null")


def _kind() -> Column:
    kind = F.lit(None).cast("string")
    for suffixes, name, _ in reversed(_PARSERS):
        kind = F.when(_suffix(F.col("path")).isin(*suffixes), name).otherwise(kind)
    return kind


def _text() -> Column:
    return F.try_validate_utf8(F.col("content").cast("string"))


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors as one Parquet table."""
    chunks.write.mode("overwrite").parquet(path)


#: The metadata of a chunk table that has none.
METADATA = "struct<file_path: string, file_name: string, title: string, format: string, size_bytes: bigint>"


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """What save_chunks() wrote. Tables from before there was metadata get a null one, of the usual fields; a table
    without ids or contents raises ValueError."""
    rows = spark.read.parquet(path)
    missing = [x for x in (("chunk_id", "doc_id"), ("content",)) if not set(x) & set(rows.columns)]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(x[0] for x in missing)}")
    return rows if "metadata" in rows.columns else rows.withColumn("metadata", F.lit(None).cast(METADATA))


def backend(path: str, chosen: str = "auto") -> str:
    """numpy or ivfpq; auto goes by the suffix .ivfpq."""
    if chosen not in ("auto", "numpy", "ivfpq"):
        raise ValueError("backend is auto, numpy or ivfpq")
    return chosen if chosen != "auto" else "ivfpq" if path.endswith(".ivfpq") else "numpy"
