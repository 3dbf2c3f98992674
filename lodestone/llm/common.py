"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of every word contract here.
SPACES = " \t\n\x0b\f\r"
#: The fraction crc32(doc_id) mod k uses this remainder for held-out rows.
HELD_OUT = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table below sf_dir, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the ASCII-white-space separated words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def held_out(doc_id: Column, k: int) -> Column:
    """True where crc32 of the id as text leaves remainder 2 modulo k; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % k == HELD_OUT


def bound(value: Column, body) -> Column:
    """body(value) with value computed once per row.

    A lambda variable holds the value, so that an optimiser that merges projections cannot
    copy a costly expression into the inner loop of a higher-order function.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def packed(df: DataFrame) -> DataFrame:
    """df as one struct column row, so that no name of its columns can clash with an operator's."""
    return df.select(F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"))


def unpacked(columns: list[str], new: dict[str, Column] | None = None) -> list[Column]:
    """The columns of a packed row again; those in new are replaced, or added at the end."""
    new = dict(new or {})
    same = [F.col("row").getField(c) if c not in new else new.pop(c) for c in columns]
    return [*(x.alias(c) for x, c in zip(same, columns, strict=True)), *(x.alias(c) for c, x in new.items())]


def lowest(df: DataFrame, by: Column, most: int) -> DataFrame:
    """The rows of df with the lowest values of a 64-bit hash: all of them, or a share of the range of
    hashes that holds somewhat less than most of them. Neither sorts nor gathers rows."""
    n = df.count()
    if n <= most:
        return df
    share = max(0.0, most - 6 * most**0.5) / n  # six deviations of the number that the share holds
    return df.where(by < F.lit(-(2**63) + int(share * 2**64)))


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the session's folder if it names one, else a local one for tests.

    On a cluster spark.checkpoint.dir must name a shared folder; a machine-local folder is only
    ever chosen for a local master.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df written as Parquet in the shared folder and read again, and what deletes it: for wide rows
    that are read more than once, a few columns at a time, and are done with before the result is."""
    spark, path = df.sparkSession, f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def delete() -> None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), delete


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the column's text is about limit bytes in each (single rows may be longer).

    Python objects per word then stay bounded, however many rows Arrow puts in one batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        yield batch.slice(start)


def give_back() -> None:
    """Hand freed memory of this process back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, handing back at a partition's end what it freed.

    Workers go on to other stages, and would hold the most that any of their stages took.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
