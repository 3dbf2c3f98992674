"""Streams: documents to chunks as files arrive, and token streams as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lodestone.operators import chunking
from lodestone.operators.segments import Bm25Index
from lodestone.sources import files
from lodestone.sources.shared import shared_folder


def ingest_chunks(spark: SparkSession, source: str, schema, target: str, checkpoint: str, size: int = 512, overlap: int = 64) -> None:
    """Chunk all documents that have arrived at source (Parquet files) and append them to target.

    Each micro-batch writes its own folder, overwriting it if it is run again, so a restart after a
    lost batch neither loses nor doubles chunks.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunking.fixed(batch.select("doc_id", "text"), size, overlap).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, source: str) -> DataFrame:
    """The chunks of a whole table, by way of the stream."""
    folder = shared_folder(spark, "ingest")
    # As a pattern, a path may be one file or a folder of files.
    ingest_chunks(spark, f"{source[:-1]}[{source[-1]}]", spark.read.parquet(source).schema, f"{folder}/chunks", f"{folder}/progress")
    return spark.read.parquet(f"{folder}/chunks").drop("batch")


#: Fixed by Spark: what a stream of files has.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest_files(spark: SparkSession, source: str, target: str, checkpoint: str, size: int = 512, overlap: int = 64, mode: str = "reference") -> dict[str, int]:
    """Parse and chunk all files that have arrived below source; chunks and rejected files are two tables below target.

    A micro-batch reads its files once and writes a folder of either table, overwriting it if it runs again: a restart
    neither loses nor doubles anything. Returns the files, documents and rejected files of this call. Chunks carry their
    document's metadata.
    """
    counts = {"files": 0, "documents": 0, "rejected": 0}

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        found = batch.select("path", "content").observe(seen, F.count("*").alias("files")).persist()
        docs = files.parse(found).select(F.col("id").alias("doc_id"), F.col("content").alias("text"), "metadata")
        bad = files.rejected(found)
        bad.write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
        chunks = chunking.recursive(docs, size, overlap, mode).join(docs.select("doc_id", "metadata"), "doc_id")
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={number}")
        n, out = seen.get["files"], spark.read.parquet(f"{target}/rejected/batch={number}").count()
        for k, v in (("files", n), ("documents", n - out), ("rejected", out)):
            counts[k] += v
        found.unpersist()

    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts


def ingest_index(spark: SparkSession, source: str, schema, index: Bm25Index, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Add all documents (doc_id, text) that have arrived at source (Parquet files) to the index, a segment for each micro-batch.

    A segment is named by its batch, and an index takes no name twice, so a batch that runs again after a
    failure changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        index.add(batch.select("doc_id", "text"), f"batch-{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def indexed(spark: SparkSession, source: str, batches: int = 3) -> Bm25Index:
    """An index of a whole table, by way of the stream, in so many micro-batches if the table has as many files."""
    folder = shared_folder(spark, "index-stream")
    table = spark.read.parquet(source)
    index = Bm25Index(spark, f"{folder}/index")
    per_batch = max(1, -(-len(table.inputFiles()) // batches))
    ingest_index(spark, f"{source[:-1]}[{source[-1]}]", table.schema, index, f"{folder}/progress", per_batch)
    return index


@udtf(returnType="i: bigint, token: string")
class StreamTokens:
    """One row per character of a reply, as a model double streams it."""

    def eval(self, reply: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(reply or "")
