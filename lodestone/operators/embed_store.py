"""Embeddings that are kept by content: a text is embedded once, in whatever row and run it comes.

The store is a table by SHA-256 of the text, in parts that a versioned manifest names. Adding texts takes the
distinct ones that no part has, embeds these alone and publishes them as a new part; rows then get
their embeddings by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import manifest

SCHEMA = "digest string, embedding array<double>"


class EmbeddingStore:
    """The store below a folder that all executors share, of one embedding function (see plans.retrieval)."""

    def __init__(self, spark: SparkSession, folder: str, embedding: Callable[[Column], Column]):
        self.spark, self.folder, self.embedding = spark, folder, embedding

    def _parts(self) -> tuple[int, dict]:
        version, body = manifest.read(self.spark, self.folder)
        return version, body or {"parts": {}, "retired": []}

    def _rows(self, parts: dict) -> DataFrame:
        paths = [f"{self.folder}/part-{x}" for x in sorted(parts)]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def __len__(self) -> int:
        """Texts that are stored, by the manifest alone."""
        return sum(self._parts()[1]["parts"].values())

    def add(self, rows: DataFrame, text: str = "text") -> int:
        """Embed the texts of a column that are not stored yet; how many these were. A null text is an empty one.

        A run that fails publishes nothing, and the next one starts where the manifest stands.
        """
        version, body = self._parts()
        content = F.coalesce(F.col(text), F.lit(""))
        distinct = rows.select(F.sha2(content, 256).alias("digest"), content.alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
        unseen = distinct.join(self._rows(body["parts"]).select("digest"), "digest", "left_anti")
        name = uuid.uuid4().hex
        unseen.select("digest", self.embedding(F.col("content")).alias("embedding")).write.parquet(f"{self.folder}/part-{name}")
        n = self._rows([name]).count()
        if n:
            body["parts"][name] = n
            manifest.publish(self.spark, self.folder, version, body)
        else:
            manifest.delete(self.spark, f"{self.folder}/part-{name}")
        return n

    def joined(self, rows: DataFrame, text: str = "text", name: str = "embedding") -> DataFrame:
        """rows with the embeddings of a column's texts; null where a text is not stored. A column of that name is replaced."""
        digest = f"_digest_{uuid.uuid4().hex[:8]}"
        stored = self._rows(self._parts()[1]["parts"]).withColumnsRenamed({"digest": digest, "embedding": name})
        keyed = rows.drop(name).withColumn(digest, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        return keyed.join(stored, digest, "left").drop(digest)

    def compact(self) -> None:
        """Make one part of all; vacuum() deletes the old ones."""
        version, body = self._parts()
        name = uuid.uuid4().hex
        self._rows(body["parts"]).write.parquet(f"{self.folder}/part-{name}")
        manifest.publish(self.spark, self.folder, version, {"parts": {name: sum(body["parts"].values())}, "retired": [*body["retired"], *body["parts"]]})

    def vacuum(self) -> None:
        for x in self._parts()[1]["retired"]:
            manifest.delete(self.spark, f"{self.folder}/part-{x}")
