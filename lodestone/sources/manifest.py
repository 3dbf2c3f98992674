"""Versioned manifests: which tables below a folder belong together, published as one file.

A writer puts its tables where no manifest names them and then publishes the next version; a reader
takes the highest version and sees either all of a change or nothing of it. One writer at a time.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

FORMAT = 1


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, folder: str) -> list[int]:
    """All published versions, ascending; a folder that does not exist has none."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(path(folder)))
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))


def read(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, dict]:
    """A version and its body, the latest one by default; (0, {}) if there is none yet.

    A version that is not there, or that a later format wrote, raises.
    """
    known = versions(spark, folder)
    if version is None and not known:
        return 0, {}
    number = known[-1] if version is None else version
    if number not in known:
        raise FileNotFoundError(f"{folder}: no manifest of version {number}")
    raw = spark.sparkContext.wholeTextFiles(f"{folder}/manifest-{number:08d}.json").values().collect()[0]
    body = json.loads(raw)
    if body.pop("format") > FORMAT:
        raise ValueError(f"{folder}: written by a later version of this library")
    return number, body


def publish(spark: SparkSession, folder: str, after: int, body: dict) -> int:
    """Make body version after + 1; raises if another writer has published it meanwhile."""
    fs, path = _fs(spark, folder)
    final, draft = path(f"{folder}/manifest-{after + 1:08d}.json"), path(f"{folder}/_draft-{after + 1:08d}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(body | {"format": FORMAT}, sort_keys=True), "utf-8"))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{folder}: version {after + 1} is there already")
    return after + 1


def exists(spark: SparkSession, path: str) -> bool:
    fs, of = _fs(spark, path)
    return fs.exists(of(path))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table or folder; nothing happens if it is not there."""
    fs, of = _fs(spark, path)
    fs.delete(of(path), True)
