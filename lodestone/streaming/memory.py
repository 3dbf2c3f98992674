"""Working memories that live in a stream: what each conversation remembers, kept as keyed state.

Events (conv_id, seq, op, key, value) of set, pop and clear may come in any order and any split into
micro-batches: of each key the event with the highest seq counts, and of clears the latest. A memory that
has changed is written whole with its batch, so the latest batch of each conversation is a snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory(StatefulProcessor):
    """Entries by key with the seq that wrote them; a popped key stays as an entry without value, so that earlier events can't revive it.

    With idle_ms, a conversation without events for so long (processing time) is forgotten.
    """

    def __init__(self, value: str, idle_ms: int | None):
        self.value, self.idle_ms = value, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", f"seq bigint, held boolean, value {self.value}")
        self.cleared = handle.getValueState("cleared", "seq bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        was = self.cleared.get()[0] if self.cleared.exists() else None
        known = {k[0]: (v[0], v[1], v[2]) for k, v in self.entries.iterator()}
        cleared, new = was, {}
        for b in rows:
            for seq, op, k, v in zip(b["seq"], b["op"], b["key"], b["value"], strict=True):
                if op == "clear":
                    cleared = int(seq) if cleared is None else max(cleared, int(seq))
                elif op in ("set", "pop") and (k not in known or known[k][0] <= seq):
                    known[k] = new[k] = (int(seq), op == "set", None if op == "pop" or pd.isna(v) else v)
        for k, v in new.items():
            self.entries.updateValue((k,), v)
        if cleared != was:
            self.cleared.update((cleared,))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        held = [(k, v[2]) for k, v in known.items() if v[1] and (cleared is None or v[0] > cleared)]
        yield self._shown(key, held)

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        self.cleared.clear()
        yield self._shown(key, [])

    def close(self) -> None:
        pass

    def _shown(self, key: tuple, held: list[tuple]) -> pd.DataFrame:
        """The memory's entries, or one row without key where it is empty."""
        held = held or [(None, None)]
        return pd.DataFrame({"conv_id": [key[0]] * len(held), "key": [k for k, _ in held], "value": pd.Series([v for _, v in held], dtype=object)})


def remember(events: DataFrame, target: str, checkpoint: str, idle_ms: int | None = None, available_now: bool = True):
    """Keep the memories of a stream of events and write them below target, a folder for each micro-batch, overwritten if it runs again.

    Returns the query; with available_now it has ended. Null conversations are one of their own.
    """
    spark, kind = events.sparkSession, lambda c: events.schema[c].dataType.simpleString()
    out = f"conv_id {kind('conv_id')}, key string, value {kind('value')}"
    mode = "None" if idle_ms is None else "ProcessingTime"
    memories = events.select("conv_id", "seq", "op", "key", "value").groupBy("conv_id").transformWithStateInPandas(Memory(kind("value"), idle_ms), out, "Update", mode)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # what keyed state in Python needs
    try:
        started = memories.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        query = (started.trigger(availableNow=True) if available_now else started).start()
    finally:
        spark.conf.set(PROVIDER, before)
    if available_now:
        query.awaitTermination()
    return query


def snapshot(spark: SparkSession, target: str, conv_id: DataType | str = "bigint", value: DataType | str = "string") -> DataFrame:
    """(conv_id, key, value): every conversation's memory as its latest batch has it; nothing written yet gives no rows."""
    name = lambda t: t if isinstance(t, str) else t.simpleString()
    rows = spark.read.schema(f"conv_id {name(conv_id)}, key string, value {name(value)}, batch long").parquet(target)
    last = rows.groupBy("conv_id").agg(F.max("batch").alias("last")).withColumnRenamed("conv_id", "of")
    return rows.join(last, rows["conv_id"].eqNullSafe(last["of"]) & (F.col("batch") == F.col("last"))).where("key IS NOT NULL").select("conv_id", "key", "value")
