"""Conversations (conv_id, turn, role, text), caches replayed over traces, and model outputs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How roles are labelled in a history; other roles are left out.
LABELS = {"user": "用户: ", "assistant": "助手: "}


def last_messages(messages: DataFrame, n: int, max_turns: int = 20) -> DataFrame:
    """The last n messages of each conversation; n <= 0 means twice max_turns."""
    take = n if n > 0 else 2 * max_turns
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(order)).where(F.col("_back") <= take).drop("_back")


def history_text(messages: DataFrame, n: int = 10) -> DataFrame:
    """(conv_id, history): the last n messages, labelled; roles without a label count but are not shown."""
    label = F.coalesce(*(F.when(F.col("role") == r, t) for r, t in LABELS.items()))
    lines = last_messages(messages, n).select("conv_id", F.struct("turn", F.concat(label, "text").alias("line")).alias("m"))
    by = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return by.select("conv_id", F.array_join(F.filter(F.col("m.line"), lambda x: x.isNotNull()), "\n").alias("history"))


def working_memory(log: DataFrame) -> DataFrame:
    """(conv_id, key, value): last write wins in a log (conv_id, seq, op, key, value) of set, pop and clear."""
    cleared = log.where("op = 'clear'").groupBy("conv_id").agg(F.max("seq").alias("_cleared"))
    last = log.where("op IN ('set', 'pop')").groupBy("conv_id", "key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("w"))
    rows = last.join(cleared, "conv_id", "left").where((F.col("w.op") == "set") & (F.col("w.seq") > F.coalesce("_cleared", F.lit(-1))))
    return rows.select("conv_id", "key", F.col("w.value").alias("value"))


def rewrite_inputs(messages: DataFrame) -> DataFrame:
    """(conv_id, query, history, cache_key): the last user message, what was said before it, and the key of
    both, in which only the last three messages count."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("at"), F.max_by("text", "turn").alias("query"))
    before = messages.join(last.select("conv_id", "at"), "conv_id").where("turn < at").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    rows = last.join(before, "conv_id", "left").withColumn("m", F.coalesce(F.col("m.text"), F.array().cast("array<string>")))
    recent = F.slice("m", F.greatest(F.lit(1), F.size("m") - 2), F.lit(3))
    return rows.select("conv_id", "query", F.array_join("m", "\n").alias("history"), F.concat_ws("|", "query", F.array_join(recent, "\n")).alias("cache_key"))


def cleaned_rewrite(answer: Column, query: Column) -> Column:
    """The model's answer without white space and quotes around it; nothing left means the query."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    out = bare(F.regexp_replace(bare(answer), "^[\"']+|[\"']+$", ""))
    return F.when(F.length(out) > 0, out).otherwise(query)


class Recall:
    """What the last few keys gave, as a fold: recall(key, make) is (the value, whether it was held).

    "lru" forgets the key that was not used for longest, "fifo" the one that came in first.
    """

    def __init__(self, capacity: int, policy: str = "lru"):
        if policy not in ("lru", "fifo") or capacity <= 0:
            raise ValueError("policy is lru or fifo, capacity is positive")
        self.capacity, self.refresh, self.held = capacity, policy == "lru", {}

    def __contains__(self, key: Hashable) -> bool:
        return key in self.held

    def __call__(self, key: Hashable, make: Callable[[], Any] = lambda: None) -> tuple[Any, bool]:
        hit = key in self.held
        value = self.held[key] if hit else make()
        if hit and self.refresh:
            del self.held[key]
        self.held.setdefault(key, value)  # dicts keep the order of insertion
        if len(self.held) > self.capacity:
            del self.held[next(iter(self.held))]
        return value, hit


def replay(trace: DataFrame, capacity: int, policy: str = "lru") -> DataFrame:
    """trace (session, seq long, key) with hit boolean: whether the session's cache held the key.

    "lru" refreshes a key when it is used; "fifo" evicts what came in first. A session's rows are
    read in order as a stream whose state is the cache itself, so long sessions need no memory.
    """
    Recall(capacity, policy)  # wrong arguments are told at once

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, recall = None, Recall(capacity, policy)
        for b in batches:
            hits = []
            for s, key in zip(b["session"], b["key"], strict=True):
                if s != session:
                    session, recall = s, Recall(capacity, policy)
                hits.append(recall(key)[1])
            yield b.assign(hit=hits)

    kind = trace.schema["session"].dataType.simpleString()
    ordered = trace.select("session", F.col("seq").cast("long"), F.col("key").cast("string")).repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(run, f"session {kind}, seq long, key string, hit boolean")


def hit_rates(replayed: DataFrame) -> DataFrame:
    """(session, hits, misses, hit_rate)."""
    by = replayed.groupBy("session").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return by.withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


#: What marks a call, an answer and a step of thought in a model's output.
CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
ANSWER = r"(?is)Final Answer\s*[:：]\s*(.+)"
THOUGHT = "Thought|Action|Observation"
#: The last line that is no step of thought, in a text without any mark of a call.
LAST_LINE = rf"(?s)\A(?!.*<tool_call>)(?:.*\n)?[^\S\n]*(?!{THOUGHT})(\S[^\n]*)"
#: What an output is: the first pattern whose first group can be read. A call is JSON with a name, an answer any text.
OUTPUTS = (("action", CALL), ("final_answer", ANSWER), ("final_answer", LAST_LINE))


def parse_output(text: Column) -> Column:
    """struct(type, tool_name, arguments, content) of a model's output by OUTPUTS; what none of them reads
    is unknown and its own content."""
    empty = F.lit(None).cast("string")

    def row(kind: str, name: Column = empty, arguments: Column = empty, content: Column = empty) -> Column:
        return F.struct(F.lit(kind).alias("type"), name.alias("tool_name"), arguments.alias("arguments"), content.alias("content"))

    found = row("unknown", content=text)
    for kind, pattern in reversed(OUTPUTS):
        group = F.regexp_extract(text, pattern, 1)
        if kind == "action":
            name = F.get_json_object(group, "$.name")
            found = F.when(name.isNotNull(), row(kind, name, F.coalesce(F.get_json_object(group, "$.arguments"), F.lit("{}")))).otherwise(found)
        else:
            found = F.when(text.rlike(pattern), row(kind, content=F.regexp_replace(group, r"^\s+|\s+$", ""))).otherwise(found)
    return found


def read_output(text: str) -> dict[str, Any]:
    """parse_output for one text on the driver, with the call's arguments as a dict."""

    def read(kind: str, group: str) -> dict[str, Any] | None:
        if kind != "action":
            return {"type": kind, "content": group.strip()}
        try:
            call = json.loads(group)
            return {"type": kind, "tool_name": call["name"], "arguments": call.get("arguments", {})}
        except (ValueError, LookupError, TypeError, AttributeError):
            return None

    tried = (read(kind, m[1]) for kind, pattern in OUTPUTS if (m := re.search(pattern, text)))
    return next(filter(None, tried), {"type": "unknown", "content": text})


def kv_budget(used: Column, total: int = 4096, warn: float = 0.9, chunk: int = 512, reserved: int = 200) -> Column:
    """struct(free_slots, usage, low, max_chunks) of a context with so many used slots."""
    free = F.lit(total) - used
    usage = used / F.lit(float(total)) if total else F.lit(0.0)
    chunks = F.when(free <= 0, 1).otherwise(F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0), free - reserved) / chunk)))
    return F.struct(free.cast("long").alias("free_slots"), F.round(usage, 6).alias("usage"), (usage >= warn).alias("low"), chunks.cast("long").alias("max_chunks"))


def kv_payload_mib(n: Column, layers: int = 36, heads: int = 2, width: int = 128, bytes_each: int = 2) -> Column:
    """MiB of keys and values of n cached tokens."""
    return n * (2 * layers * heads * width * bytes_each) / 2**20
