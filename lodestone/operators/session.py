"""What a driver keeps around a model between calls: remembered results and a conversation's text.

Everything bounded is one fold, dialogue.Recall, the same that dialogue.replay runs over traces; the
functions here only say what is remembered under which key. Uses of a prefix are written down as a
trace (session, seq, key, hit), so that their statistics are dialogue.hit_rates over a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.dialogue import LABELS, Recall


#: Fixed value: what a model is asked for a question that stands alone.
REWRITE = "对话历史:\n{history}\n\n请把下面的问题改写为独立完整的查询，只输出改写后的查询。\n问题: {query}"


def history_text(messages: Sequence[dict[str, str]], n: int = 10, max_turns: int = 20) -> str:
    """The labelled lines of the last n messages (role, content); n <= 0 means twice max_turns."""
    take = n if n > 0 else 2 * max_turns
    return "\n".join(LABELS[m["role"]] + m["content"] for m in messages[-take:] if m["role"] in LABELS)


def with_prefixes(call: Callable, capacity: int = 4) -> tuple[Callable, list[tuple[str, bool]]]:
    """(ask, uses): ask(prefix, suffix, separator, **options) calls the model with the whole prompt, and
    uses collects (key of the prefix, whether it was among the last capacity prefixes)."""
    recall, uses = Recall(capacity), []

    def ask(prefix: str, suffix: str, separator: str = "", **options):
        key = hashlib.sha256(prefix.encode()).hexdigest()[:16]
        uses.append((key, recall(key)[1]))
        return call(f"{prefix}{separator}{suffix}", **options)

    return ask, uses


def trace(spark: SparkSession, uses: list[tuple[str, bool]], session: int = 0) -> DataFrame:
    """(session, seq, key, hit) of what was used, as dialogue.replay gives it."""
    rows = [(session, i, key, hit) for i, (key, hit) in enumerate(uses)]
    return spark.createDataFrame(rows, "session long, seq long, key string, hit boolean")


def embedding_cache(embed: Callable[[list[str]], list], capacity: int = 1024) -> Callable[[list[str]], list]:
    """embed with what it gave for the last capacity new texts; a call embeds all of its new texts at once."""
    recall = Recall(capacity, "fifo")

    def cached(texts: list[str]) -> list:
        known = {t: recall(t)[0] for t in texts if t in recall}
        new = [t for t in dict.fromkeys(texts) if t not in known]
        for t, vector in zip(new, embed(new) if new else [], strict=True):
            known[t] = recall(t, lambda vector=vector: vector)[0]
        return [known[t] for t in texts]

    return cached


def rewriter(generate: Callable | None, capacity: int = 256) -> Callable[[str, Sequence[str]], str]:
    """rewrite(query, history): the question made to stand alone. It stays as it is without a model or a
    history, when the model fails, or when nothing is left of its answer."""
    recall = Recall(capacity, "fifo")

    def rewrite(query: str, history: Sequence[str] = ()) -> str:
        if generate is None or not history:
            return query
        ask = lambda: generate(REWRITE.format(history="\n".join(history), query=query), max_tokens=128).strip().strip("\"'").strip()
        try:
            return recall((query, *history[-3:]), ask)[0] or query
        except Exception:  # a model may raise anything; its failure is not remembered
            return query

    return rewrite


def streamed(chunks: Iterator[str]) -> str:
    """A streamed answer as one text."""
    return "".join(chunks)
