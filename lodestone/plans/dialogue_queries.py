"""Queries over conversations: histories, memories, caches, model outputs, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import agent, dialogue
from lodestone.plans.text_queries import asked, table
from lodestone.sources.shared import shared_folder
from lodestone.streaming import ingest, memory

REPLY = "这是一个模拟回答。"
CAPACITY = 2


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def history_last_n(spark, sf_dir):
    return dialogue.last_messages(_messages(spark, sf_dir), 4).select("conv_id", "turn", "role", "text")


def history_text(spark, sf_dir):
    return dialogue.history_text(_messages(spark, sf_dir), 4)


def _log_of(messages):
    """Every message sets its role's value to its length, unless that is divisible by 5, which takes it out."""
    n = F.length("text")
    return messages.select("conv_id", F.col("turn").alias("seq"), F.when(n % 5 == 0, "pop").otherwise("set").alias("op"), F.col("role").alias("key"), n.cast("long").alias("value"))


def working_memory_state(spark, sf_dir):
    return dialogue.working_memory(_log_of(_messages(spark, sf_dir)))


def live_memory_state(spark, sf_dir):
    """The same memories from keyed state, to which the log has come as a stream of up to three micro-batches."""
    folder, source = shared_folder(spark, "memory"), f"{sf_dir}/conversations.parquet"
    there = spark.read.parquet(source)
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", max(1, -(-len(there.inputFiles()) // 3))).parquet(f"{source[:-1]}[{source[-1]}]")
    memory.remember(_log_of(stream), f"{folder}/memories", f"{folder}/progress")
    return memory.snapshot(spark, f"{folder}/memories", value="bigint")


def rewrite_inputs(spark, sf_dir):
    return dialogue.rewrite_inputs(_messages(spark, sf_dir))


def rewrite_cleanup(spark, sf_dir):
    """Answers in quotes and white space, every third of them empty."""
    said = F.when(F.col("turn") % 3 == 0, F.lit(" '\"' ")).otherwise(F.concat(F.lit(" \n\""), F.substring_index("text", " ", 5), F.lit("\"'\t ")))
    return _messages(spark, sf_dir).select("conv_id", "turn", dialogue.cleaned_rewrite(said, F.col("text")).alias("rewritten"))


def _trace(spark, sf_dir):
    return _messages(spark, sf_dir).select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat_ws("-", "role", F.length("text") % 3).alias("key"))


def prefix_cache_replay(spark, sf_dir):
    return dialogue.replay(_trace(spark, sf_dir), CAPACITY)


def prefix_cache_hit_rate(spark, sf_dir):
    return dialogue.hit_rates(prefix_cache_replay(spark, sf_dir))


def embedding_cache_replay(spark, sf_dir):
    return dialogue.replay(_trace(spark, sf_dir), CAPACITY, "fifo")


def _outputs(spark, sf_dir):
    """Model outputs of every shape around the messages."""
    said = F.regexp_replace("text", r'["\\\s]+', " ")
    shapes = F.array(
        F.concat(F.lit('Thought: look\n<tool_call>\n{"name": "search", "arguments": {"query": "'), said, F.lit('"}}\n</tool_call>')),
        F.concat(F.lit("Thought: done\nfinal answer ： "), said, F.lit(" \n")),
        F.concat(said, F.lit("\nObservation: x")),
        F.lit("Thought: only\nAction: none"),
        F.concat(F.lit('<tool_call>{"nome": 1}</tool_call>'), said),
        F.lit('<tool_call>{"name": "list_documents"}</tool_call>'),
    )
    return _messages(spark, sf_dir).select("conv_id", "turn", F.get(shapes, (F.col("turn") % 6).cast("int")).alias("output"))


def parse_react_output(spark, sf_dir):
    return _outputs(spark, sf_dir).withColumn("p", dialogue.parse_output(F.col("output"))).select("conv_id", "turn", "p.type", "p.tool_name", "p.arguments", "p.content")


def kv_budget(spark, sf_dir):
    """Room that is left beside each conversation, at four characters a token."""
    used = _messages(spark, sf_dir).groupBy("conv_id").agg(F.ceil(F.sum(F.length("text")) / 4).alias("used"))
    rows = used.withColumn("b", dialogue.kv_budget(F.col("used"), total=1024))
    return rows.select("conv_id", F.col("used").cast("long"), "b.*", F.round(dialogue.kv_payload_mib(F.col("used")), 6).alias("payload_mib"))


def mock_llm_stream(spark, sf_dir):
    """The double's reply to each conversation, one row per character."""
    spark.udtf.register("stream_tokens", ingest.StreamTokens)
    convs = _messages(spark, sf_dir).select("conv_id").distinct()
    return spark.sql(f"SELECT c.conv_id, t.i, t.token FROM {{convs}} c, LATERAL stream_tokens('{REPLY}') t", convs=convs)


def agent_trace(spark, sf_dir):
    return agent.run_batch(asked(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def stream_ingest_chunks(spark, sf_dir):
    return ingest.ingested(spark, f"{sf_dir}/documents.parquet")


QUERIES = (history_last_n, history_text, working_memory_state, live_memory_state, rewrite_inputs, rewrite_cleanup, prefix_cache_replay, prefix_cache_hit_rate, embedding_cache_replay, parse_react_output, kv_budget, mock_llm_stream, agent_trace, stream_ingest_chunks)

_LAST = "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4"
_TRACE = "t AS (SELECT conv_id AS session, turn AS seq, role || '-' || length(text) % 3 AS key, lag(turn) OVER (PARTITION BY conv_id, role || '-' || length(text) % 3 ORDER BY turn) AS before FROM conversations)"
_REPLAY = f"{_TRACE}, r AS (SELECT a.session, a.seq, a.key, a.before IS NOT NULL AND count(DISTINCT b.key) < {CAPACITY} AS hit FROM t a LEFT JOIN t b ON b.session = a.session AND b.seq > a.before AND b.seq < a.seq AND b.key <> a.key GROUP BY a.session, a.seq, a.key, a.before)"
_SAID = r"""regexp_replace(text, '["\\\s]+', ' ', 'g')"""
_OUT = f"""SELECT conv_id, turn, turn % 6 AS k, text, {_SAID} AS s FROM conversations"""

ORACLE = {
    "history_last_n": _LAST,
    "history_text": f"SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN '用户: ' || text WHEN 'assistant' THEN '助手: ' || text END, chr(10) ORDER BY turn), '') AS history FROM ({_LAST}) GROUP BY conv_id",
    "working_memory_state": "SELECT conv_id, role AS key, length(text)::BIGINT AS value FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1 AND length(text) % 5 <> 0",
    "live_memory_state": "SELECT conv_id, role AS key, length(text)::BIGINT AS value FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1 AND length(text) % 5 <> 0",
    "rewrite_inputs": "WITH l AS (SELECT conv_id, max(turn) AS at, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id), b AS (SELECT l.conv_id, query, coalesce(list(c.text ORDER BY c.turn) FILTER (c.text IS NOT NULL), []) AS m FROM l LEFT JOIN conversations c ON c.conv_id = l.conv_id AND c.turn < l.at GROUP BY l.conv_id, query) SELECT conv_id, query, array_to_string(m, chr(10)) AS history, query || '|' || array_to_string(list_slice(m, greatest(1, len(m) - 2), len(m)), chr(10)) AS cache_key FROM b",
    "rewrite_cleanup": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ') END AS rewritten FROM conversations",
    "prefix_cache_replay": f"WITH {_REPLAY} SELECT * FROM r",
    "prefix_cache_hit_rate": f"WITH {_REPLAY} SELECT session, count_if(hit)::BIGINT AS hits, count_if(NOT hit)::BIGINT AS misses, round(avg(hit::INT), 6) AS hit_rate FROM r GROUP BY session",
    "parse_react_output": f"SELECT conv_id, turn, CASE WHEN k IN (0, 5) THEN 'action' WHEN k IN (1, 2) THEN 'final_answer' ELSE 'unknown' END AS type, CASE k WHEN 0 THEN 'search' WHEN 5 THEN 'list_documents' END AS tool_name, CASE k WHEN 0 THEN '{{\"query\":\"' || s || '\"}}' WHEN 5 THEN '{{}}' END AS arguments, CASE k WHEN 1 THEN trim(s) WHEN 2 THEN trim(s) WHEN 3 THEN 'Thought: only' || chr(10) || 'Action: none' WHEN 4 THEN '<tool_call>{{\"nome\": 1}}</tool_call>' || s END AS content FROM ({_OUT})",
    "kv_budget": "SELECT conv_id, used, (1024 - used)::BIGINT AS free_slots, round(used / 1024.0::DOUBLE, 6) AS usage, used / 1024.0::DOUBLE >= 0.9 AS low, CASE WHEN used >= 1024 THEN 1 ELSE greatest(1, greatest(0, 1024 - used - 200) // 512) END::BIGINT AS max_chunks, round(used * 36864 / 1048576.0::DOUBLE, 6) AS payload_mib FROM (SELECT conv_id, ceil(sum(length(text)) / 4.0)::BIGINT AS used FROM conversations GROUP BY conv_id)",
    "mock_llm_stream": f"SELECT conv_id, i, substring('{REPLY}', (i + 1)::BIGINT, 1) AS token FROM (SELECT DISTINCT conv_id FROM conversations) CROSS JOIN range({len(REPLY)}) r(i)",
    "stream_ingest_chunks": "SELECT doc_id, (start_char // 448)::BIGINT AS ordinal, start_char, substring(text, start_char + 1, 512) AS content, doc_id || '#' || start_char AS chunk_id FROM (SELECT doc_id, unnest(range(0, length(text), 448)) AS start_char, text FROM documents WHERE length(text) > 0)",
}
