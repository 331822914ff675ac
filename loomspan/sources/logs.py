"""Transcript formats: raw JSON lines to normalised calls and requests.

Each source is a projection of ``line`` with an explicit, permissive schema; calls meet their results by id in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAUDE = """type string, timestamp string, sessionId string, cwd string, message struct<id: string, role: string, model: string, content: string,
  usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint,
  cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>>>"""
BLOCK = "array<struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, is_error: boolean, content: string>>"
CODEX = """timestamp string, type string, payload struct<type: string, name: string, arguments: string, call_id: string, output: string,
  info: struct<total_token_usage: struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint>>>"""
FX = "seq bigint, timestamp_ms bigint, event struct<tool_call: struct<tool_name: string, call_id: string, arguments_json: string>, tool_result: struct<call_id: string, status: string, preview: string>>"
PI = """type string, id string, parentId string, timestamp string, message struct<role: string, model: string, provider: string,
  usage: struct<input: bigint, output: bigint, cacheRead: bigint, cacheWrite: bigint, cost: struct<total: double>>>"""
GEMINI = "id string, timestamp string, type string, model string, tokens struct<input: bigint, output: bigint, cached: bigint, thoughts: bigint, tool: bigint>, toolCalls array<struct<id: string, name: string, status: string>>"


def millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select("file", F.from_json("line", schema).alias("r")).filter("r IS NOT NULL").select("file", "r.*")


def claude_blocks(lines: DataFrame) -> DataFrame:
    """Content blocks of messages: a string content is one text block."""
    rows = _parsed(lines, CLAUDE).filter("type IN ('user', 'assistant')")
    blocks = F.coalesce(F.from_json("message.content", BLOCK), F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("message.content").alias("text")))), BLOCK))
    return rows.select("file", millis(F.col("timestamp")).alias("t_ms"), F.col("message.id").alias("message"), F.col("message.role").alias("role"), F.col("message.model").alias("model"), F.explode(blocks).alias("b")).select(
        "file", "t_ms", "message", "role", "model", "b.*"
    )


def _with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    met = calls.join(results, ["file", "call_id"], "left")
    return met.select("file", "call_id", "tool", "t_ms", (F.col("result_ms") - F.col("t_ms")).alias("ms"), "err", "args")


def claude_calls(lines: DataFrame) -> DataFrame:
    blocks = claude_blocks(lines)
    calls = blocks.filter("type = 'tool_use'").select("file", F.col("id").alias("call_id"), F.col("name").alias("tool"), "t_ms", F.col("input").alias("args"))
    results = blocks.filter("type = 'tool_result'").select("file", F.col("tool_use_id").alias("call_id"), F.col("t_ms").alias("result_ms"), F.coalesce("is_error", F.lit(False)).alias("err"))
    return _with_results(calls, results)


def claude_requests(lines: DataFrame) -> DataFrame:
    """One row per message id: streamed repeats add only growth, so the largest output counts; synthetic models are not billed."""
    rows = _parsed(lines, CLAUDE).filter("message.usage IS NOT NULL AND NOT coalesce(message.model, '') LIKE '<%'")
    u = "message.usage."
    written = F.coalesce(F.col(u + "cache_creation.ephemeral_5m_input_tokens"), F.col(u + "cache_creation_input_tokens"), F.lit(0))
    return rows.groupBy("file", F.col("message.id").alias("request"), F.col("message.model").alias("model")).agg(
        F.min(millis(F.col("timestamp"))).alias("t_ms"),
        F.max(u + "input_tokens").alias("input"),
        F.max(u + "output_tokens").alias("output"),
        F.max(F.coalesce(u + "cache_read_input_tokens", F.lit(0))).alias("cache_read"),
        F.max(written).alias("write_5m"),
        F.max(F.coalesce(u + "cache_creation.ephemeral_1h_input_tokens", F.lit(0))).alias("write_1h"),
    )


def codex_calls(lines: DataFrame) -> DataFrame:
    rows = _parsed(lines, CODEX)
    calls = rows.filter("payload.type LIKE '%function_call' OR payload.type = 'custom_tool_call'").select(
        "file", F.col("payload.call_id").alias("call_id"), F.col("payload.name").alias("tool"), millis(F.col("timestamp")).alias("t_ms"), F.col("payload.arguments").alias("args")
    )
    results = rows.filter("payload.type LIKE '%call_output'").select(
        "file", F.col("payload.call_id").alias("call_id"), millis(F.col("timestamp")).alias("result_ms"), F.col("payload.output").rlike(r'"exit_code":\s*[1-9]|Exit code: [1-9]').alias("err")
    )
    return _with_results(calls, results)


def codex_requests(lines: DataFrame) -> DataFrame:
    """Cumulative counters as deltas in time order; if any went backwards all are taken afresh. Input excludes the cached part."""
    u = F.col("payload.info.total_token_usage")
    rows = _parsed(lines, CODEX).filter("payload.info.total_token_usage IS NOT NULL").select(
        "file", millis(F.col("timestamp")).alias("t_ms"), u["input_tokens"].alias("i"), u["cached_input_tokens"].alias("c"), u["output_tokens"].alias("o")
    )
    w = Window.partitionBy("file").orderBy("t_ms", "i", "o")
    was = {k: F.coalesce(F.lag(k).over(w), F.lit(0)) for k in "ico"}
    back = (F.col("i") < was["i"]) | (F.col("c") < was["c"]) | (F.col("o") < was["o"])
    d = {k: F.when(back, F.col(k)).otherwise(F.col(k) - was[k]) for k in "ico"}
    return rows.select("file", "t_ms", (d["i"] - d["c"]).alias("input"), d["o"].alias("output"), d["c"].alias("cache_read")).filter("input + output + cache_read > 0")


def fx_calls(lines: DataFrame) -> DataFrame:
    """Equal times of call and result mean an unknown duration."""
    rows = _parsed(lines, FX)
    calls = rows.filter("event.tool_call IS NOT NULL").select("file", F.col("event.tool_call.call_id").alias("call_id"), F.col("event.tool_call.tool_name").alias("tool"), F.col("timestamp_ms").alias("t_ms"), F.col("event.tool_call.arguments_json").alias("args"))
    results = rows.filter("event.tool_result IS NOT NULL").select("file", F.col("event.tool_result.call_id").alias("call_id"), F.col("timestamp_ms").alias("result_ms"), (F.col("event.tool_result.status") != "ok").alias("err"))
    return _with_results(calls, results).withColumn("ms", F.nullif("ms", F.lit(0)))


def pi_requests(lines: DataFrame) -> DataFrame:
    """Own cost where it is above 0. Entries older than their fork's header are copies of the parent's and are left out."""
    rows = _parsed(lines, PI)
    head = rows.filter("type = 'session'").groupBy("file").agg(F.max(millis(F.col("timestamp"))).alias("born"))
    u = F.col("message.usage")
    made = rows.filter("message.usage IS NOT NULL").join(head, "file", "left").filter(F.coalesce(millis(F.col("timestamp")) >= F.col("born"), F.lit(True)))
    return made.select("file", F.col("id").alias("request"), F.col("message.model").alias("model"), F.col("message.provider").alias("provider"), millis(F.col("timestamp")).alias("t_ms"), u["input"].alias("input"), u["output"].alias("output"), u["cacheRead"].alias("cache_read"), u["cacheWrite"].alias("write_5m"), F.when(u["cost"]["total"] > 0, u["cost"]["total"]).alias("usd_reported"))


def gemini_requests(lines: DataFrame) -> DataFrame:
    """Messages are upserted by id: the first record that carries tokens counts. Input excludes cached, output has the thoughts."""
    rows = _parsed(lines, GEMINI).filter("tokens IS NOT NULL").withColumn("t_ms", millis(F.col("timestamp")))
    t = F.col("s.tokens")
    n = lambda c: F.coalesce(t[c], F.lit(0))
    first = rows.groupBy("file", F.col("id").alias("request")).agg(F.min_by(F.struct("model", "tokens", "t_ms"), "t_ms").alias("s"))
    return first.select("file", "request", "s.model", "s.t_ms", (n("input") - n("cached") + n("tool")).alias("input"), (n("output") + n("thoughts")).alias("output"), n("cached").alias("cache_read"))


def user_text_kind(text: Column) -> Column:
    """human, notify, peer, meta or noise of a user line's text."""
    return (
        F.when(F.trim(text) == "", "noise")
        .when(text.rlike(r"^\s*<(?:task-notification|system-notification)"), "notify")
        .when(text.rlike(r"^\s*<(?:teammate-message|agent-message)"), "peer")
        .when(text.rlike(r"^\s*<(?:command-|local-command|system-reminder)|^Caveat:|^\[Request interrupted"), "meta")
        .otherwise("human")
    )


def reflog(lines: DataFrame) -> DataFrame:
    """Git reflog lines: old and new id, time, operation, subject and the branch that a checkout moved to."""
    p = r"^([0-9a-f]{40}) ([0-9a-f]{40}) (.*?) <[^>]*> (\d+) [+-]\d{4}\t(.*)$"
    part = lambda i: F.regexp_extract("line", p, i)
    rows = lines.filter(F.col("line").rlike(p)).select("file", part(1).alias("old"), part(2).alias("sha"), part(4).cast("long").alias("at_s"), part(5).alias("message"))
    head = F.regexp_extract("message", r"^([\w-]+)(?: \((\w+)\))?", 1)
    kind = F.regexp_extract("message", r"^[\w-]+ \((\w+)\)", 1)
    op = F.when(kind != "", kind).otherwise(head)
    return rows.withColumns({"op": op, "subject": F.regexp_extract("message", r": (.*)$", 1), "target": F.nullif(F.regexp_extract("message", r"^checkout: moving from \S+ to (\S+)$", 1), F.lit(""))})
