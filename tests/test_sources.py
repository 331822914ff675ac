"""Log formats, reports, outputs on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators.cost import PRICE_SCHEMA
from loomspan.sources import logs, reports


def lines(spark, *records, file="f1"):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), file) for r in records], "line string, file string")


def test_claude(spark):
    use = {"type": "assistant", "timestamp": "2024-01-01T00:00:00.500Z", "message": {"id": "m1", "role": "assistant", "model": "opus", "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "ls"}}], "usage": {"input_tokens": 3, "output_tokens": 5, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 9, "cache_creation": {"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 5}}}}
    again = json.loads(json.dumps(use))
    again["message"]["usage"]["output_tokens"] = 50
    again["message"]["content"] = []
    result = {"type": "user", "timestamp": "2024-01-01T00:00:02.000Z", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "is_error": True, "content": "no"}]}}
    plain = {"type": "user", "timestamp": "2024-01-01T00:00:03Z", "message": {"role": "user", "content": "do it"}}
    fake = {"type": "assistant", "timestamp": "2024-01-01T00:00:04Z", "message": {"id": "m2", "role": "assistant", "model": "<synthetic>", "content": "x", "usage": {"input_tokens": 1, "output_tokens": 1}}}
    df = lines(spark, use, again, result, plain, fake, "not json", "")
    call = logs.claude_calls(df).collect()
    assert [(c.call_id, c.tool, c.ms, c.err, json.loads(c.args)) for c in call] == [("c1", "Bash", 1500, True, {"command": "ls"})]
    req = logs.claude_requests(df).collect()
    assert [(r.request, r.input, r.output, r.cache_read, r.write_5m, r.write_1h) for r in req] == [("m1", 3, 50, 7, 4, 5)]
    assert "do it" in {b.text for b in logs.claude_blocks(df).filter("type = 'text'").collect()}


def test_codex(spark):
    count = lambda t, i, c, o: {"timestamp": t, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}}
    df = lines(
        spark, count("2024-01-01T00:00:01Z", 100, 40, 10), count("2024-01-01T00:00:02Z", 100, 40, 10), count("2024-01-01T00:00:03Z", 250, 90, 30), count("2024-01-01T00:00:04Z", 20, 5, 2),
        {"timestamp": "2024-01-01T00:00:05Z", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{}", "call_id": "x"}},
        {"timestamp": "2024-01-01T00:00:07Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "x", "output": '{"metadata": {"exit_code": 2}}'}},
    )
    assert sorted((r.input, r.output, r.cache_read) for r in logs.codex_requests(df).collect()) == [(15, 2, 5), (60, 10, 40), (100, 20, 50)]
    assert [(c.tool, c.ms, c.err) for c in logs.codex_calls(df).collect()] == [("shell", 2000, True)]


def test_other_formats(spark):
    fx = lines(spark, {"seq": 1, "timestamp_ms": 5, "event": {"tool_call": {"tool_name": "read", "call_id": "a", "arguments_json": "{}"}}}, {"seq": 2, "timestamp_ms": 5, "event": {"tool_result": {"call_id": "a", "status": "ok", "preview": ""}}})
    assert [(c.tool, c.ms, c.err) for c in logs.fx_calls(fx).collect()] == [("read", None, False)]
    use = {"input": 1, "output": 2, "cacheRead": 3, "cacheWrite": 4, "cost": {"total": 0}}
    pi = lines(spark, {"type": "session", "timestamp": "2024-01-02T00:00:00Z"}, {"type": "message", "id": "old", "timestamp": "2024-01-01T00:00:00Z", "message": {"usage": use}}, {"type": "message", "id": "new", "timestamp": "2024-01-03T00:00:00Z", "message": {"model": "m", "usage": use}})
    assert [(r.request, r.input, r.usd_reported) for r in logs.pi_requests(pi).collect()] == [("new", 1, None)]
    g = lambda t, n: {"id": "1", "timestamp": t, "model": "g", "tokens": {"input": n, "output": 5, "cached": 3, "thoughts": 2, "tool": 1}}
    gem = lines(spark, g("2024-01-01T00:00:02Z", 99), g("2024-01-01T00:00:01Z", 10))
    assert [(r.input, r.output, r.cache_read) for r in logs.gemini_requests(gem).collect()] == [(8, 7, 3)]


def test_user_text_and_reflog(spark):
    texts = ["hello", " ", "<system-reminder>x", "<task-notification>", "Caveat: y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(logs.user_text_kind(F.col("t"))).collect()] == ["human", "noise", "meta", "notify", "meta"]
    a, b = "a" * 40, "b" * 40
    log = lines(spark, f"{a} {b} Me <m@x> 1700000000 +0100\tcommit (amend): better", f"{b} {b} Me <m@x> 1700000001 +0100\tcheckout: moving from main to dev", "junk")
    got = logs.reflog(log).orderBy("at_s").collect()
    assert [(r.op, r.subject, r.target) for r in got] == [("amend", "better", None), ("checkout", "moving from main to dev", "dev")]


def test_outputs(spark, tmp_path):
    df = spark.range(2).select("id", F.struct(F.lit(1).alias("x"), F.struct(F.lit("é,\"q").alias("z")).alias("y")).alias("s"))
    assert reports.flattened(df).columns == ["id", "s.x", "s.y.z"]
    assert reports.picked(df, ["s.y.z", "id"]).columns == ["s.y.z", "id"]
    with pytest.raises(ValueError, match="no column nope"):
        reports.picked(df, ["nope"])
    for form in ("jsonl", "csv", "parquet"):
        reports.write_rows(df, f"{tmp_path}/{form}", form)
    assert spark.read.json(f"{tmp_path}/jsonl").count() == 2 and spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["id", "s.x", "s.y.z"]
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "v int, day string")
    reports.write_by_day(rows, f"{tmp_path}/days")
    reports.write_by_day(rows.filter("v = 2").withColumn("v", F.lit(9)), f"{tmp_path}/days")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/days").collect()) == [1, 9]


def test_telemetry(spark):
    calls = spark.createDataFrame([(1, 1, i, "Bash", 1000 * i, 5, i == 2) for i in range(7)], "session long, turn int, seq long, tool string, t_ms long, ms long, err boolean")
    spans = reports.span_rows(calls)
    first = spans.orderBy("startTimeUnixNano").collect()
    assert len({r.spanId for r in first}) == 7 and len({r.traceId for r in first}) == 1 and "error.type" in first[2].attributes and "error.type" not in first[0].attributes
    bodies = reports.otlp_batches(spans, 3).collect()
    assert sorted(b.n for b in bodies) == [1, 3, 3] and sum(len(json.loads(b.body)["spans"]) for b in bodies) == 7
    assert "gen_ai.tool.name" not in reports.scrubbed(spans, ["gen_ai.tool.name"]).first().attributes
    attr = lambda k, **v: {"key": k, "value": v}
    body = {"resourceSpans": [{"resource": {"attributes": [attr("host.name", stringValue="h")]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "s", "parentSpanId": "", "name": "chat", "startTimeUnixNano": "1700000000000000000", "endTimeUnixNano": "1700000001000000000", "attributes": [attr("gen_ai.operation.name", stringValue="chat"), attr("gen_ai.conversation.id", stringValue="c"), attr("gen_ai.usage.input_tokens", intValue="12")]}]}]}]}
    r = reports.decode_otlp(lines(spark, body)).first()
    assert (r.host, r.session, r.span_id, r.parent_span_id, r.operation, r.input_tokens, r.error_type) == ("h", "c", "s", None, "chat", 12, None) and r.end_time.year == 2023


def test_price_file(spark):
    text = '// mine\n{"Opus": {"input": 1, "output": 2, "cacheRead": 0.5}, "x": {"alias": "opus"}}'
    got = reports.price_rows(spark, text)
    assert got.schema == spark.createDataFrame([], PRICE_SCHEMA).schema
    assert sorted((r.layer, r.prefix, r.input, r.cache_read, r.alias) for r in got.collect()) == [("alias", "x", None, None, "opus"), ("user", "opus", 1.0, 0.5, None)]
    assert spark.range(1).select(S.without_credentials(F.lit("https://u:p@h/x"))).first()[0] == "https://h/x"
