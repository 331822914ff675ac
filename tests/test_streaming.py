"""Streams run over small files until they have no more."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from loomspan.operators import rules
from loomspan.plans.filters import Filters, clause
from loomspan.sources import logs
from loomspan.streaming import engine


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def files(spark, tmp_path, schema, *batches):
    """A Parquet folder with one file per batch, read one file a trigger."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_ingest_puts_long_lines_aside(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    rec = {"seq": 1, "timestamp_ms": 5, "event": {"tool_call": {"tool_name": "read", "call_id": "a", "arguments_json": "{}"}}}
    (tmp_path / "logs/a.jsonl").write_text(json.dumps(rec) + "\n" + "x" * (engine.MAX_LINE + 1) + "\n")
    go = lambda: engine.ingest(engine.lines(spark, f"{tmp_path}/logs"), logs.fx_calls, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    go()
    rec["event"]["tool_call"]["call_id"] = "b"
    (tmp_path / "logs/b.jsonl").write_text(json.dumps(rec) + "\n")
    go()
    assert sorted(r.call_id for r in spark.read.parquet(f"{tmp_path}/out/rows").collect()) == ["a", "b"]
    assert [r.bytes for r in spark.read.parquet(f"{tmp_path}/out/aside").collect()] == [engine.MAX_LINE + 1]


CALLS = "session long, t timestamp, tool string, ms long, err boolean"


def ts(spark, *seconds):
    return [r[0] for r in spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s")).collect()]


def test_watch_windows_and_stretches(spark, tmp_path):
    t = ts(spark, 0, 60, 100_000, 100_001)
    stream = files(spark, tmp_path, CALLS, [(1, t[0], "bash", 5, False), (1, t[2], "edit", 5, True)], [(1, t[1], "bash", 9, True), (1, t[3], "bash", 1, None)])
    seen = run(engine.watch(stream, Filters(clause("status", "is", "error"))), tmp_path, "watched")
    assert sorted(json.loads(r.line)["tool"] for r in seen) == ["bash", "edit"]
    rows = run(engine.windowed(stream), tmp_path, "windowed", "complete")
    assert sorted((r.start.day, r.tool, r.calls, r.errors) for r in rows) == [(1, "bash", 2, 1), (2, "bash", 1, 0), (2, "edit", 1, 1)]
    rows = run(engine.active_stretches(stream, late="2 days"), tmp_path, "stretches", "append")
    assert all(r.events >= 1 for r in rows)


def test_rule_machine_keeps_state_between_batches(spark, tmp_path):
    schema = "session long, t_ms long, value double"
    stream = files(spark, tmp_path, schema, [(1, 1, 3.0), (2, 1, 0.0)], [(1, 6000, 3.0), (1, 11_500, 4.0)], [(1, 12_000, None), (2, 12_000, 9.0)])
    rule = rules.Rule("x", "tool_calls", ">=", degraded=3, hold_s=10)
    got = run(engine.transitions(stream, rule), tmp_path, "transitions")
    assert sorted((r.session, r.t_ms, r.state) for r in got) == [(1, 11_500, "fire"), (1, 12_000, "resolve")]


def test_hub_counts_a_span_once(spark, tmp_path):
    schema = "host string, session string, span_id string, parent_span_id string, operation string, error_type string, input_tokens long, output_tokens long, end_time timestamp"
    t = ts(spark, 1000)[0]
    row = lambda i, op, parent=None, err=None: ("h", "s", i, parent, op, err, 5, 7, t)
    stream = files(spark, tmp_path, schema, [row("1", "chat"), row("2", "execute_tool", "1", "timeout"), row("1", "chat")], [row("1", "chat"), row("3", "invoke_agent"), row("4", "invoke_agent", "3")])
    got = run(engine.hub(stream), tmp_path, "hub", "update")
    last = max(got, key=lambda r: r.requests + r.tools + r.turns + r.subagents)
    assert (last.requests, last.tools, last.errors, last.turns, last.subagents, last.input_tokens, last.output_tokens) == (1, 1, 1, 1, 1, 5, 7)


def test_late_results(spark, tmp_path):
    t = ts(spark, 1000, 1050)
    calls = files(spark, tmp_path / "c", "call_id string, t timestamp", [("a", t[0]), ("b", t[0])])
    results = files(spark, tmp_path / "r", "result_id string, result_t timestamp", [("a", t[1])])
    got = run(engine.late_results(calls, results), tmp_path, "late")
    assert [(r.call_id, r.result_id) for r in got if r.result_id] == [("a", "a")]


def test_topic_patches(spark, tmp_path):
    stream = files(spark, tmp_path, "k int, n int", [(1, 1), (2, 1)], [(2, 5), (3, 1)])
    engine.publish(stream.groupBy("k").agg(F.sum("n").alias("n")), ["k"], f"{tmp_path}/topic", f"{tmp_path}/ck").awaitTermination()
    got = sorted((r.batch, r.k, r.change) for r in spark.read.parquet(f"{tmp_path}/topic/patch").collect())
    assert got == [(0, 1, "upsert"), (0, 2, "upsert"), (1, 2, "upsert"), (1, 3, "upsert")]
