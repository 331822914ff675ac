"""Structured Streaming: ingest, filtered watch, rule machine, telemetry hub, topics.

Sources are file streams; everything keyed is Spark state. Batch twins live in ``loomspan.operators``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.ownership import changes
from loomspan.operators.rules import Machine, Rule
from loomspan.plans.filters import Filters

#: A line longer than this is put aside, not parsed.
MAX_LINE = 1 << 20


def lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A log folder as a stream of lines with their file; offsets are the query's checkpoint."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], out_dir: str, checkpoint: str):
    """Parse new lines into a table by micro-batches and put over-long ones aside; retried batches overwrite their own folder."""

    def batch(df: DataFrame, n: int) -> None:
        parse(df.filter(F.octet_length("line") <= MAX_LINE)).write.mode("overwrite").parquet(f"{out_dir}/rows/batch={n}")
        df.filter(F.octet_length("line") > MAX_LINE).select("file", F.octet_length("line").alias("bytes")).write.mode("overwrite").parquet(f"{out_dir}/aside/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(events: DataFrame, filters: Filters) -> DataFrame:
    """Events that satisfy a filter, as JSON lines."""
    shown = events.filter(filters.column("call")).filter(filters.column("event"))
    return shown.select(F.to_json(F.struct(*(c for c in shown.columns))).alias("line"))


def windowed(calls: DataFrame, t: str = "t", late: str | None = None, size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Calls and errors per tool and window. Without ``late`` any late row still updates its window."""
    rows = calls.withWatermark(t, late) if late else calls
    return rows.groupBy(F.window(t, size, slide) if slide else F.window(t, size), "tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if("err").alias("errors")).select(
        F.col("window.start").alias("start"), "tool", "calls", "errors"
    )


def active_stretches(calls: DataFrame, t: str = "t", late: str = "1 hour", gap: str = "5 minutes") -> DataFrame:
    """Stretches of activity per session by gap windows: first and last event and their number."""
    return calls.withWatermark(t, late).groupBy(F.session_window(t, gap), "session").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("events")).drop("session_window")


def late_results(calls: DataFrame, results: DataFrame, late: str = "1 hour", within: str = "2 hours") -> DataFrame:
    """Calls with results that come later: a stream-stream left join that gives up once the watermark has passed."""
    a = calls.withWatermark("t", late).alias("a")
    b = results.withWatermark("result_t", late).alias("b")
    on = F.expr(f"a.call_id = b.result_id AND b.result_t >= a.t AND b.result_t <= a.t + INTERVAL {within}")
    return a.join(b, on, "leftOuter")


def transitions(samples: DataFrame, rule: Rule) -> DataFrame:
    """The rule machine as keyed state: samples (session, t_ms, value) to level changes."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, degraded, critical = state.get if state.exists else (0, 0.0, 0.0)
        machine, rows = Machine(rule, level, (degraded, critical)), []
        for pdf in parts:
            for t, v in pdf.sort_values("t_ms")[["t_ms", "value"]].itertuples(index=False):
                was = machine.level
                told = machine.step(None if pd.isna(v) else v, t)
                if told:
                    rows.append((key[0], rule.id, t, was, machine.level, told))
        state.update((machine.level, float(machine.since[0]), float(machine.since[1])))
        yield pd.DataFrame(rows, columns=["session", "rule", "t_ms", "from_level", "to_level", "state"])

    out = "session long, rule string, t_ms long, from_level int, to_level int, state string"
    return samples.groupBy("session").applyInPandasWithState(run, out, "level int, degraded double, critical double", "append", GroupStateTimeout.NoTimeout)


def hub(spans: DataFrame, horizon: str = "48 hours") -> DataFrame:
    """Telemetry spans to sums per host, session and day; a span sent twice within the horizon counts once.

    chat spans are requests, execute_tool spans calls, invoke_agent with a parent subagents and without one turns.
    """
    once = spans.withWatermark("end_time", horizon).dropDuplicatesWithinWatermark(["host", "span_id"])
    op, parent = F.col("operation"), F.col("parent_span_id").isNotNull()
    return once.groupBy("host", "session", F.to_date("end_time").alias("day")).agg(
        F.count_if(op == "chat").alias("requests"),
        F.count_if(op == "execute_tool").alias("tools"),
        F.count_if((op == "invoke_agent") & parent).alias("subagents"),
        F.count_if((op == "invoke_agent") & ~parent).alias("turns"),
        F.count_if(F.col("error_type").isNotNull()).alias("errors"),
        F.sum(F.when(op == "chat", F.col("input_tokens"))).alias("input_tokens"),
        F.sum(F.when(op == "chat", F.col("output_tokens"))).alias("output_tokens"),
    )


def publish(state: DataFrame, key: list[str], folder: str, checkpoint: str):
    """A topic: each micro-batch of a complete-mode aggregate leaves its snapshot and the patch from the last one."""

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{folder}/snapshot/{n}")
        now = spark.read.parquet(f"{folder}/snapshot/{n}")
        old = spark.read.schema(now.schema).parquet(f"{folder}/snapshot/{n - 1}") if n else now.limit(0)
        changes(old, now, key).write.mode("overwrite").parquet(f"{folder}/patch/batch={n}")

    return state.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
