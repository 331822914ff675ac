"""Open calls as keyed state: a result closes its call however many micro-batches later, and a closed call may still grow.

An event is ``file, call_id, kind, place, t_ms, name, err``: a ``call`` opens, a ``result`` closes the oldest open call of its file and id (a
null id is one key of its file, so such calls close first in, first out), ``more`` tells that the last closed call of the key ran on.
The state of a key is its open calls and the last one closed; Spark keeps it in the checkpoint, so it survives restarts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What runs on for longer belongs to another run.
LONGEST_MS = 86_400_000
_OUT = "file string, call_id string, place long, t_ms long, name string, what string, ms long, err boolean"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def in_order(parts: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """The rows of a key's chunks by their first column, nulls as None; all chunks first, since each is in no order of its own.

    Most keys have a few rows a micro-batch, for which frames that are joined, sorted and cast cost far more than the rows.
    """
    rows = []
    for part in parts:
        rows += zip(*([None if x is None or x is pd.NA or x != x else x for x in part[c].tolist()] for c in columns), strict=True)
    return sorted(rows, key=lambda r: r[0])


def told(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """``rows`` as a frame of plain objects, which Spark casts to the output's types; none for no rows."""
    if rows:
        yield pd.DataFrame(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True)), dtype=object)


class OpenCalls:
    """The machine of one key; :meth:`step` gives the rows an event makes: ``place, t_ms, name, what, ms, err``."""

    def __init__(self, open_: list[list], last: list | None, most: int):
        self.open, self.last, self.most = open_, last, most

    def step(self, kind: str, place: int, t_ms: int, name: str | None, err: bool) -> list[tuple]:
        if kind == "call":
            self.open.append([place, t_ms, name])
            if len(self.open) <= self.most:
                return []
            return [(*self.open.pop(0), "spilled", None, None)]
        if kind == "result":
            if not self.open:
                return []
            call = self.open.pop(0)
            self.last = [*call, t_ms - call[1], err]
            return [(*call, "closed", *self.last[3:])]
        if kind != "more" or self.last is None or t_ms - self.last[1] >= LONGEST_MS:
            return []
        ms, failed = max(self.last[3], t_ms - self.last[1]), self.last[4] or err
        if [ms, failed] == self.last[3:]:
            return []
        self.last[3:] = ms, failed
        return [(*self.last[:3], "grown", ms, failed)]


def close_calls(events: DataFrame, most: int = 2000) -> DataFrame:
    """A stream of events to rows ``file, call_id, place, t_ms, name, what, ms, err``; the last row of a call holds (:func:`settled`).

    ``what`` is ``closed``, ``grown`` (a duration never shrinks and an error stays) or ``spilled``: beyond ``most`` open calls of one key the
    oldest is told without a result and forgotten, so no state grows without end and no call is lost in silence. A result
    without an open call makes no row. The events of one key within a micro-batch are put in order of ``place``; batches must follow
    each other in that order, as the appended parts of a log do. A null error counts as none.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = OpenCalls(*(json.loads(state.get[0]) if state.exists else ([], None)), most)
        rows = []
        for place, kind, t_ms, name, err in in_order(parts, ["place", "kind", "t_ms", "name", "err"]):
            for row in machine.step(kind, int(place), int(t_ms), name, bool(err)):
                rows.append((*key, *row))
        state.update((json.dumps([machine.open, machine.last]),))
        yield from told(rows, _COLUMNS)

    return events.groupBy("file", "call_id").applyInPandasWithState(run, _OUT, "held string", "append", GroupStateTimeout.NoTimeout)


def settled(rows: DataFrame) -> DataFrame:
    """One row per call of the stream's output: its longest duration and whether it failed (null: spilled without a result)."""
    return rows.groupBy("file", "call_id", "place").agg(F.first("t_ms").alias("t_ms"), F.first("name").alias("name"), F.max("ms").alias("ms"), F.bool_or("err").alias("err"))


def closed_calls(events: DataFrame) -> DataFrame:
    """The batch twin of :func:`close_calls` and :func:`settled`, without a bound on open calls: closed calls only.

    The n-th result that finds an open call closes the n-th call: results that found none are those by which results have ever
    outnumbered calls. The windows run over one file and id.
    """
    upto = Window.partitionBy("file", "call_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.count_if(F.col("kind") == kind).over(upto)
    told = events.withColumn("calls", count("call")).withColumn("results", count("result"))
    told = told.withColumn("orphans", F.greatest(F.lit(0), F.max(F.col("results") - F.col("calls")).over(upto)))
    told = told.withColumn("nth", F.when(F.col("kind") == "call", F.col("calls")).otherwise(F.col("results") - F.col("orphans")))
    found = F.col("orphans") > F.coalesce(F.lag("orphans").over(Window.partitionBy("file", "call_id").orderBy("place")), F.lit(0))
    calls = told.filter("kind = 'call'").select("file", "call_id", "nth", "place", "t_ms", "name")
    ends = told.withColumn("late", found).filter("kind = 'more' OR (kind = 'result' AND NOT late)").select(F.col("file").alias("f"), F.col("call_id").alias("c"), F.col("nth").alias("k"), "kind", F.col("t_ms").alias("end"), "err")
    met = calls.join(ends, (F.col("f") == F.col("file")) & F.col("c").eqNullSafe(F.col("call_id")) & (F.col("k") == F.col("nth")))
    met = met.withColumn("ms", F.col("end") - F.col("t_ms")).filter((F.col("kind") == "result") | (F.col("ms") < LONGEST_MS))
    return met.groupBy("file", "call_id", "place").agg(F.first("t_ms").alias("t_ms"), F.first("name").alias("name"), F.max("ms").alias("ms"), F.bool_or(F.coalesce("err", F.lit(False))).alias("err"))


def replay(events: DataFrame, order: str, parts: int, run: Callable[[DataFrame], DataFrame], schema: str, name: str) -> DataFrame:
    """Rows that the streaming query ``run`` makes of a table as the log it might have been: appended in ``parts`` runs of ``order``.

    Every run starts the query again from its checkpoint, so what it knows of earlier runs it knows by state. Files lie in the folder
    that ``spark.checkpoint.dir`` names. An empty table gives no rows; so do events without an ``order``.
    """
    spark = events.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    low, high = events.agg(F.min(order), F.max(order)).first()
    for part in range(parts if low is not None else 0):
        cut = [low + (high + 1 - low) * k // parts for k in (part, part + 1)]
        events.filter(F.col(order).between(cut[0], cut[1] - 1)).write.mode("append").parquet(f"{root}/log")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/log")
        run(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/rows").awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/rows") if low is not None else spark.createDataFrame([], schema)


def replayed(events: DataFrame, order: str, parts: int, most: int = 2000) -> DataFrame:
    """A table of events read by :func:`close_calls` as a log that grows in ``parts`` runs: results meet calls of earlier runs by state."""
    return settled(replay(events, order, parts, lambda s: close_calls(s, most), _OUT, "open-calls"))
