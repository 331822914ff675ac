"""Calls that stay open over micro-batches and restarts, against the batch twins."""

from __future__ import annotations

import random

from loomspan.operators.intervals import pair_results
from loomspan.streaming import open_calls
from loomspan.streaming.open_calls import LONGEST_MS, OpenCalls, close_calls, closed_calls, settled

EVENTS = "file string, call_id string, kind string, place long, t_ms long, name string, err boolean"


def stream_of(spark, tmp_path, batches, **settings):
    """One run of the query, with one checkpoint, after each batch of files: every run is a restart."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).repartition(2).write.parquet(f"{tmp_path}/in/b{i}")
        events = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        close_calls(events, **settings).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def random_events(rnd, n):
    return [(rnd.choice("fg"), rnd.choice(["a", "b", None]), rnd.choice(["call", "call", "result", "result", "more"]), i, 1000 * i + rnd.randrange(900), "bash", rnd.choice([True, False, None])) for i in range(n)]


def test_results_of_later_batches_close_after_restarts(spark, tmp_path):
    rows = random_events(random.Random(4), 240)
    got = settled(stream_of(spark, tmp_path, [rows[i : i + 60] for i in range(0, 240, 60)])).collect()
    want = closed_calls(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 40
    assert any(r.ms > 60_000 for r in got)  # some closed more than a batch later


def test_well_formed_logs_pair_as_in_batch(spark, tmp_path):
    """Where every result comes after its call, the pairs are those of ``pair_results``, by id and, for null ids, by place."""
    rnd, rows, waiting = random.Random(9), [], []
    for place in range(120):
        if waiting and rnd.random() < 0.5:
            call_id = waiting.pop(0)
            rows.append(("f", call_id, "result", place, 10 * place, None, False))
        else:
            waiting.append(rnd.choice(["x", "y", None]))
            rows.append(("f", waiting[-1], "call", place, 10 * place, "bash", None))
    df = spark.createDataFrame(rows, EVENTS)
    calls, results = df.filter("kind = 'call'").select("file", "call_id", "place", "t_ms"), df.filter("kind = 'result'").select("file", "call_id", "place", "t_ms")
    for one, ids in ((calls.filter("call_id IS NOT NULL"), "call_id IS NOT NULL"), (calls.filter("call_id IS NULL"), "call_id IS NULL")):
        paired = pair_results(one, results.filter(ids), ["file"], "place", "call_id").filter("result_t_ms IS NOT NULL")
        want = sorted((r.place, r.result_t_ms - r.t_ms) for r in paired.collect())
        assert want == sorted((r.place, r.ms) for r in closed_calls(df).filter(ids).collect())
    got = settled(stream_of(spark, tmp_path, [rows[:50], rows[50:70], rows[70:]]))
    assert sorted((r.place, r.ms) for r in got.collect()) == sorted((r.place, r.ms) for r in closed_calls(df).collect())


def test_growth_spill_and_orphans():
    m = OpenCalls([], None, 2)
    assert m.step("result", 0, 5, None, False) == [] == m.step("more", 1, 6, None, False)
    assert m.step("call", 2, 10, "a", False) == [] == m.step("call", 3, 11, "b", False)
    assert m.step("call", 4, 12, "c", False) == [(2, 10, "a", "spilled", None, None)]
    assert m.step("result", 5, 20, None, False) == [(3, 11, "b", "closed", 9, False)]
    assert m.step("more", 6, 15, None, False) == []  # never shrinks
    assert m.step("more", 7, 40, None, False) == [(3, 11, "b", "grown", 29, False)]
    assert m.step("more", 8, 30, None, True) == [(3, 11, "b", "grown", 29, True)]  # an error stays
    assert m.step("more", 9, 41, None, False) == [(3, 11, "b", "grown", 30, True)]
    assert m.step("more", 10, 11 + LONGEST_MS, None, False) == []
    assert m.step("result", 11, 50, None, True) == [(4, 12, "c", "closed", 38, True)]


def test_spilled_calls_are_told(spark, tmp_path):
    rows = [("f", None, "call", i, i, "bash", None) for i in range(5)] + [("f", None, "result", 9, 100, None, False)]
    got = {r.place: (r.what, r.ms) for r in stream_of(spark, tmp_path, [rows[:3], rows[3:]], most=3).collect()}
    assert got == {0: ("spilled", None), 1: ("spilled", None), 2: ("closed", 98)}


def test_a_key_costs_its_rows_and_no_frames():
    """Chunks are put in order as plain rows, nulls as None; a key that makes no rows makes no frame."""
    import pandas as pd

    parts = [pd.DataFrame({"place": [3, 1], "ms": [None, 2.0]}), pd.DataFrame({"place": [2], "ms": [float("nan")]})]
    assert open_calls.in_order(iter(parts), ["place", "ms"]) == [(1, 2.0), (2, None), (3, None)]
    assert list(open_calls.told([], ["a", "b"])) == []
    (frame,) = open_calls.told([(1, None), (None, True)], ["a", "b"])
    assert frame.values.tolist() == [[1, None], [None, True]]
