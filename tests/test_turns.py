"""Turns in windows and in streaming state against the plain automaton; hosts of subagents against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomspan.operators.turns import attach_spans, innermost, line_kind, told_ms, turn_spans
from loomspan.streaming.turns import TurnMachine, running_turns, settled_turns

LINES = "session string, place long, kind string, t_ms long, ms long"
FIELDS = ["session", "turn", "opened_by", "place", "prompt_place", "t0", "t1", "closed_by", "late"]


def random_lines(rnd, n):
    """Three sessions (one without a name), pauses, lines without times and kinds, times that go back."""
    kinds = ["prompt", "started", "activity", "activity", "complete", "aborted", None]
    t, out = 0, []
    for i in range(n):
        t += rnd.choice([1, 50, 900, 5000])
        when = None if rnd.random() < 0.15 else t - rnd.choice([0, 0, 0, 700])
        out.append((rnd.choice(["a", "b", None]), i, rnd.choice(kinds), when, rnd.choice([None, 0, 30, 4000])))
    return out


def plain_turns(lines, quiet):
    """Every session through the machine in one go."""
    machines, out = {}, []
    for session, *line in sorted(lines, key=lambda r: r[1]):
        m = machines.setdefault(session, TurnMachine(quiet))
        out += [(session, r) for r in m.step(*line)]
    out += [(s, r) for s, m in machines.items() for r in m.open_turn()]
    return sorted(str((s, *(r[c] for c in FIELDS[1:]))) for s, r in out)


def told(df):
    return sorted(str(tuple(r)) for r in df.select(FIELDS).collect())


def test_windows_equal_the_automaton(spark):
    for seed, quiet in ((1, 2000), (2, 2000), (3, None), (4, 40)):
        lines = random_lines(random.Random(seed), 400)
        want = plain_turns(lines, quiet)
        assert told(turn_spans(spark.createDataFrame(lines, LINES), ["session"], "place", quiet)) == want and len(want) > 100
    assert told(turn_spans(spark.createDataFrame([], LINES), ["session"], "place", 1)) == []


def test_state_goes_on_at_any_border(spark, tmp_path):
    lines, quiet = random_lines(random.Random(7), 300), 2000
    for n, cuts in enumerate(([0, 1, 2, 140, 300], [0, 97, 211, 300])):
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            spark.createDataFrame(lines[a:b], LINES).repartition(2).write.parquet(f"{tmp_path}/{n}/in/b{i}")
            stream = spark.readStream.schema(LINES).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{n}/in")
            running_turns(stream, quiet).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{n}/ck").trigger(availableNow=True).start(f"{tmp_path}/{n}/out").awaitTermination()
        assert told(settled_turns(spark.read.parquet(f"{tmp_path}/{n}/out"))) == plain_turns(lines, quiet)


def test_what_opens_and_closes(spark):
    raw = [("meta", "turn started"), ("user", "hi"), ("tool", "ls"), ("meta", "turn complete · 44.3s"), ("meta", "other"), ("reply", "late words"), ("user", "more"), ("meta", "turn aborted"), ("meta", "turn aborted")]
    df = spark.createDataFrame([("s", i, k, x, 100_000 + 1000 * i) for i, (k, x) in enumerate(raw)], "session string, place long, k string, x string, t_ms long")
    got = turn_spans(df.withColumn("kind", line_kind(F.col("k"), F.col("x"))).withColumn("ms", told_ms(F.col("x"))), ["session"], "place").orderBy("turn").collect()
    assert [tuple(r)[1:] for r in got] == [
        (1, "started", 0, 1, 58_700, 103_000, "complete", False),  # the told length moves the start back
        (2, "activity", 5, None, 105_000, 106_000, "next", False),  # closed by a marker, so not late
        (3, "prompt", 6, 6, 106_000, 107_000, "aborted", False),
    ]


def plain_hosts(children, spans, slack=1000):
    out = {}
    for s, child, call, t in children:
        own = [x for x in spans if x[0] == s]
        by_id = [x for x in own if call is not None and x[2] == call]
        spawn = [x for x in own if x[4] and t is not None and x[6] <= t + slack]
        around = [x for x in own if t is not None and x[6] <= t <= x[7]]
        out[child] = (min(by_id, key=lambda x: x[3])[1], "id") if by_id else (max(spawn, key=lambda x: x[3])[1], "spawn") if spawn else (max(around, key=lambda x: (x[5], x[3]))[1], "enclosing") if around else (None, None)
    return out


def test_hosts_equal_all_pairs(spark):
    rnd = random.Random(3)
    spans, children = [], []
    for i in range(600):
        t0 = rnd.randrange(40_000)
        spans.append((rnd.choice("xy"), f"s{i}", rnd.choice([None, i % 150]), i, i % 97 == 5 and t0 > 20_000, rnd.randrange(4), t0, t0 + rnd.choice([-1, 0, 0, 40, 900, 9000])))
    for i in range(300):
        children.append((rnd.choice("xyz"), i, rnd.choice([None, None, rnd.randrange(300)]), rnd.choice([None, rnd.randrange(60_000), rnd.choice(spans)[6], rnd.choice(spans)[7]])))
    a = spark.createDataFrame(children, "key string, child long, call_id long, t long").withColumn("note", F.lit("kept"))
    b = spark.createDataFrame(spans, "key string, id string, call_id long, place long, spawns boolean, depth long, t0 long, t1 long")
    got = attach_spans(a, b, ["key"]).collect()
    assert {r.child: (r.host, r.how) for r in got} == plain_hosts(children, spans) and len(got) == 300 and got[0].note == "kept"
    assert {r.how for r in got} == {"id", "spawn", "enclosing", None}
    assert attach_spans(a, b.limit(0), ["key"]).filter("host IS NOT NULL").count() == 0


def test_innermost_holds_only_what_is_open(spark):
    """A long shallow-to-deep run: ended spans under a deep open one do not change the answer; repeated points stay."""
    spans = [("k", 0, 0, 9, 0, 10_000)] + [("k", i, i, i % 3, i, i + 1) for i in range(1, 5000)]
    points = [("k", 7000, "a"), ("k", 7000, "a"), ("k", 10_000, "b"), ("k", 10_001, "c"), ("k", None, "d")]
    b = spark.createDataFrame(spans, "key string, id long, place long, depth long, t0 long, t1 long")
    got = innermost(spark.createDataFrame(points, "key string, t long, tag string"), b, ["key"], "host").collect()
    assert sorted((r.tag, r.host) for r in got if r.host is not None) == [("a", 0), ("a", 0), ("b", 0)] and len(got) == 5
