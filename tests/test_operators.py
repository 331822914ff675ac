"""Activity operators against brute force on seeded and hand-made data."""

from __future__ import annotations

import random
from datetime import date, datetime
from statistics import median

import pytest
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators import aggregate, contrast, cost, intervals, ownership, rules, skills


def values(spark, column, **inputs):
    schema = ", ".join(f"{k} {'string' if isinstance(v[0], str) else 'long'}" for k, v in inputs.items())
    return [r[0] for r in spark.createDataFrame(list(zip(*inputs.values())), schema).select(column).collect()]


def test_scalars(spark):
    assert values(spark, S.bucket(F.col("ms")), ms=[0, 9, 10, 24, 25, 1799999, 1800000]) == [0, 0, 1, 1, 2, 14, 15]
    assert values(spark, S.duration_label(F.col("ms")), ms=[5, 30, 2600, 70000]) == ["<10ms", "≥25ms", "≥2.5s", "≥1m"]
    assert values(spark, S.mcp_server(F.col("t")), t=["mcp__files__read", "bash"]) == ["files", ""]
    assert values(spark, S.extension(F.col("p")), p=["a/b.Py", "a.b/c", ".bashrc", "x.tar.gz"]) == ["py", "", "", "gz"]
    assert values(spark, S.program(F.col("c")), c=["cd x && FOO=1 sudo /usr/bin/make -j", "export A=b; pytest -q | tail", "cd only"]) == ["make", "pytest", ""]
    assert values(spark, S.exit_code(F.col("o")), o=["Exit code: 3\n", "exited with code 0", "fine"]) == [3, 0, None]
    assert values(spark, S.remote_identity(F.col("u")), u=["git@Host.com:o/r.git", "https://user:pw@host.com/o/r/", "ssh://git@host.com:22/o/r.git"]) == ["host.com/o/r"] * 3
    assert values(spark, S.model_id(F.col("m")), m=["openai/Gpt-9", "eu.anthropic.some-1-v2:0", "some@20250101", "x-20250101", "deep-v3"]) == ["gpt-9", "some-1", "some", "x", "deep-v3"]
    commands = ["git stash", "git stash list", "cd a && git reset --hard HEAD", "git -C x clean -fd", "git checkout main", "git checkout -b new", "git checkout a.txt", "git switch main", "git restore .", "ls"]
    assert values(spark, S.clobber_form(F.col("c")), c=commands) == ["git stash", "", "git reset --hard", "git clean -f", "git checkout <branch>", "", "", "git switch <branch>", "git restore .", ""]
    assert values(spark, S.commit_shas(F.col("o")), o=["[main abc1234] msg\n[x (root-commit) def5678] m"]) == [["abc1234", "def5678"]]
    assert values(spark, S.fill(F.col("t"), a=F.lit(1)), t=["x {a} {b}"]) == ["x 1 {b}"]
    patch = "*** Begin Patch\n*** Update File: a.py\n+x\n+y\n-z\n*** Add File: b.md\n+1\n*** End Patch"
    assert values(spark, S.patch_changes(F.col("p")), p=[patch]) == [[("a.py", 2, 1), ("b.md", 1, 0)]]
    assert values(spark, S.redact(F.col("t")), t=['token = "abcdefgh12" me@x.org /home/joe/x 10.0.0.1']) == ['token = "***" user@example.com /home/user/x 0.0.0.0']


def test_chi_square(spark):
    rows = [(30, 100, 10, 100), (0, 0, 5, 10), (5, 10, 5, 10)]
    got = [r[0] for r in spark.createDataFrame(rows, "a int, A1 int, b int, B1 int").select(contrast.chi_square(F.col("a"), F.col("A1"), F.col("b"), F.col("B1"))).collect()]
    n, x = 200, max(0, abs(30 * 90 - 10 * 70) - 100)
    assert got[0] == pytest.approx(n * x * x / (40 * 160 * 100 * 100)) and got[1] == 0 and got[2] == 0
    assert contrast.guard(0, 5) == "empty selection" and contrast.guard(5, 0) == "empty baseline" and contrast.guard(5, 9) == "small" and contrast.guard(50, 9) == ""


def spans(spark, seed, n=200):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.randrange(0, 20_000)
        rows.append((f"g{rnd.randrange(3)}", i, t, t + rnd.choice([0, 5, 50, 700, 3000])))
    return rows, spark.createDataFrame(rows, "g string, id long, t0 long, t1 long")


@pytest.mark.parametrize("seed,bucket", [(1, 1000), (2, 333), (3, 10**9)])
def test_overlap_against_brute_force(spark, seed, bucket):
    rows, df = spans(spark, seed)
    got = {r.g: r for r in intervals.overlap(df, "g", "id", bucket, least=2).collect()}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g and r[3] > r[2]]
        times = sorted({t for r in own for t in r[2:]})
        count = lambda t: sum(r[2] <= t < r[3] for r in own)
        at2 = sum(b - a for a, b in zip(times, times[1:]) if count(a) >= 2)
        at3 = sum(b - a for a, b in zip(times, times[1:]) if count(a) >= 3)
        peak = max(count(t) for t in times)
        covered = [(sum(b - a for a, b in zip(times, times[1:]) if r[2] <= a < r[3] and count(a) >= 2), r[3] - r[2]) for r in own]
        over, alone = [n for c, n in covered if 2 * c >= n], [n for c, n in covered if 2 * c < n]
        r = got[g]
        assert (r.calls, r.peak, r.at_least_2_ms, r.at_least_3_ms, r.over) == (len(own), peak, at2, at3, len(over))
        assert r.peak_at == min(t for t in times if count(t) == peak)
        assert r.over_p50 == (median(over) if over else None) and r.alone_p50 == (median(alone) if alone else None)


def test_union_runs_deltas(spark):
    rows, df = spans(spark, 5)
    got = {r.g: r.union_ms for r in intervals.union_length(df, ["g"]).collect()}
    for g in got:
        assert got[g] == len({t for r in rows if r[0] == g for t in range(r[2], r[3])})
    seq = spark.createDataFrame([(1, i, x) for i, x in enumerate("aabbbca")], "k int, i int, x string")
    assert sorted((r.x, r["first"], r.length) for r in intervals.runs(seq, ["k"], ["i"], ["x"]).collect()) == [("a", 1, 2), ("a", 7, 1), ("b", 3, 3), ("c", 6, 1)]
    counters = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 15, 5), (1, 3, 4, 9), (1, 4, 6, 9)], "k int, i int, a int, b int")
    assert [(r.a_delta, r.b_delta) for r in intervals.counter_deltas(counters, ["k"], ["i"], ["a", "b"]).orderBy("i").collect()] == [(10, 5), (5, 0), (4, 9), (2, 0)]


def test_active_minutes_pause_of_exactly_the_gap(spark):
    m = 60_000
    rows = spark.createDataFrame([(1, 0), (1, 5 * m), (1, 10 * m + 1), (2, 59_999)], "s int, t_ms long")
    got = sorted((r.s, r.first_minute, r.end_minute) for r in intervals.active_minutes(rows, ["s"]).collect())
    assert got == [(1, 0, 6), (1, 10, 11), (2, 0, 1)]


def test_lanes_never_overlap(spark):
    rows, df = spans(spark, 6, 80)
    got = [r for r in intervals.lanes(df.filter("t1 > t0"), ["g"]).collect()]
    for a in got:
        for b in got:
            if a.id < b.id and (a.g, a.lane) == (b.g, b.lane):
                assert a.t1 <= b.t0 or b.t1 <= a.t0
    for g in {r.g for r in got}:
        own = [r for r in got if r.g == g]
        assert max(r.lane for r in own) + 1 == max(sum(x.t0 <= r.t0 < x.t1 for x in own) for r in own)


def test_conflicts(spark):
    w = spark.createDataFrame([(1, 0, "T", "f"), (2, 500, "T", "f"), (3, 900, "U", "f"), (4, 5000, "T", "f"), (1, 100, "T", "g")], "session long, t_ms long, top string, rel string")
    none = spark.createDataFrame([], "parent long, child long, t0 long, t1 long")
    got = sorted((r.a_session, r.b_session, r.mark, r.race) for r in intervals.conflict_marks(w, none, 1000).collect())
    assert got == [(1, 2, "conflict", False), (1, 3, "overlap", False), (2, 3, "overlap", False)]
    told = spark.createDataFrame([(1, 2, 200, 300), (1, 3, 0, 1000)], "parent long, child long, t0 long, t1 long")
    got = sorted((r.a_session, r.b_session, r.mark, r.race) for r in intervals.conflict_marks(w, told, 1000).collect())
    assert got == [(1, 3, "overlap", True), (2, 3, "overlap", False)]  # 1 wrote outside 2's interval: delegation


def test_minus_clamps_and_drops(spark):
    calls = spark.createDataFrame([(1, "a", 5, False), (2, "a", 15, True), (3, "b", None, None)], "session long, tool string, ms long, err boolean")
    whole, part = aggregate.distributions(calls, ["tool"]), aggregate.distributions(calls.filter("tool = 'b' OR err"), ["tool"])
    got = aggregate.minus(whole, part).collect()
    assert [(r.dim, r.value, r.n, r.errors, r.hist[:3]) for r in got] == [("tool", "a", 1, 0, [1, 0, 0])]


def test_price_resolution(spark):
    prices = spark.createDataFrame(
        [("built-in", None, "opus", 15.0, 75.0, None, None, None, None), ("built-in", None, "opus-4", 5.0, 25.0, None, None, None, None), ("user", None, "opus-4-x", 1.0, 1.0, None, None, None, None), ("gateway", "gw", "opus-4", 9.0, 9.0, None, None, None, None),
         ("alias", None, "mine", None, None, None, None, None, "opus-4"), ("community", None, "opus", 14.0, 70.0, None, None, None, None), ("user", None, "mine-own", 2.0, 2.0, None, None, None, None)],
        cost.PRICE_SCHEMA,
    )
    models = [("opus-3", ""), ("prov/opus-4-20250101", ""), ("opus-4-x-1", "gw"), ("opus-4", "gw"), ("mine", ""), ("mine-own-2", ""), ("other", "")]
    got = {(r.model, r.provider): (r.layer, r.input) for r in cost.resolve_prices(spark.createDataFrame(models, "model string, provider string"), prices).collect()}
    assert got == {("opus-3", ""): ("community", 14.0), ("prov/opus-4-20250101", ""): ("built-in", 5.0), ("opus-4-x-1", "gw"): ("user", 1.0), ("opus-4", "gw"): ("gateway", 9.0), ("mine", ""): ("alias", 5.0), ("mine-own-2", ""): ("user", 2.0)}


def test_price_tiers_and_variants(spark):
    """Tiers hang on the entry found; the user's win, a user's own entry has only the user's; an alias takes its target's tiers."""
    listed = [("built-in", None, "m", 1.0), ("built-in", None, "m>200k", 2.0), ("built-in", None, "m@2027", 3.0), ("community", None, "n", 4.0), ("built-in", None, "n>200k", 5.0), ("user", None, "n@2027", 6.0), ("user", None, "n@2027>200k", 7.0),
        ("user", None, "u", 8.0), ("community", None, "u>200k", 9.0), ("gateway", "g", "m", 10.0), ("gateway", "h", "m>200k", 11.0), ("built-in", None, "gemini-9", 12.0)]
    prices = spark.createDataFrame([(*r, 1.0, None, None, None, None) for r in listed] + [("alias", None, "a", None, None, None, None, None, "m")], cost.PRICE_SCHEMA)
    want = {("m", ""): ("built-in", "m", 1.0), ("m>200k", ""): ("built-in", "m>200k", 2.0), ("m@2027", ""): ("built-in", "m@2027", 3.0), ("m@2027>200k", ""): ("built-in", "m@2027", 3.0), ("n>200k", ""): ("built-in", "n>200k", 5.0),
        ("n@2027", ""): ("user", "n@2027", 6.0), ("n@2027>200k", ""): ("user", "n@2027>200k", 7.0), ("u>200k", ""): ("user", "u", 8.0), ("m>200k", "g"): ("gateway", "m", 10.0), ("a>200k", ""): ("alias", "a", 2.0),
        ("gemini-9-preview", ""): ("built-in", "gemini-9", 12.0), ("gemini-9-lite", ""): None, ("gemini-9", ""): ("built-in", "gemini-9", 12.0)}
    found = cost.resolve_prices(spark.createDataFrame(list(want), "model string, provider string"), prices).collect()
    assert {(r.model, r.provider): (r.layer, r.prefix, r.input) for r in found} == {k: v for k, v in want.items() if v}


def test_cost_view(spark):
    prices = spark.createDataFrame([("user", None, "m", 10.0, 20.0, None, None, None, None)], cost.PRICE_SCHEMA)
    rows = [("m1", "", 1_000_000, 0, 0, 0, 0, 0.0), ("m1", "", 0, 0, 1_000_000, 1_000_000, 1_000_000, 0.0), ("m1", "", 5, 5, 5, 5, 5, 7.5), ("z", "", 5, 5, 5, 5, 5, 0.0)]
    df = spark.createDataFrame(rows, "model string, provider string, input long, output long, cache_read long, write_5m long, write_1h long, usd_reported double")
    got = [(r.cost, r.price_source) for r in cost.priced(df, prices).orderBy("model", F.col("usd_reported"), F.col("input").desc()).collect()]
    assert got == [(10.0, "user"), (pytest.approx(1 + 12.5 + 20), "user"), (7.5, "reported"), (None, None)]


def test_ownership_order(spark):
    rows = [("m", 10, False, False, False, False, "b", 1), ("m", 10, True, False, False, False, "a", 2), ("m", 9, True, True, True, True, "z", 3), ("n", 5, False, False, False, False, "b", 4), ("n", 5, False, False, False, False, "a", 5)]
    df = spark.createDataFrame(rows, "msg string, order_key long, is_sub boolean, is_fork boolean, is_background boolean, not_home boolean, path string, tokens long")
    assert sorted((r.msg, r.path, r.tokens) for r in ownership.owned(df, ["msg"], ownership.MESSAGE_ORDER).collect()) == [("m", "z", 3), ("n", "a", 5)]


def test_commits(spark):
    sha = {c: c * 40 for c in "abcd"}
    commits = spark.createDataFrame([("r", sha[c], t) for c, t in zip("abcd", (100, 200, 300, 400))], "repo string, sha string, at_ms long")
    sessions = spark.createDataFrame([(1, "r", 0, 1000), (2, "r", 250, 350)], "session long, repo string, w0 long, w1 long")
    calls = spark.createDataFrame([(2, "r", 190, 210)], "session long, repo string, t0 long, t1 long")
    banners = spark.createDataFrame([(1, "aaaaaaa")], "session long, short string")
    got = sorted((r.sha[0], r.session, r.how, r.counted) for r in ownership.attribute_commits(commits, sessions, calls, banners).collect())
    assert got == [("a", 1, "observed", True), ("b", 2, "observed", True), ("c", 1, "shared", False), ("c", 2, "shared", False), ("d", 1, "reflog", False)]


def test_reflog_and_amends(spark):
    rows = [("g", 1, "o1", "s1", "commit", None), ("g", 2, "s1", "s1", "checkout", "dev"), ("g", 3, "s1", "s2", "commit", None), ("g", 4, "s2", "s3", "amend", None)]
    df = spark.createDataFrame(rows, "gitdir string, seq int, old string, sha string, op string, target string")
    assert [r.branch for r in ownership.reflog_branches(df).orderBy("seq").collect()] == [None, "dev", "dev", "dev"]
    assert sorted((r.seq, r.amended) for r in ownership.amended(df).collect()) == [(1, False), (2, False), (3, True), (4, False)]


def test_skill_attribution(spark):
    requests = spark.createDataFrame([(1, 1, 10, 0, 100, 0, 110), (1, 2, 5, 100, 60, 0, 165), (1, 3, 20, 0, 0, 0, 20)], "session long, seq long, input long, cache_read long, write_5m long, write_1h long, context long")
    loads = spark.createDataFrame([(1, "a", 1, 80.0), (1, "b", 2, 100.0)], "session long, name string, seq long, size double")
    got = [(r.seq, r.name, r.slot, r.tokens) for r in ownership.attribute_skills(requests, loads).orderBy("seq", "slot", "name").collect()]
    assert got == [(1, "a", "load", 80.0), (2, "a", "carry", 80.0), (2, "b", "load", 55.0)]  # growth 55 bounds b; the drop at 3 ends both


def test_rules(spark):
    held = rules.Rule("x", "tool_calls", ">=", degraded=3, critical=5, hold_s=10)
    m = rules.Machine(held)
    assert [m.step(v, t) for v, t in ((3, 1), (3, 5_000), (3, 10_001), (6, 11_000), (6, 21_000), (None, 22_000))] == [None, None, "fire", None, "escalate", "resolve"]
    samples = [(s, t * 1000, rnd) for s in (1, 2) for t, rnd in enumerate([1, 3, 6, None, 6, 3, 0])]
    df = spark.createDataFrame(samples, "session long, t_ms long, value long")
    now = rules.Rule("x", "tool_calls", ">=", degraded=3, critical=5)
    got = [(r.t_ms // 1000, r.state) for r in rules.transitions(df, now).filter("session = 1").orderBy("t_ms").collect()]
    assert got == [(1, "fire"), (2, "escalate"), (3, "resolve"), (4, "fire"), (5, "deescalate"), (6, "resolve")]
    slow = rules.Rule("x", "tool_calls", ">=", degraded=3, hold_s=1)
    got = [(r.t_ms // 1000, r.state) for r in rules.transitions(df, slow).filter("session = 2").orderBy("t_ms").collect()]
    assert got == [(2, "fire"), (3, "resolve"), (5, "fire"), (6, "resolve")]
    with pytest.raises(ValueError):
        rules.Rule("bad", "nothing", degraded=1)
    assert [r.id for r in rules.merge_rules([rules.Rule("loop", "repeat_run", critical=9)])][2] == "loop" and rules.merge_rules([rules.Rule("loop", "repeat_run", critical=9)])[2].critical == 9
    alerts = rules.transitions(df, now).filter("session = 1")
    assert [r.t_ms // 1000 for r in rules.throttled(alerts, 2).orderBy("t_ms").collect()] == [1, 4]
    steady = spark.createDataFrame([(1, "r", t * 20_000, "fire") for t in range(1, 8)], "session long, rule string, t_ms long, state string")
    assert [r.t_ms // 1000 for r in rules.throttled(steady, 30).orderBy("t_ms").collect()] == [20, 60, 100, 140]


def test_patch_and_time_zone(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "b"), (3, "c"), (4, "d")], "k int, v string")
    assert sorted((r.k, r.change) for r in ownership.changes(old, new, ["k"]).collect()) == [(1, "remove"), (3, "upsert"), (4, "upsert")]
    rows = spark.createDataFrame([(date(2024, 1, 1), 1), (date(2024, 1, 1), 23)], "day date, hour long")
    assert [(r.day, r.hour) for r in ownership.shifted(rows, -2).orderBy("day", "hour").collect()] == [(date(2023, 12, 31), 23), (date(2024, 1, 1), 21)]
    assert datetime(2024, 1, 1)


def test_lanes_in_parts_and_batches(spark):
    """Long spans over many batches, null keys, equal spans and gaps: as packed by hand in order."""
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None]), i, t, t + rnd.choice([0, 3, 40, 400])) for i in range(600) for t in [rnd.randrange(3000)]] + [("c", 900, 5, 5), ("c", 901, 5, 5)]
    df = spark.createDataFrame(rows, "g string, id long, t0 long, t1 long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.id: r.lane for r in intervals.lanes(df, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for g in ("a", "b", "c", None):
        ends: list[int] = []
        for _, i, t0, t1 in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[3], r[1])):
            n = next((k for k, e in enumerate(ends) if e <= t0), len(ends))
            ends[n:n + 1] = [t1]
            want[i] = n
    assert got == want
    assert intervals.lanes(df.limit(0), ["g"]).columns == ["g", "id", "t0", "t1", "lane"] and intervals.lanes(df.limit(0), ["g"]).count() == 0


@pytest.mark.parametrize("op", [">=", "<"])
def test_hold_times_against_the_machine(spark, op):
    rnd = random.Random(9)
    samples = [(s, t * 1000, rnd.choice([None, 0.0, 2.0, 4.0, 6.0])) for s in range(5) for t in sorted(rnd.sample(range(1, 400), 120))]
    df = spark.createDataFrame(samples, "session long, t_ms long, value double")
    for rule in (rules.Rule("x", "tool_calls", op, degraded=3, critical=5, hold_s=6), rules.Rule("x", "tool_calls", op, critical=3, hold_s=2)):
        got = sorted((r.session, r.t_ms, r.from_level, r.to_level, r.state) for r in rules.transitions(df, rule).collect())
        want, machines = [], {}
        for s, t, v in samples:
            m = machines.setdefault(s, rules.Machine(rule))
            was = m.level
            state = m.step(v, t)
            if state:
                want.append((s, t, was, m.level, state))
        assert want and got == sorted(want)


def test_skill_attribution_over_batches(spark):
    """Several loads of one request, a load whose request is not there, sessions dealt together: as for each session alone."""
    requests = spark.createDataFrame([(s, q, 10, 40 * q, 60, 0, 40 * q + 70) for s in (1, 2, 3) for q in range(1, 9)], "session long, seq long, input long, cache_read long, write_5m long, write_1h long, context long")
    loads = spark.createDataFrame([(s, n, q, 15.0) for s in (1, 2, 3) for n, q in (("b", 2), ("a", 2), ("lost", 20), ("c", 5))], "session long, name string, seq long, size double")
    whole = lambda r, x: sorted((v.session, v.seq, v.name, v.slot, v.tokens) for v in ownership.attribute_skills(r, x).collect())
    got = whole(requests, loads)
    assert got == sorted(v for s in (1, 2, 3) for v in whole(requests.filter(f"session = {s}"), loads.filter(f"session = {s}")))
    assert [(v[1], v[2]) for v in got if v[0] == 1 and v[3] == "load"] == [(2, "a"), (2, "b"), (5, "c")] and sum(v[3] == "carry" for v in got if v[0] == 1) == 6 * 2 + 3


def test_results_by_id_then_by_place(spark):
    calls = spark.createDataFrame([("s", 1, "x"), ("s", 2, None), ("s", 3, "y"), ("s", 4, "x"), (None, 1, None), ("t", 1, "z")], "session string, seq long, call string")
    results = spark.createDataFrame([("s", 10, "y", 1), ("s", 11, "x", 2), ("s", 12, None, 3), ("s", 13, "gone", 4), (None, 14, None, 5)], "session string, seq long, call string, took long")
    got = {(r.session, r.seq): r.result_took for r in intervals.pair_results(calls, results, ["session"], "seq", "call").collect()}
    assert got == {("s", 1): 2, ("s", 2): 3, ("s", 3): 1, ("s", 4): 4, (None, 1): 5, ("t", 1): None}
    placed = {(r.session, r.seq): r.result_took for r in intervals.pair_results(calls.drop("call"), results.drop("call"), ["session"], "seq").collect()}
    assert placed == {("s", 1): 1, ("s", 2): 2, ("s", 3): 3, ("s", 4): 4, (None, 1): 5, ("t", 1): None}


def test_overlapping_pairs(spark):
    rows, df = spans(spark, 11, 60)
    for bucket in (100, 4000):
        got = [(r.g, r.id, r.other) for r in intervals.overlapping_pairs(df, ["g"], "id", bucket_ms=bucket).collect()]
        assert sorted(got) == sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] <= b[3] and b[2] <= a[3])


@pytest.mark.parametrize("short,k", [(1, 3), (4, 3), (200, 5)])
def test_first_overlapping(spark, short, k):
    """Those that the first few of a key decide, and those that ask the intervals of time, by brute force; also points, and equal times."""
    rows, df = spans(spark, 12, 60)
    rows = [*rows, *((r[0], 1000 + i, r[2], r[2]) for i, r in enumerate(rows[:8])), ("lone", 2000, 5, 9)]
    df = spark.createDataFrame(rows, df.schema)
    got = [(r.g, r.id, r.other, r["rank"]) for r in intervals.first_overlapping(df, ["g"], "id", F.struct(F.col("id") % 7, "id"), k, short=short, salts=3).collect()]
    want = []
    for a in rows:
        met = sorted((b[1] % 7, b[1]) for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] <= b[3] and b[2] <= a[3])
        want += [(a[0], a[1], b, n + 1) for n, (_, b) in enumerate(met[:k])]
    assert sorted(got) == sorted(want)


def test_conflicts_move_writes_and_not_pairs(spark):
    """Pairs can be many more than writes: nothing is dealt out by both their sessions; equal writes and a parent told twice change no pair."""
    w = spark.createDataFrame([(1, 0, "T", "f"), (1, 0, "T", "f"), (2, 500, "T", "f"), (2, 500, "U", "f"), (3, 500, "T", "f")], "session long, t_ms long, top string, rel string")
    told = spark.createDataFrame([(1, 2, 0, 900), (1, 2, 600, 900), (3, 2, 0, 900), (2, 3, 500, 500)], "parent long, child long, t0 long, t1 long")
    made = intervals.conflict_marks(w, told, 1000)
    assert "b_session" not in "".join(x for x in made._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
    got = sorted((r.a_session, r.b_session, r.mark, r.race) for r in made.collect())
    assert got == [(1, 2, "conflict", True), (1, 2, "overlap", True), (1, 3, "conflict", False), (2, 3, "conflict", True), (2, 3, "overlap", True)]


def test_skill_comparison_and_top_files(spark):
    a = spark.createDataFrame([("s", i, 1.0) for i in range(15)] + [("t", 1, 2.0)], "name string, session long, usd double")
    b = spark.createDataFrame([("s", i, 1.0) for i in range(3)], "name string, session long, usd double")
    many, few = spark.range(25).withColumnRenamed("id", "session"), spark.range(5).withColumnRenamed("id", "session")
    got = {r.name: r for r in contrast.compare_skills(a, b, many, many).collect()}
    n, x = 50, abs(15 * 22 - 3 * 10) - 25
    assert got["s"].chi2 == pytest.approx(n * x * x / (18 * 32 * 25 * 25)) and (got["t"].loads_a, got["t"].loads_b, got["t"].usd_a, got["t"].sessions_b) == (1, 0, 2.0, 0)
    assert [r.chi2 for r in contrast.compare_skills(a, b, many, few).collect()] == [None, None]
    files = spark.createDataFrame([("a", 2), ("b", 5), ("c", 2), (None, 9), ("", 1)], "file string, n long")
    assert [(r.file, r.n) for r in aggregate.top_files(files, 2).collect()] == [("b", 5), ("a", 2), ("", 10)]


LOADS = "session long, name string, trigger string, turn long, t long, turn_end long, end long, size long, hash string, usd double, tail_usd double, carry_usd double"


def test_skill_metrics_and_sizes(spark):
    """An end at the time of a load comes first; a load that is not ended stays open; unknown sizes take the text's median, then the name's."""
    rows = spark.createDataFrame([
        (1, "a", "model", 0, 0, 5, 10, 100, "x", 1.0, 0.5, 0.25), (1, "a", "model", 0, 10, 15, None, None, "x", 1.0, 0.5, 0.25), (1, "a", "user", 1, 20, None, None, 300, "y", 1.0, 0.5, 0.5),
        (2, "b", "model", 0, 0, 5, 9, None, None, 1.0, 0.5, 0.125), (2, "a", "model", 0, 1, 5, 9, None, None, 1.0, 0.5, 0.125), (3, "a", "model", 0, 1, 5, 9, 500, "z", None, None, None),
    ], LOADS)
    contexts = spark.createDataFrame([(1, 200), (2, 100)], "session long, context_tokens long")
    found = {r.session: (r.skill_reloads, r.skill_carry_usd, r.skill_context_share) for r in skills.skill_metrics(rows, contexts).collect()}
    assert found == {1: (2, 1.0, 1.0), 2: (1, 0.125, None), 3: (1, None, None)}
    sizes = {(r.session, r.name, r.t): (r["size"], r.guessed) for r in skills.sizes_filled(rows).collect()}
    assert sizes == {(1, "a", 0): (100, False), (1, "a", 10): (100, True), (1, "a", 20): (300, False), (2, "b", 0): (None, False), (2, "a", 1): (300, True), (3, "a", 1): (500, False)}
    empty = rows.limit(0)
    calls = spark.createDataFrame([], "session long, t_ms long, err boolean, is_test boolean, is_commit boolean")
    assert skills.skill_metrics(empty, contexts).count() == skills.overlaps(empty, 1).count() == skills.idle_loads(empty, calls, 1).count() == skills.version_changes(empty, 1).count() == 0


def test_idle_loads_borders(spark):
    """A call at the load's own time is before it, one at the end of the turn after it; sessions without calls are not judged."""
    rows = [(s, "a", "model", 0, 100, 200, None, 1, "x", 2.0, 0.0, 0.0) for s in (1, 2, 3, 4)] + [(1, "a", "model", 1, 300, None, None, 1, "x", 2.0, 0.0, 0.0)]
    calls = spark.createDataFrame([(1, 100), (1, 200), (2, 101), (3, 199), (5, 150)], "session long, t_ms long")
    found = skills.idle_loads(spark.createDataFrame(rows, LOADS), calls, 15, share=0.3, least=3).collect()
    assert [(r.name, r.judged, r.idle, r.idle_usd, r.severity) for r in found] == [("a", 3, 1, 2.0, 4.0)]
