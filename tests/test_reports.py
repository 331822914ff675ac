"""Command families, and report operators on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomspan.functions import families
from loomspan.operators import reports

# command, family, kind: shapes of our own
SHAPES = [
    ("pnpm -C web run lint -- --fix", "pnpm run lint", "lint"), ("cd x && FOO=1 npm t", "npm test", "test"), ("yarn", "yarn install", "install"), ("sudo timeout 600 cargo build --release", "cargo build", "build"),
    ("python3 -m pytest -q tests", "pytest", "test"), ("node scripts/run.js", "node run.js", "other"), ("git status | head -3", "git status", "vcs"), ("cat a.txt | wc -l", "cat", "other"), ("export A=1; cd b", "sh", "other"),
    ("npx tsc --noEmit", "tsc", "typecheck"), ("npx prettier@3 --write .", "prettier", "lint"), ("gh pr checks 12", "gh pr checks", "ci"), ("/usr/bin/curl -s http://x", "curl", "net"), ("sleep 30", "sleep", "wait"), ("./gradlew assemble", "gradlew assemble", "other"),
    ("uv run pytest", "pytest", "test"), ("npx playwright-mcp", "playwright-mcp", "other"), ("docker build .", "docker build", "build"),
]


def test_families_and_kinds(spark):
    df = spark.createDataFrame(SHAPES, "c string, f string, k string").select("c", "f", "k", families.family(F.col("c")).alias("got"), families.kind(F.col("f")).alias("kind"))
    assert [(r.c, r.got, r.kind) for r in df.collect()] == SHAPES


def test_tool_kinds(spark):
    df = spark.createDataFrame([("Read",), ("mcp__x__y",), ("WebFetch",), ("Task",), ("BashOutput",), ("AskUser",), ("zzz",)], "t string")
    assert [r[0] for r in df.select(families.tool_kind(F.col("t"))).collect()] == ["file", "mcp", "web", "agent", "wait", "user", "other"]


def test_billing_first_conclusive_evidence(spark):
    rows = [(1, "process", 1, "plan"), (1, "session", 9, "api"), (2, "session", 1, "unknown"), (3, "session", 5, "metered"), (3, "session", 2, "plan")]
    got = reports.billing_mode(spark.createDataFrame(rows, "session long, source string, t_ms long, mode string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "api"), (2, "unknown"), (3, "plan")]


def test_process_links_and_commit_costs(spark):
    sessions = spark.createDataFrame([("s1", 10, "/a", 1000), ("s2", None, "/b", 5000), ("s3", None, "/b", 9000)], "session string, pid long, cwd string, start_ms long")
    processes = spark.createDataFrame([(10, "/zzz", 0), (11, "/b", 8500), (12, "/b", 200_000)], "pid long, cwd string, start_ms long")
    assert sorted((r.pid, r.session) for r in reports.link_processes(processes, sessions).collect()) == [(10, "s1"), (11, "s3"), (12, None)]
    costs = spark.createDataFrame([(1, 6.0), (2, None), (3, 4.0)], "session long, cost double")
    commits = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (2, "d", True)], "session long, sha string, counted boolean")
    assert [(r.commits, r.cost_per_commit) for r in reports.cost_per_commit(costs, commits).orderBy("session").collect()] == [(2, 3.0), (1, None), (0, None)]


def test_rooms_and_visibility(spark):
    rows = [("Acme/web", True, False, 5, 1, 9.0), ("acme/api/v2", True, False, 5, 1, 8.0), ("acme/web", True, True, 5, 1, 7.0), ("acme/web", True, False, 0, 1, 6.0), ("other/x", True, False, 5, 1, 5.0), ("acme/web", False, False, 5, 1, 4.0)]
    df = spark.createDataFrame(rows, "repo string, shared boolean, paused boolean, started long, shared_since long, cost double")
    assert [r.cost for r in reports.room_rows(df, ["acme/*"], ["cost"]).collect()] == [9.0]
    assert sorted(r.cost for r in reports.room_rows(df, ["acme/**"], ["repo", "cost"]).collect()) == [8.0, 9.0]
    skills = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0), ("d", 8.0)], "name string, usd double")
    modes = spark.createDataFrame([("b", "name"), ("c", "omit"), ("d", "omit")], "name string, mode string")
    assert sorted((r.name, r.usd) for r in reports.visibility(skills, modes).collect()) == [("(hidden)", 12.0), ("a", 1.0), ("b", None)]


def test_fuzzy_order(spark):
    df = spark.createDataFrame([("open project",), ("people in rome",), ("xopx",), ("prep",)], "t string")
    assert [r.t for r in reports.fuzzy(df, "t", "op").collect()][0] == "open project"
    assert {r.t for r in reports.fuzzy(df, "t", "op").collect()} == {"open project", "people in rome", "xopx"}


@pytest.mark.parametrize("now,want", [(5, [("x", 2, 2, 5)]), (50, [("x", 1, 1, 40)]), (86_400_011, [])])
def test_contention(spark, now, want):
    spans = spark.createDataFrame([("x", 1, 0, 20), ("x", 2, 1, 6), ("x", 3, 10, None)], "k string, session long, t0 long, t1 long")
    assert [tuple(r) for r in reports.contention(spans, "k", now).collect()] == want


ADVICE_LOADS = "session string, name string, trigger string, t long, end long, size long, usd double, tail_usd double, carry_usd double, reloaded boolean, n int, stub boolean, hash string, host string"


def test_advice_by_its_rules(spark):
    """A4 leaves the carry out, A6 shares the listing, A3 takes single loads only, A10 no stubs and nothing old."""
    day = 86_400_000
    rows = [(f"s{i}", "lost", "model", day * 20 + i, None, 10, 5.0, 0.0, 2.0, True, 1, False, "h", "a") for i in range(3)]
    rows += [(s, "twice", "model", day * 20 + t, None, 10, 1.0, 0.0, 0.0, False, n, False, "h", "a") for s in ("s1", "s2", "s3") for t, n in ((1, 1), (2, 1 if s != "s3" else 2))]
    rows += [("s1", "drift", "model", day * 20, 1, 10, 0.0, 0.0, 0.0, False, 1, False, "h1", "a"), ("s2", "drift", "model", day * 20, 1, 10, 0.0, 0.0, 0.0, False, 1, False, "h2", "b")]
    rows += [("s3", "same", "model", day * 20, 1, 10, 0.0, 0.0, 0.0, False, 1, False, "h1", "a"), ("s3", "same", "model", day * 21, 1, 10, 0.0, 0.0, 0.0, False, 1, True, "h9", "a"), ("s4", "same", "model", day * 20, 1, 10, 0.0, 0.0, 0.0, False, 1, False, "h1", "b")]
    rows += [("s1", "(listing)", "model", 0, None, 10, 8.0, 0.0, 0.0, False, 1, False, None, "a")]
    listed = spark.createDataFrame([("lost",), ("twice",), ("never",), ("nor this",)], "name string")
    loads = spark.createDataFrame(rows, ADVICE_LOADS)
    found = {(r.advice, r.name): r.severity for r in reports.advice(loads, listed, 15, now_ms=day * 22).collect()}
    assert found == {("A4", "lost"): 18.0, ("A3", "twice"): 4.0, ("A6", "never"): 4.0, ("A6", "nor this"): 4.0, ("A10", "drift"): 0.0}
    late = {r.advice for r in reports.advice(loads, listed, 15, now_ms=day * 40).collect()}
    assert late == {"A3", "A4", "A6"}
    assert reports.advice(loads.limit(0), listed.limit(0), 1).count() == 0
