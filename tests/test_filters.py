"""Filter semantics on small frames."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from loomspan.plans.filters import CATALOGUE, Filters, clause, day_of, event_rows, glob_pattern, matching_calls, matching_sessions, number, register, resolve_prefix, suggest


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [(1, None, "A/web", 5.0, 0.5), (2, 1, "b", None, None), (3, None, None, 0.0, 0.0), (4, 3, "web-api", 12.0, 0.1)]
    return spark.createDataFrame(rows, "session long, parent long, repo string, cost double, error_rate double")


def ids(df):
    return sorted(r.session for r in df.select("session").distinct().collect())


@pytest.mark.parametrize(
    "made,want",
    [
        (lambda: clause("cost", ">", 2), [1, 4]),
        (lambda: ~clause("cost", ">", 2), [2, 3]),  # unknown matches the negation
        (lambda: clause("cost", "is_not", 5), [3, 4]),  # but no comparison
        (lambda: clause("cost", "is", "unknown"), [2]),
        (lambda: clause("cost", "is_not", "unknown"), [1, 3, 4]),
        (lambda: clause("repo", "~", "WEB"), [1, 4]),
        (lambda: ~clause("repo", "~", "web"), [2, 3]),
        (lambda: clause("repo", "is_one_of", "B", "a/web"), [1, 2]),
        (lambda: clause("subagent", "is", "true"), [2, 4]),
        (lambda: clause("error_rate", ">=", "50%"), [1]),
    ],
)
def test_session_clauses(sessions, made, want):
    assert ids(matching_sessions(sessions, Filters(made()))) == want


def test_call_clauses_hold_on_one_call(spark, sessions):
    calls = spark.createDataFrame(
        [(1, "bash", 5000, True, ["a/x.py"], date(2024, 1, 1)), (1, "edit", 100, False, ["b/y.md", "a/z.py"], date(2024, 1, 2)), (2, "bash", 100, True, [], date(2024, 1, 2)), (4, "bash", None, None, None, date(2024, 1, 1))],
        "session long, tool string, ms long, err boolean, files array<string>, day date",
    )
    both = Filters(clause("tool", "is", "bash"), clause("duration", "<", "1s"))
    assert ids(matching_sessions(sessions, both, calls)) == [2]
    assert ids(matching_calls(calls, Filters(clause("ext", "is", "py")))) == [1]
    assert ids(matching_calls(calls, Filters(clause("ext", "is_not", "py")))) == [2, 4]
    assert ids(matching_calls(calls, Filters(clause("file", "is", "a/*.py")))) == [1]
    assert ids(matching_calls(calls, Filters(clause("status", "is", "unknown")))) == [4]
    assert ids(matching_calls(calls, Filters(clause("day", "is", "yesterday"), clause("tool", "is", "bash")), today=date(2024, 1, 2))) == [1, 4]
    assert ids(matching_calls(calls, Filters(clause("weekday", "is", "tu")))) == [1, 2]
    days = spark.createDataFrame([(1, date(2024, 1, 1), 9), (1, date(2024, 1, 2), 1), (2, date(2024, 1, 2), 9)], "session long, day date, day_tools long")
    busy = Filters(clause("day.tools", ">", 5), clause("tool", "is", "edit"))
    assert ids(matching_sessions(sessions, busy, calls, days)) == []
    assert ids(matching_sessions(sessions, Filters(clause("day.tools", ">", 5)), days=days)) == [1, 2]


def test_literals_and_errors():
    assert number("dur", "2m") == 120_000 and number("tok", "1.5M") == 1.5e6 and number("size", "100KB") == 102_400 and number("ratio", "20%") == 0.2 and number("usd", "$0.50") == 0.5
    for kind, bad in (("ratio", "2"), ("dur", "5"), ("tok", "5x"), ("usd", "much")):
        with pytest.raises(ValueError):
            number(kind, bad)
    with pytest.raises(ValueError, match="did you mean 'tool'"):
        clause("tol", "is", "x")
    with pytest.raises(ValueError):
        clause("cost", "~", "x")
    assert suggest("wekday") == "weekday" and suggest("zzzzzz") is None
    assert day_of("-3d", date(2024, 3, 1)) == "2024-02-27" and day_of("today", date(2024, 3, 1)) == "2024-03-01"
    assert glob_pattern("*.py") == "(?:^|/)[^/]*\\.py$" and glob_pattern("a/**/b?") == "^a/.*/b[^/]$"


def test_algebra():
    a, b = clause("repo", "is_one_of", "x", "y"), clause("repo", "is", "y")
    assert str(Filters(a).add(b)) == "repo is y"
    assert str(Filters(b).include(clause("repo", "is", "z"))) == "repo is_one_of y, z"
    pinned = Filters(a, clause("cost", ">", 1))
    assert str(pinned.effective(Filters(clause("cost", "<", 9)))) == "repo is_one_of x, y and cost < 9"
    assert Filters(a).add(a).clauses == (a,)
    with pytest.raises(ValueError, match="this view has session"):
        Filters(clause("tool", "is", "x")).check(("session",))


def test_extension_and_references(spark, sessions):
    register("double_cost", "session", "num", lambda: F.col("cost") * 2)
    try:
        assert ids(matching_sessions(sessions, Filters(clause("double_cost", ">", 20)))) == [4]
    finally:
        del CATALOGUE["double_cost"]
    refs = spark.createDataFrame([("abcdef12",), ("abcdef99",), ("abc",)], "session string")
    assert resolve_prefix(refs, "abcdef").count() == 2 and resolve_prefix(refs, "abc").count() == 1 and resolve_prefix(refs, "abcd").count() == 0


def test_event_kinds_and_event_clauses(spark):
    rows = [
        ("Bash", "cd x && pytest -q", False), ("Bash", None, None), ("exec_command", "sleep 5", True), ("mcp__Files__read", "", False), ("mcp", "Hub/tool", None), ("mcp", None, None), ("Skill", "a", False),
        ("AskUserQuestion", "", None), ("Task", "", False), ("WebFetch", "", True), ("patch", "", False), ("Grep", "", False), ("Read", "", None), ("TaskOutput", "", False), ("strange", "", False), (None, None, None),
    ]
    calls = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "session long, tool string, argument string, err boolean")
    turns = spark.createDataFrame([(90, "user"), (91, "assistant"), (92, "system")], "session long, role string")
    marks = spark.createDataFrame([(93, ["debug:loop"])], "session long, kinds array<string>")
    events = event_rows(calls, turns, marks)
    got = {r.session: r.kinds for r in events.collect()}
    assert [got[i] for i in range(len(rows))] == [
        ["shell:test"], ["shell:other"], ["shell:wait", "error"], ["mcp:files"], ["mcp:hub"], ["mcp:unknown"], ["skill:load"],
        ["approval"], ["subagent"], ["web", "error"], ["edit"], ["read:search"], ["read"], ["shell:wait"], ["other"], ["other"],
    ]
    assert [got[i] for i in (90, 91, 92, 93)] == [["prompt"], ["reply"], ["meta"], ["debug:loop"]]
    sessions = spark.range(100).withColumnRenamed("id", "session")
    found = lambda *c: sorted(r.session for r in matching_sessions(sessions, Filters(*c), events=events).collect())
    assert found(clause("event.kind", "is", "shell")) == [0, 1, 2, 13] and found(clause("event.kind", "is", "shell:wait")) == [2, 13]
    assert found(clause("event.kind", "is", "error")) == [2, 9] and found(clause("event", "is", "user")) == [90] and found(clause("mcp.server", "is", "files")) == [3]
    assert found(clause("event.kind", "is", "debug")) == [93] and found(clause("shell.family", "is", "pytest")) == [0]
