"""Filters, lifting, distributions, totals, top-k."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from loomspan.functions import families, shell
from loomspan.functions import scalars as S
from loomspan.functions.shell import HEAVY, Rules
from loomspan.operators import aggregate as A
from loomspan.plans.filters import Filters, clause, event_rows, having_text, matching_calls, matching_sessions, session_and_children
from loomspan.queries import LABELS, bucket_sql, quantile_sql, query
from loomspan.sources import tables as T

TODAY = date(2024, 1, 30)
WITH_CALLS = f"WITH {T.CALLS_SQL}"
WITH_BOTH = f"WITH {T.CALLS_SQL}, {T.SESSIONS_SQL}"
DIMS = ["tool", "hour", "weekday"]
ALL_DIMS = [*DIMS, "status", "duration", "out", "model", "program", "command", "file", "ext", "day"]

_PAIRS = {
    "tool": "[tool]", "hour": "[hour::VARCHAR]", "weekday": "[['su', 'mo', 'tu', 'we', 'th', 'fr', 'sa'][weekday + 1]]",
    "status": "[CASE WHEN err IS NULL THEN 'unknown' WHEN err THEN 'error' ELSE 'ok' END]",
    "duration": f"[CASE WHEN ms IS NULL THEN 'unknown' ELSE {LABELS}[{bucket_sql('ms')} + 1] END]",
    "out": "[CASE WHEN out IS NULL THEN 'unknown' WHEN out < 1024 THEN '<1KB' WHEN out < 16384 THEN '≥1KB' WHEN out < 262144 THEN '≥16KB' ELSE '≥256KB' END]",
    "model": "[coalesce(model, 'unknown')]", "program": "list_distinct(programs)", "command": "list_distinct(commands)", "file": "list_distinct(files)",
    "ext": "list_distinct(list_transform(files, lambda f: regexp_extract(f, '\\.([^.]+)$', 1)))", "day": "[day::VARCHAR]",
}


def pairs_sql(source: str, dims: list[str], keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{d}' AS dim, unnest({_PAIRS[d]}) AS value FROM {source}" for d in dims)


def monday_errors(spark, sf_dir):
    return matching_calls(T.calls(spark, sf_dir), Filters(clause("tool", "is", "error"), clause("weekday", "is", "mo")))


@query(f"{WITH_CALLS}, m AS (SELECT * FROM calls WHERE tool = 'error' AND weekday = 1), p AS ({pairs_sql('m', DIMS, 'err')}) SELECT dim, value, count(*) AS n, count(*) FILTER (err) AS errors FROM p GROUP BY ALL")
def f14_filtered_distributions(spark, sf_dir):
    """tool is error and weekday is mo, by tool, hour and weekday."""
    return A.distributions(monday_errors(spark, sf_dir), DIMS).select("dim", "value", "n", "errors")


_HIST = ", ".join(f"count(*) FILTER (ms IS NOT NULL AND {bucket_sql('ms')} = {i})" for i in range(16))


@query(f"{WITH_CALLS}, p AS ({pairs_sql('calls', ALL_DIMS, 'err, ms')}) SELECT dim, value, count(*) AS n, count(*)::DOUBLE AS weight, count(*) FILTER (err) AS errors, max(ms) AS max_ms, concat_ws(',', {_HIST}) AS hist FROM p GROUP BY dim, value")
def a1_distributions(spark, sf_dir):
    """Twelve one-dimensional distributions in one pass."""
    made = A.distributions(T.calls(spark, sf_dir), ALL_DIMS)
    return made.withColumn("hist", F.array_join(F.col("hist").cast("array<string>"), ","))


@query(f"{WITH_CALLS}, p AS ({pairs_sql('calls', ['tool', 'program'], 'ms')}) SELECT dim, value, count(*) AS n, sum(coalesce(ms, 0))::DOUBLE AS weight FROM p GROUP BY ALL")
def a2_duration_weight(spark, sf_dir):
    return A.distributions(T.calls(spark, sf_dir), ["tool", "program"], F.coalesce("ms", F.lit(0))).select("dim", "value", "n", "weight")


@query(f"{WITH_BOTH}, p AS (SELECT DISTINCT * FROM ({pairs_sql('calls', ['program', 'status', 'tool'], 'session')})) SELECT dim, value, count(DISTINCT copy_key) AS sessions, round(sum(cost), 4) AS cost FROM p JOIN sessions USING (session) GROUP BY dim, value")
def a4_session_distributions(spark, sf_dir):
    """Sessions once per value, copies once, costs of all copies."""
    made = A.session_distributions(T.calls(spark, sf_dir), T.sessions(spark, sf_dir), ["program", "status", "tool"])
    return made.withColumn("cost", F.round("cost", 4))


_TOOL = f"""SELECT c.*, q5.v AS p50_ms, q9.v AS p95_ms FROM (
  SELECT tool, count(*) AS calls, count(*) FILTER (err) AS errors, count(ms) AS timed, sum(ms)::BIGINT AS total_ms, max(ms) AS max_ms, sum(out)::BIGINT AS out_bytes, count(*) FILTER (err) / count(*)::DOUBLE AS error_rate FROM calls GROUP BY tool) c
  LEFT JOIN {quantile_sql('calls', 'tool', 0.5)} q5 USING (tool) LEFT JOIN {quantile_sql('calls', 'tool', 0.95)} q9 USING (tool)"""


@query(f"{WITH_CALLS} {_TOOL}")
def a8_tool_quantiles(spark, sf_dir):
    """Tool totals with histogram quantiles."""
    return A.tool_totals(T.calls(spark, sf_dir)).drop("hist")


@query(f"{WITH_CALLS} SELECT count(*) AS calls, count(*) FILTER (err) AS errors, count(DISTINCT session) AS sessions, count(DISTINCT (session, day)) AS session_days, count(DISTINCT model) AS models, count(ms) AS timed, sum(ms)::BIGINT AS total_ms, max(ms) AS max_ms, (SELECT v FROM {quantile_sql('calls', '', 0.5)}) AS p50_ms, (SELECT v FROM {quantile_sql('calls', '', 0.95)}) AS p95_ms FROM calls")
def a10_totals(spark, sf_dir):
    return A.totals(T.calls(spark, sf_dir)).drop("hist")


@query(f"{WITH_CALLS}, d AS (SELECT session, day, count(*) AS n FROM calls GROUP BY ALL) SELECT sum(n)::BIGINT AS day_tools, count(*) AS session_days FROM d SEMI JOIN (SELECT * FROM calls WHERE tool = 'error' AND ms > 5000) m USING (session, day)")
def a11_money_once(spark, sf_dir):
    """Session-days with a slow error, each counted once."""
    calls = T.calls(spark, sf_dir)
    return A.money_once(calls.filter("tool = 'error' AND ms > 5000"), A.day_usage(calls), "day_tools")


@query(f"""{WITH_CALLS}, p AS ({pairs_sql('calls', ['hour', 'program', 'tool'], 'err, ms, tool AS t')})
SELECT dim, value, count(*) FILTER (t <> 'error' OR t IS NULL) AS n, count(*) FILTER (err AND t <> 'error') AS errors FROM p GROUP BY ALL HAVING n > 0""")
def a12_minus(spark, sf_dir):
    """The rest of the scope as a subtraction of counts."""
    calls = T.calls(spark, sf_dir)
    dims = ["hour", "program", "tool"]
    return A.minus(A.distributions(calls, dims), A.distributions(calls.filter("tool = 'error'"), dims)).select("dim", "value", "n", "errors")


@query(f"{WITH_CALLS} SELECT tool, day, seq, ms, rank FROM (SELECT *, row_number() OVER (PARTITION BY tool, day ORDER BY ms DESC, seq) AS rank FROM calls WHERE ms IS NOT NULL) WHERE rank <= 10")
def a14_slowest_per_tool_day(spark, sf_dir):
    calls = T.calls(spark, sf_dir).filter("ms IS NOT NULL").select("tool", "day", "seq", "ms")
    return A.top_per_group(calls, ["tool", "day"], [F.col("ms").desc(), F.col("seq")], 10)


@query(f"{WITH_CALLS} SELECT tool, calls, errors, total_ms, max_ms, p50_ms, p95_ms FROM ({_TOOL})")
def a9_merged_days(spark, sf_dir):
    """The same totals from day pre-aggregates: sums and histograms merge."""
    calls = T.calls(spark, sf_dir)
    days = calls.groupBy("tool", "session", "day").agg(F.count(F.lit(1)).alias("day_tools"), F.count_if("err").alias("day_errors"), S.histogram_of(F.col("ms")).alias("hist"), F.max("ms").alias("max_ms"), F.sum("ms").alias("total_ms"))
    return A.merge_days(days, "tool").drop("hist")


@query(f"{WITH_CALLS}, f AS (SELECT unnest(files) AS file, tool, err FROM calls) SELECT file, count(*) AS n, count(*) FILTER (tool IN ('click', 'purchase')) AS edits, count(*) FILTER (err) AS errors FROM f GROUP BY file")
def a17_files(spark, sf_dir):
    rows = T.calls(spark, sf_dir).select("tool", "err", F.explode("files").alias("file"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tool").isin("click", "purchase")).alias("edits"), F.count_if("err").alias("errors"))


@query(f"""{WITH_CALLS}, f AS (SELECT CASE WHEN file LIKE 'src/d3/%' THEN '' ELSE file END AS file FROM (SELECT unnest(files) AS file FROM calls)), n AS (SELECT file, count(*) AS n FROM f GROUP BY file)
  SELECT * FROM (SELECT file, n FROM n WHERE file <> '' ORDER BY n DESC, file LIMIT 7) UNION ALL SELECT '', n FROM n WHERE file = ''""")
def o2_top_files(spark, sf_dir):
    """The seven most touched files and all of another root as one row."""
    rows = T.calls(spark, sf_dir).select(F.explode("files").alias("file")).withColumn("file", F.when(F.col("file").startswith("src/d3/"), "").otherwise(F.col("file")))
    return A.top_files(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")), 7)


@query(f"{WITH_BOTH} SELECT harness, count(*) AS sessions, sum(tools)::BIGINT AS tools, max(tools) AS busiest_tools, arg_max(session, (tools, -session)) AS busiest FROM sessions GROUP BY harness")
def a18_harness_stats(spark, sf_dir):
    s = T.sessions(spark, sf_dir)
    return s.groupBy("harness").agg(F.count(F.lit(1)).alias("sessions"), F.sum("tools").alias("tools"), F.max("tools").alias("busiest_tools"), F.max_by("session", F.struct("tools", -F.col("session"))).alias("busiest"))


@query(f"{WITH_BOTH} SELECT repo, count(*) AS sessions, count(*) FILTER (parent IS NOT NULL) AS subagents, round(sum(cost), 4) AS cost, sum(tools)::BIGINT AS tools, sum(errors)::BIGINT AS errors FROM sessions GROUP BY repo")
def a19_repo_aggregate(spark, sf_dir):
    s = T.sessions(spark, sf_dir)
    return s.groupBy("repo").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("parent").isNotNull()).alias("subagents"), F.round(F.sum("cost"), 4).alias("cost"), F.sum("tools").alias("tools"), F.sum("errors").alias("errors"))


# Filters, their unknown-value semantics and lifting.

_SESSION_COLUMNS = ("session", "repo", "harness", "tools", "errors")


@query(f"{WITH_BOTH} SELECT session, repo, harness, tools, errors FROM sessions WHERE NOT coalesce(cost > 5000, false) AND coalesce(error_rate < 0.25, false) AND contains(repo, '1')")
def f6_session_filter(spark, sf_dir):
    """not cost > 5k (an unknown cost matches), error_rate < 25%, repo ~ 1."""
    f = Filters(~clause("cost", ">", 5000), clause("error_rate", "<", "25%"), clause("repo", "~", "1"))
    return matching_sessions(T.sessions(spark, sf_dir), f).select(*_SESSION_COLUMNS)


@query(f"{WITH_BOTH} SELECT session, repo, harness, tools, errors FROM sessions SEMI JOIN (SELECT session FROM calls WHERE tool = 'error' AND ms >= 5000 AND list_contains(programs, 'p2')) USING (session)")
def f14_lifted_calls(spark, sf_dir):
    """Sessions with one call that satisfies all call clauses at once."""
    f = Filters(clause("status", "is", "error"), clause("duration", ">=", "5s"), clause("program", "is", "p2"))
    return matching_sessions(T.sessions(spark, sf_dir), f, T.calls(spark, sf_dir)).select(*_SESSION_COLUMNS)


@query(f"""{WITH_BOTH}, d AS (SELECT session, day, count(*) AS day_tools FROM calls GROUP BY ALL HAVING day_tools >= 3 AND day >= DATE '2024-01-24')
SELECT session, repo, harness, tools, errors FROM sessions SEMI JOIN (SELECT session FROM calls SEMI JOIN d USING (session, day) WHERE tool = 'purchase') USING (session)""")
def f15_lifted_days(spark, sf_dir):
    """A purchase on a busy day of the last week: the call lies on the day that satisfies the day clauses."""
    f = Filters(clause("tool", "is", "purchase"), clause("day", ">=", "-6d"), clause("day.tools", ">=", 3))
    calls = T.calls(spark, sf_dir)
    return matching_sessions(T.sessions(spark, sf_dir), f, calls, A.day_usage(calls), today=TODAY).select(*_SESSION_COLUMNS)


@query(f"{WITH_BOTH} SELECT session, repo, harness, tools, errors FROM sessions WHERE parent IS NULL AND harness IN ('building', 'machinery') AND regexp_matches(lower(cwd), '^/home/u/[^/]*/w[^/]*$')")
def f7_path_globs(spark, sf_dir):
    f = Filters(clause("subagent", "is", "false"), clause("harness", "is_one_of", "BUILDING", "MACHINERY"), clause("cwd", "is", "/home/u/*/w*"))
    return matching_sessions(T.sessions(spark, sf_dir), f).select(*_SESSION_COLUMNS)


@query(f"{WITH_CALLS} SELECT seq, tool, ms FROM calls WHERE ms IS NULL AND NOT list_bool_or(list_transform(files, lambda f: ends_with(f, '.md'))) AND NOT coalesce(out > 51200, false)")
def f4_unknown_and_negative(spark, sf_dir):
    """duration is unknown, ext is_not md (no value may match), not out > 50KB."""
    f = Filters(clause("duration", "is", "unknown"), clause("ext", "is_not", "md"), ~clause("out", ">", "50KB"))
    return matching_calls(T.calls(spark, sf_dir), f).select("seq", "tool", "ms")


@query(f"{WITH_CALLS} SELECT tool, count(*) AS n FROM calls WHERE day > DATE '2024-01-20' GROUP BY tool")
def f23_retention(spark, sf_dir):
    return matching_calls(T.calls(spark, sf_dir), Filters(), today=TODAY, retention_days=10).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT conv_id AS session FROM conversations WHERE contains(lower(text), 'tion')")
def f21_content(spark, sf_dir):
    turns = T.turns(spark, sf_dir)
    return having_text(turns.select("session").distinct(), turns, "TION")


def _events(spark, sf_dir):
    """Events with shell lines, edits, reads, a server's tools and subagents, and the turns."""
    tool = F.col("tool")
    name = F.when(tool == "click", "Bash").when(tool == "view", "Grep").when(tool == "purchase", "mcp__Shop__buy").when(tool == "error", "Edit").otherwise("Task")
    lines = F.array(*map(F.lit, ("cd app && CI=1 pytest -q | tail -5", "git -C app status", "npm run build")))
    calls = T.calls(spark, sf_dir).withColumn("argument", F.when(tool == "click", lines[F.floor(F.col("out") / 1000) % 3]))
    return event_rows(calls.withColumn("tool", name), T.turns(spark, sf_dir))


_EVENTS = """ev AS (SELECT session, unnest(CASE tool WHEN 'click' THEN [['shell:test', 'shell:vcs', 'shell:build'][(out // 1000) % 3 + 1]] WHEN 'view' THEN ['read:search'] WHEN 'purchase' THEN ['mcp:shop'] WHEN 'error' THEN ['edit', 'error'] ELSE ['subagent'] END) AS kind FROM calls
  UNION ALL SELECT conv_id, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'reply' ELSE 'meta' END FROM conversations)"""


@query(f"{WITH_CALLS}, {_EVENTS} SELECT kind, count(*) AS n, count(DISTINCT session) AS sessions FROM ev GROUP BY kind")
def c7_event_kinds(spark, sf_dir):
    rows = _events(spark, sf_dir).select("session", F.explode("kinds").alias("kind"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("session").alias("sessions"))


@query(f"{WITH_BOTH}, {_EVENTS} SELECT session, repo, harness, tools, errors FROM sessions SEMI JOIN (SELECT session FROM ev WHERE kind = 'shell:vcs') USING (session)")
def f16_lifted_events(spark, sf_dir):
    """Sessions with one event that is a shell's and of the family git status."""
    f = Filters(clause("event.kind", "is", "shell"), clause("shell.family", "is", "git status"))
    return matching_sessions(T.sessions(spark, sf_dir), f, events=_events(spark, sf_dir)).select(*_SESSION_COLUMNS)


#: A shell line of every form around an order's comment, and the family and kind that a shell would run; {c} stands for the comment.
_LINES = (
    ("cd /w/app && git commit -m '{c}; make && rm -rf /'", "git commit", "vcs"),
    ('FOO="{c} && x" timeout -s KILL 90 npx --yes vitest run | tail -5', "vitest", "test"),
    ("cat <<'END' > notes.txt\n{c}; cargo test\nEND\nruff check .", "ruff", "lint"),
    ('echo "{c} | y" | wc -c', "wc", "other"),
    ('bash -lc "cd /w && echo \\"{c}; pytest\\" && cargo build --release"', "cargo build", "build"),
    ("(sudo -u ci env A=1 pnpm -C web run type-check -- '{c}') 2>&1", "pnpm run type-check", "typecheck"),
    ("export NOTE='{c}'; cd /tmp", "sh", "other"),
    ("deploy '{c}' --now", "release", "ci"),
)
_RULES = Rules.read({"families": [{"match": "deploy * ...", "family": "release", "kind": "ci", "heavy": True}]})


def _line_sql() -> str:
    told = ", ".join(f"{{'family': '{f}', 'kind': '{k}', 'heavy': {f == 'release' or k in HEAVY}}}" for _, f, k in _LINES)
    return f"SELECT o_orderkey, f.family AS family, f.kind AS kind, f.heavy AS heavy FROM (SELECT o_orderkey, [{told}][o_orderkey % {len(_LINES)} + 1] AS f FROM orders)"


@query(_line_sql())
def c3_shell_families(spark, sf_dir):
    """Shell lines around orders' customers and priorities, quoted, in here-documents and in nested shells, by family with a user rule; the SQL tells what was put in."""
    o = T.read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", F.lit("it; is && so |"), "o_custkey", "o_orderpriority").alias("c"))
    lines = F.array(*(F.concat(F.lit(line.split("{c}")[0]), "c", F.lit(line.split("{c}")[1])) for line, _, _ in _LINES))
    found = shell.line_family(F.element_at(lines, (F.col("o_orderkey") % len(_LINES) + 1).cast("int")), families.kind, _RULES)
    return o.select("o_orderkey", found.alias("f")).select("o_orderkey", "f.family", "f.kind", "f.heavy")


@query(f"""WITH told AS (SELECT o_orderkey, o_orderkey % 3 AS form FROM orders)
SELECT ['pnpm test', 'cargo build', 'git status'][form + 1] AS family, ['test', 'build', 'vcs'][form + 1] AS kind, form < 2 AS heavy, count(*) AS calls, sum(o_orderkey)::BIGINT AS keys FROM told GROUP BY form""")
def c5_call_families(spark, sf_dir):
    """Calls with arguments as a script of two commands, a JSON argv and a JSON object: heavy commands first."""
    key = F.col("o_orderkey").cast("string")
    script = F.concat(F.lit('tools.exec_command({cmd:"git log \\"'), key, F.lit('\\" | cat"}); tools.exec_command({workdir: "/w", "cmd": \'pnpm test\'})'))
    argv = F.to_json(F.array(F.lit("bash"), F.lit("-lc"), F.concat(F.lit("echo '"), key, F.lit("; x' && cargo build"))))
    fields = F.to_json(F.struct(F.concat(F.lit("git status # "), key).alias("command")))
    forms = F.array(script, argv, fields)
    o = T.read(spark, sf_dir, "orders")
    found = o.select("o_orderkey", families.call_family(F.element_at(forms, (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("f"))
    return found.groupBy("f.family", "f.kind", "f.heavy").agg(F.count(F.lit(1)).alias("calls"), F.sum("o_orderkey").alias("keys"))


@query(f"{WITH_BOTH} SELECT session, parent FROM sessions WHERE session = 20 OR parent = 20")
def f22_session_and_children(spark, sf_dir):
    return session_and_children(T.sessions(spark, sf_dir), 20).select("session", "parent")


@query(f"{WITH_BOTH} SELECT session, tools FROM sessions WHERE tools < 70 OR (tools = 70 AND session > 50) ORDER BY tools DESC, session LIMIT 20")
def o5_keyset_page(spark, sf_dir):
    return A.page(T.sessions(spark, sf_dir), "tools", (70, 50), 20).select("session", "tools")


@query(f"{WITH_BOTH} SELECT s.session, s.parent, p.tools AS parent_tools FROM sessions s LEFT JOIN sessions p ON s.parent = p.session")
def j2_parents(spark, sf_dir):
    s = T.sessions(spark, sf_dir)
    p = s.select(F.col("session").alias("parent"), F.col("tools").alias("parent_tools"))
    return s.select("session", "parent").join(p, "parent", "left").select("session", "parent", "parent_tools")


@query(f"{WITH_BOTH} SELECT copy_key, min(session) AS session, count(*) AS copies FROM sessions GROUP BY copy_key")
def u7_distinct_copies(spark, sf_dir):
    return T.sessions(spark, sf_dir).groupBy("copy_key").agg(F.min("session").alias("session"), F.count(F.lit(1)).alias("copies"))


@query("SELECT url, regexp_extract(url, '([^/]+)/*$', 1) AS base, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\\.([^.]+)$', 1)) AS ext FROM pages")
def c11_paths(spark, sf_dir):
    pages = T.read(spark, sf_dir, "pages")
    return pages.select("url", S.basename(F.col("url")).alias("base"), S.extension(F.col("url")).alias("ext"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g'), ' '), 1, 200) AS line, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents")
def c1_one_line(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", S.norm(F.col("text")).alias("line"), S.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?i)\b((?:api[_-]?key|token|secret|password)[ \t\n\x0B\f\r]*[=:][ \t\n\x0B\f\r]*["'']?)[^ \t\n\x0B\f\r"'',;]{8,}', '\1***', 'g'), '\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+', 'user@example.com', 'g'),
  '\b(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9_-]{16,}', '***', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}\b', '0.0.0.0', 'g'), '/(home|Users)/[^/ \t\n\x0B\f\r]+', '/\1/user', 'g') AS text FROM documents""")
def c29_redacted(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", S.redact(F.col("text")).alias("text"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, user_id FROM events WHERE event_type = 'purchase'")
def c28_json_fields(spark, sf_dir):
    return T.read(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id")
