"""Wait reports, agent time, contention, advice, teams, families."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.functions import families
from loomspan.operators import intervals as I
from loomspan.operators import reports as P
from loomspan.queries import quantile_sql, query
from loomspan.queries.calls import WITH_BOTH, WITH_CALLS
from loomspan.queries.intervals import SPANS_SQL, spans
from loomspan.sources import tables as T


@query(f"""{WITH_CALLS}, n AS (SELECT * FROM calls WHERE day >= DATE '2024-01-20' AND day < DATE '2024-01-27'), b AS (SELECT tool, sum(ms)::BIGINT AS p FROM calls WHERE day >= DATE '2024-01-13' AND day < DATE '2024-01-20' GROUP BY tool)
  SELECT tool, calls, timed_calls, total_ms, max_ms, errors, agents, p AS prev_total_ms, q5.v AS p50_ms, q9.v AS p95_ms, round(total_ms / sum(total_ms) OVER (), 4) AS share, round(errors / calls::DOUBLE, 4) AS error_rate, round((total_ms - p) / p::DOUBLE, 4) AS trend
  FROM (SELECT tool, count(*) AS calls, count(ms) AS timed_calls, sum(ms)::BIGINT AS total_ms, max(ms) AS max_ms, count(*) FILTER (err) AS errors, count(DISTINCT session) AS agents FROM n GROUP BY tool)
  LEFT JOIN b USING (tool) LEFT JOIN {quantile_sql('n', 'tool', 0.5)} q5 USING (tool) LEFT JOIN {quantile_sql('n', 'tool', 0.95)} q9 USING (tool)""")
def a24_wait_report(spark, sf_dir):
    """A week's waiting per tool with the trend against the week before."""
    made = P.wait_report(T.calls(spark, sf_dir), "tool", "2024-01-20", 7).drop("hist")
    return made.withColumns({c: F.round(c, 4) for c in ("share", "error_rate", "trend")})


@query(f"""{WITH_CALLS}, x AS (SELECT session, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY session ORDER BY t_ms) AS g FROM calls), y AS (SELECT *, sum(CASE WHEN g <= 300000 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS i FROM x),
  a AS (SELECT session, sum(m)::BIGINT * 60000 AS active_ms FROM (SELECT session, i, max(t_ms // 60000) + 1 - min(t_ms // 60000) AS m FROM y GROUP BY ALL) GROUP BY session),
  s AS (SELECT session, t_ms AS t0, t_ms + ms AS t1 FROM calls WHERE ms > 0), r AS (SELECT *, max(t1) OVER (PARTITION BY session ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
  u AS (SELECT session, sum(greatest(0, t1 - greatest(t0, coalesce(reach, t0))))::BIGINT AS tool_ms FROM r GROUP BY session)
  SELECT session, active_ms, coalesce(tool_ms, 0) AS tool_ms, greatest(0, active_ms - coalesce(tool_ms, 0)) AS model_ms FROM a LEFT JOIN u USING (session)""")
def i2_agent_time(spark, sf_dir):
    """Active, tool and model time of each session."""
    return P.agent_time(T.calls(spark, sf_dir))


@query(f"{SPANS_SQL} SELECT tool, count(*) AS running, count(DISTINCT session) AS sessions, max(1705320000000 - t0) AS oldest_ms FROM spans WHERE t0 <= 1705320000000 AND t1 > 1705320000000 AND 1705320000000 - t0 < 86400000 GROUP BY tool")
def i4_contention_now(spark, sf_dir):
    return P.contention(spans(spark, sf_dir), "tool", 1_705_320_000_000)


_LOADS = "loads AS (SELECT session, 's' || seq % 5 AS name, t_ms AS t, t_ms + 7200000 AS \"end\" FROM calls WHERE tool = 'signup')"


@query(f"{WITH_CALLS}, {_LOADS} SELECT DISTINCT c.session, c.seq, l.name FROM calls c JOIN loads l ON c.session = l.session AND c.t_ms >= l.t AND c.t_ms < l.\"end\"")
def j6_calls_in_context(spark, sf_dir):
    """Calls with the skills in context at their start."""
    calls = T.calls(spark, sf_dir)
    loads = calls.filter("tool = 'signup'").select("session", F.concat(F.lit("s"), F.col("seq") % 5).alias("name"), F.col("t_ms").alias("t"), (F.col("t_ms") + 7_200_000).alias("end"))
    return P.calls_with_context(calls, loads)


def _loads(spark, sf_dir):
    k = F.col("seq")
    return T.calls(spark, sf_dir).filter("tool = 'view'").select(
        "session", F.when(k % 37 == 0, P.LISTING).otherwise(F.concat(F.lit("s"), k % 7)).alias("name"), F.when(k % 7 == 3, "user").when(k % 2 == 0, "user").otherwise("model").alias("trigger"), F.col("t_ms").alias("t"), (F.col("t_ms") + 86_400_000).alias("end"),
        (k % 7 * 600).alias("size"), (F.col("seq") % 100).cast("double").alias("usd"), (F.col("seq") % 100 * 0.75).alias("tail_usd"), (F.col("seq") % 100 * 0.2).alias("carry_usd"), (k % 35 == 0).alias("reloaded"), F.when(k % 13 == 0, 2).otherwise(1).alias("n"), (k % 17 == 0).alias("stub"), F.concat(F.lit("h"), k % 3).alias("hash"), (F.col("session") % 4).alias("host"),
    )


@query(f"""{WITH_CALLS}, every AS (SELECT session, seq, CASE WHEN seq % 37 = 0 THEN '(listing)' ELSE 's' || seq % 7 END AS name, CASE WHEN seq % 7 = 3 OR seq % 2 = 0 THEN 'user' ELSE 'model' END AS trigger, t_ms AS t, t_ms + 86400000 AS e, seq % 7 * 600 AS size, (seq % 100)::DOUBLE AS usd, seq % 100 * 0.75 AS tail, seq % 100 * 0.2::DOUBLE AS carry, seq % 35 = 0 AS reloaded, CASE WHEN seq % 13 = 0 THEN 2 ELSE 1 END AS n, seq % 17 = 0 AS stub, 'h' || seq % 3 AS hash, session % 4 AS host FROM calls WHERE tool = 'view'),
  loads AS (SELECT * FROM every WHERE name <> '(listing)'), listed AS (SELECT 's' || x AS name FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (8), (9)) v(x)),
  t AS (SELECT name, quantile_disc(size, 0.5) AS size, sum(usd) AS usd, sum(tail) AS tail, count(DISTINCT session) AS n, count(*) FILTER (trigger = 'user') AS u, count(*) FILTER (trigger = 'model') AS m, count(DISTINCT session) FILTER (trigger = 'user') AS un, count(*) FILTER (reloaded) AS r, sum(usd - carry) FILTER (reloaded) AS ru FROM loads GROUP BY name)
  SELECT 'A1' AS advice, name, round(tail, 6)::DOUBLE AS severity FROM t WHERE size >= 2000 AND tail / usd >= 0.6 AND n >= 3
  UNION ALL SELECT 'A2', name, round(usd * 0.1, 6) FROM t WHERE u >= 3 AND m = 0 AND un >= 3
  UNION ALL SELECT 'A3', name, round(sum(usd), 6) FROM loads a WHERE n = 1 AND EXISTS (SELECT 1 FROM loads b WHERE b.session = a.session AND b.name = a.name AND b.n = 1 AND b.t < a.t AND b.e > a.t) GROUP BY name HAVING count(DISTINCT session) >= 2
  UNION ALL SELECT 'A4', name, round(ru, 6) FROM t WHERE r >= 3
  UNION ALL SELECT 'A6', name, round((SELECT sum(usd) FROM every WHERE name = '(listing)') / (SELECT count(*) FROM listed), 6) FROM listed WHERE name NOT IN (SELECT name FROM loads)
  UNION ALL SELECT 'A10', name, 0.0 FROM (SELECT name, host, arg_max(hash, t) AS h FROM loads WHERE NOT stub GROUP BY ALL) GROUP BY name HAVING count(DISTINCT h) >= 2""")
def i17_skill_advice(spark, sf_dir):
    listed = spark.range(10).select(F.concat(F.lit("s"), "id").alias("name")).filter("name <> 's7'")
    return P.advice(_loads(spark, sf_dir), listed, 30)


@query(f"{WITH_BOTH}, p AS (SELECT harness, repo AS member, sum(cost) AS v FROM sessions GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY harness ORDER BY v DESC NULLS LAST, member) AS n FROM p) SELECT harness, round(sum(v), 4) AS cost, count(*) AS members, max(CASE WHEN n = 1 THEN member END) AS top, max(CASE WHEN n = 2 THEN member END) AS second FROM r GROUP BY harness")
def a23_team_groups(spark, sf_dir):
    rows = T.sessions(spark, sf_dir).withColumn("member", F.col("repo"))
    return P.team_groups(rows, "harness").withColumn("cost", F.round("cost", 4))


@query(f"{WITH_CALLS}, x AS (SELECT session, seq, tool = 'error' AS s, sum((tool = 'error')::INT) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM calls) SELECT session, min(seq) AS first, max(seq) AS last, count(*) AS hidden FROM x WHERE NOT s GROUP BY session, g")
def f25_hidden_runs(spark, sf_dir):
    """Runs of calls that an error-only view hides."""
    return P.quiet_gaps(T.calls(spark, sf_dir), F.col("tool") == "error", ["session"], "seq")


@query("SELECT p_name AS text, count(*) AS n FROM part WHERE contains(p_name, 'r') GROUP BY p_name HAVING regexp_matches(p_name, 'r.*i.*n.*g')")
def o6_fuzzy_matches(spark, sf_dir):
    """Part names that hold r, i, n, g in order (the ranking itself has no SQL)."""
    names = T.read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return P.fuzzy(names, "text", "ring", 1000).drop("score")


@query(f"{WITH_CALLS} SELECT c.seq FROM calls c WHERE tool = 'purchase' AND NOT EXISTS (SELECT 1 FROM calls s WHERE s.tool = 'error' AND s.out = c.out AND s.session = c.session) AND NOT EXISTS (SELECT 1 FROM calls s WHERE s.tool = 'error' AND s.session = c.session AND s.hour = 3)")
def j16_native_usage(spark, sf_dir):
    """Usage that no exported span covers, by request or by session."""
    request = (F.col("out") * 1000 + F.col("session")).alias("request")
    calls = T.calls(spark, sf_dir).select("tool", "seq", "session", "hour", request)
    errors = calls.filter("tool = 'error'")
    return P.native_usage(calls.filter("tool = 'purchase'"), errors, errors.filter("hour = 3")).select("seq")


@query(f"{WITH_CALLS}, s AS (SELECT session, min(t_ms) AS w0, max(t_ms) AS w1, count(DISTINCT t_ms // 60000) AS minutes FROM calls GROUP BY session), c AS (SELECT a.session, b.session AS other, row_number() OVER (PARTITION BY a.session ORDER BY b.minutes DESC, b.session) AS n FROM s a JOIN s b ON a.session <> b.session AND a.session % 5 = b.session % 5 AND a.w0 <= b.w1 AND b.w0 <= a.w1) SELECT session, other, n AS rank FROM c WHERE n <= 40")
def j13_related_candidates(spark, sf_dir):
    """Sessions of one project whose windows overlap, the busiest forty."""
    s = T.calls(spark, sf_dir).groupBy("session").agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"), F.count_distinct(F.floor(F.col("t_ms") / 60000)).alias("minutes")).withColumn("project", F.col("session") % 5)
    return I.first_overlapping(s, ["project"], "session", F.struct(-F.col("minutes"), F.col("session")), 40).select("session", "other", "rank")


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'file' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1")
def c6_tool_kinds(spark, sf_dir):
    rows = T.read(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "view", "read_file").otherwise(F.col("event_type")).alias("tool"))
    return rows.groupBy(families.tool_kind(F.col("tool")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{WITH_CALLS}, s AS (SELECT session, min(t_ms) AS t0, max(t_ms) AS t1, count(DISTINCT day) AS days, count(*) AS n FROM calls GROUP BY session) SELECT session, t1 - t0 AS wall_ms, days, n FROM s")
def a30_session_summary(spark, sf_dir):
    return T.calls(spark, sf_dir).groupBy("session").agg((F.max("t_ms") - F.min("t_ms")).alias("wall_ms"), F.count_distinct("day").alias("days"), F.count(F.lit(1)).alias("n"))


@query(f"""{SPANS_SQL}, e AS (SELECT session, t0 AS t, 1 AS d FROM spans WHERE t1 > t0 UNION ALL SELECT session, t1, -1 FROM spans WHERE t1 > t0), p AS (SELECT session, d, sum(d) OVER (PARTITION BY session ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM e)
  SELECT session, count(*) FILTER (d = 1) AS spans, max(open)::BIGINT AS most FROM p GROUP BY session""")
def w8_lane_sizes(spark, sf_dir):
    """Greedy packing needs as many lanes as spans are ever open at once."""
    made = I.lanes(spans(spark, sf_dir).filter("t1 > t0").select("session", "seq", "t0", "t1"), ["session"])
    return made.groupBy("session").agg(F.count(F.lit(1)).alias("spans"), (F.max("lane") + 1).alias("most"))
