"""Skill loads: sizes, advice from versions, idle loads, overlaps and outcomes, metrics for rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import skills as K
from loomspan.queries import query
from loomspan.queries.calls import WITH_CALLS
from loomspan.sources import tables as T


def loads(spark, sf_dir):
    """Views as skill loads: seven skills, four hashes, turns of a week, some loads without size, end or end of turn."""
    k = F.col("seq")
    return T.calls(spark, sf_dir).filter("tool = 'view'").select(
        "session", F.concat(F.lit("s"), k % 7).alias("name"), F.when(k % 4 == 0, "user").otherwise("model").alias("trigger"), F.floor(F.col("t_ms") / 604_800_000).alias("turn"), F.col("t_ms").alias("t"),
        F.when(k % 5 != 0, F.col("t_ms") + k % 9 * 3_600_000).alias("turn_end"), F.when(k % 6 != 0, F.col("t_ms") + 172_800_000).alias("end"), F.when(k % 8 != 0, k % 11 * 100).alias("size"),
        F.when(k % 3 != 0, F.concat(F.lit("h"), k % 4)).alias("hash"), (k % 100).cast("double").alias("usd"), (k % 100 * 0.5).alias("tail_usd"), (k % 100 * 0.25).alias("carry_usd"),
        F.when(k % 13 == 0, 2).otherwise(1).alias("n"), (k % 17 == 0).alias("stub"),
    )


_LOADS = """loads AS (SELECT session, 's' || seq % 7 AS name, CASE WHEN seq % 4 = 0 THEN 'user' ELSE 'model' END AS trigger, t_ms // 604800000 AS turn, t_ms AS t, CASE WHEN seq % 5 <> 0 THEN t_ms + seq % 9 * 3600000 END AS turn_end,
    CASE WHEN seq % 6 <> 0 THEN t_ms + 172800000 END AS e, CASE WHEN seq % 8 <> 0 THEN seq % 11 * 100 END AS size, CASE WHEN seq % 3 <> 0 THEN 'h' || seq % 4 END AS hash, (seq % 100)::DOUBLE AS usd, seq % 100 * 0.5::DOUBLE AS tail, seq % 100 * 0.25::DOUBLE AS carry, CASE WHEN seq % 13 = 0 THEN 2 ELSE 1 END AS n, seq % 17 = 0 AS stub
  FROM calls WHERE tool = 'view')"""
WITH_LOADS = f"{WITH_CALLS}, {_LOADS}"


@query(f"""{WITH_LOADS}, h AS (SELECT hash, quantile_disc(size, 0.5) AS m FROM loads WHERE size IS NOT NULL AND hash IS NOT NULL GROUP BY hash), n AS (SELECT name, quantile_disc(size, 0.5) AS m FROM loads WHERE size IS NOT NULL GROUP BY name)
  SELECT session, name, t, coalesce(size, h.m, n.m) AS size, size IS NULL AND coalesce(h.m, n.m) IS NOT NULL AS guessed FROM loads LEFT JOIN h USING (hash) LEFT JOIN n USING (name)""")
def i15_sizes_filled(spark, sf_dir):
    return K.sizes_filled(loads(spark, sf_dir)).select("session", "name", "t", "size", "guessed")


@query(f"""{WITH_LOADS}, v AS (SELECT name, hash, min(t) AS first_t, count(DISTINCT session) AS sessions, sum(usd) / count(DISTINCT session) AS us, sum(tail) / nullif(sum(usd), 0) AS ts, quantile_disc(size, 0.5) AS size FROM loads WHERE hash IS NOT NULL AND NOT stub GROUP BY ALL),
  x AS (SELECT *, lag(hash) OVER w AS hash_before, lag(sessions) OVER w AS sessions_before, lag(us) OVER w AS ub, lag(size) OVER w AS size_before FROM v WINDOW w AS (PARTITION BY name ORDER BY first_t, hash))
  SELECT name, hash_before, hash, sessions_before, sessions, size_before, size, round(ub, 6) AS usd_session_before, round(us, 6) AS usd_session, round(abs(us - ub) * sessions, 6) AS severity FROM x WHERE sessions >= 3 AND sessions_before >= 3""")
def i17_version_changes(spark, sf_dir):
    made = K.version_changes(loads(spark, sf_dir), 30)
    made = made.withColumns({c: F.round(c, 6) for c in ("usd_session_before", "usd_session", "severity")})
    return made.select("name", "hash_before", "hash", "sessions_before", "sessions", "size_before", "size", "usd_session_before", "usd_session", "severity")


@query(f"""{WITH_LOADS}, s AS (SELECT l.name, l.usd, (SELECT count(*) FROM calls c WHERE c.session = l.session AND c.t_ms > l.t AND c.t_ms < l.turn_end) AS n FROM loads l WHERE trigger = 'model' AND turn_end IS NOT NULL AND l.n = 1 AND NOT l.stub)
  SELECT name, count(*)::BIGINT AS judged, count(*) FILTER (n = 0)::BIGINT AS idle, round(sum(usd) FILTER (n = 0), 6) AS idle_usd, round(sum(usd) FILTER (n = 0), 6) AS severity FROM s GROUP BY name HAVING count(*) >= 5 AND count(*) FILTER (n = 0) / count(*)::DOUBLE >= 0.5""")
def i17_idle_loads(spark, sf_dir):
    made = K.idle_loads(loads(spark, sf_dir), T.calls(spark, sf_dir), 30)
    return made.withColumns({c: F.round(c, 6) for c in ("idle_usd", "severity")})


@query(f"""{WITH_LOADS}, d AS (SELECT DISTINCT name, session, turn FROM loads), p AS (SELECT name, count(*) AS n, (SELECT sum(usd) FROM loads l WHERE l.name = d.name) AS usd FROM d GROUP BY name HAVING count(*) >= 5),
  b AS (SELECT x.name AS a, y.name AS b, count(*)::BIGINT AS shared FROM d x JOIN d y ON x.session = y.session AND x.turn = y.turn AND x.name < y.name GROUP BY ALL),
  j AS (SELECT b.*, shared / (p.n + q.n - shared)::DOUBLE AS jac, p.usd AS ua, q.usd AS ub FROM b JOIN p ON p.name = a JOIN p q ON q.name = b)
  SELECT CASE WHEN ua <= ub THEN a ELSE b END AS name, CASE WHEN ua <= ub THEN b ELSE a END AS pair, shared, round(jac, 6) AS jaccard, round(least(ua, ub) * jac, 6) AS severity FROM j WHERE shared >= 5 AND jac >= 0.1""")
def i17_overlaps(spark, sf_dir):
    made = K.overlaps(loads(spark, sf_dir), 30, share=0.1)
    return made.withColumns({c: F.round(c, 6) for c in ("jaccard", "severity")})


@query(f"""{WITH_LOADS}, c AS (SELECT session, t_ms, coalesce(err, false) AS err, tool = 'click' AS test, tool = 'purchase' AS done FROM calls),
  w AS (SELECT session, session % 5 AS repo, session % 13 AS turns, count(*) AS calls, count(*) FILTER (err) AS errors, count(*) FILTER (test) AS tests, count(*) FILTER (test AND NOT err) AS passed, count(*) FILTER (done) AS commits FROM c GROUP BY session),
  u AS (SELECT name, session, turn, min(t) AS t0, arg_min(turn_end, t) AS t1 FROM loads WHERE turn_end IS NOT NULL GROUP BY ALL),
  i AS (SELECT name, u.session, turn, count(t_ms) AS calls, count(t_ms) FILTER (err) AS errors, count(t_ms) FILTER (test) AS tests, count(t_ms) FILTER (test AND NOT err) AS passed, count(t_ms) FILTER (done) AS commits
    FROM u LEFT JOIN c ON c.session = u.session AND t_ms >= t0 AND t_ms < t1 GROUP BY ALL),
  o AS (SELECT name, session, count(*) AS turns, sum(calls) AS calls, sum(errors) AS errors, sum(tests) AS tests, sum(passed) AS passed, sum(commits) AS commits FROM i GROUP BY ALL),
  k AS (SELECT name, sum(turns)::BIGINT AS turns, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, sum(tests)::BIGINT AS tests, sum(passed)::BIGINT AS passed, sum(commits)::BIGINT AS commits FROM o GROUP BY name HAVING sum(turns) >= 10),
  r AS (SELECT k.name, w.*, o.turns AS ot, o.calls AS oc, o.errors AS oe, o.tests AS ott, o.passed AS op, o.commits AS om FROM k JOIN w ON w.repo IN (SELECT w2.repo FROM o o2 JOIN w w2 USING (session) WHERE o2.name = k.name) LEFT JOIN o ON o.name = k.name AND o.session = w.session)
  SELECT k.*, x.* EXCLUDE (name) FROM k JOIN (SELECT name, sum(greatest(0, turns - coalesce(ot, 0)))::BIGINT AS other_turns, sum(calls - coalesce(oc, 0))::BIGINT AS other_calls, sum(errors - coalesce(oe, 0))::BIGINT AS other_errors, sum(tests - coalesce(ott, 0))::BIGINT AS other_tests,
    sum(passed - coalesce(op, 0))::BIGINT AS other_passed, sum(commits - coalesce(om, 0))::BIGINT AS other_commits FROM r GROUP BY name) x USING (name) WHERE other_turns >= 10""")
def i18_outcomes(spark, sf_dir):
    """Loading turns against the other turns of the same projects."""
    calls = T.calls(spark, sf_dir).withColumns({"err": F.coalesce("err", F.lit(False)), "is_test": F.col("tool") == "click", "is_commit": F.col("tool") == "purchase"})
    sessions = calls.select("session").distinct().select("session", (F.col("session") % 5).alias("repo"), (F.col("session") % 13).alias("turns"))
    return K.outcomes(loads(spark, sf_dir), calls, sessions)


@query(f"""{WITH_LOADS}, n AS (SELECT a.session, max(1 + (SELECT count(*) FROM loads b WHERE b.session = a.session AND b.name = a.name AND b.t < a.t AND (b.e IS NULL OR b.e > a.t))) AS r FROM loads a GROUP BY a.session),
  c AS (SELECT session, max(c) AS c FROM (SELECT session, name, sum(carry) AS c FROM loads GROUP BY ALL) GROUP BY session), o AS (SELECT session, sum(size) AS size FROM loads WHERE e IS NULL AND size > 0 GROUP BY session)
  SELECT session, r AS skill_reloads, round(c, 6) AS skill_carry_usd, CASE WHEN session % 17 > 0 AND size IS NOT NULL THEN round(least(1.0, size / (session % 17 * 1000.0)), 6)::DOUBLE END AS skill_context_share FROM n JOIN c USING (session) LEFT JOIN o USING (session)""")
def r4_skill_metrics(spark, sf_dir):
    rows = loads(spark, sf_dir)
    contexts = rows.select("session").distinct().withColumn("context_tokens", F.col("session") % 17 * 1000)
    return K.skill_metrics(rows, contexts).withColumns({c: F.round(c, 6) for c in ("skill_carry_usd", "skill_context_share")})


@query(f"""{WITH_LOADS}, x AS (SELECT *, turn % 3 AS tail_tokens, CASE WHEN e IS NULL AND seq_why = 0 THEN NULL ELSE 'turn' END AS why FROM (SELECT *, session % 2 AS seq_why FROM loads))
  SELECT session, 'tokens' AS problem, count(*) AS n FROM x WHERE tail_tokens > 1 GROUP BY session UNION ALL SELECT session, 'state', count(*) FROM x WHERE (e IS NULL) <> (why IS NULL) GROUP BY session
  UNION ALL SELECT session, 'context', count(*) FROM x GROUP BY session HAVING count(*) > session % 17 + 0.5""")
def i16_broken_invariants(spark, sf_dir):
    """Loads of one token each with a tail of up to two, ends without reason and reasons without end, contexts of up to 16 tokens."""
    rows = loads(spark, sf_dir).withColumns({
        "load_tokens": F.lit(1), "carry_tokens": F.lit(0), "tail_tokens": F.col("turn") % 3,
        "why": F.when(F.col("end").isNotNull() | (F.col("session") % 2 != 0), "turn"),
    })
    contexts = rows.select("session").distinct().withColumn("context_tokens", F.col("session") % 17)
    return K.broken_invariants(rows, contexts)
