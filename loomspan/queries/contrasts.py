"""Triage and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import aggregate as A
from loomspan.operators import contrast as C
from loomspan.queries import quantile_sql, query
from loomspan.queries.calls import WITH_CALLS, pairs_sql
from loomspan.sources import tables as T

DIMS = ["hour", "program", "file", "weekday", "model"]
_CHI = "CASE WHEN (a + b) * ((na - a) + (nb - b))::DOUBLE * na * nb > 0 THEN (na + nb) * power(greatest(0, abs(a * (nb - b) - b * (na - a))::DOUBLE - (na + nb) / 2.0), 2) / ((a + b)::DOUBLE * ((na - a) + (nb - b)) * na * nb) ELSE 0 END"


def _scored(sel: str, base: str) -> str:
    """Scores of pairs in two sources with columns of calls."""
    return f"""sp AS (SELECT dim, value, count(*) AS a FROM ({pairs_sql(sel, DIMS, '1 AS one')}) GROUP BY dim, value),
      bp AS (SELECT dim, value, count(*) AS b FROM ({pairs_sql(base, DIMS, '1 AS one')}) GROUP BY dim, value),
      j AS (SELECT dim, value, a, coalesce(b, 0) AS b, (SELECT count(*) FROM {sel}) AS na, (SELECT count(*) FROM {base}) AS nb FROM sp LEFT JOIN bp USING (dim, value)),
      s AS (SELECT dim, value, a, b, a / na::DOUBLE AS share, b / nb::DOUBLE AS base_share, a / na::DOUBLE - b / nb::DOUBLE AS diff, CASE WHEN b > 0 THEN (a / na::DOUBLE) / (b / nb::DOUBLE) END AS lift, {_CHI} AS chi2 FROM j),
      r AS (SELECT *, chi2 >= 6.63 AS significant, row_number() OVER (PARTITION BY dim ORDER BY diff DESC, a DESC, value) AS rank FROM s WHERE a >= CASE WHEN dim = 'file' THEN 5 ELSE 1 END AND share >= 0.01)"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("share", "base_share", "diff", "lift", "chi2") if c in df.columns})


_ROWS = "dim, value, a, b, round(share, 6) AS share, round(base_share, 6) AS base_share, round(diff, 6) AS diff, round(lift, 6) AS lift, round(chi2, 6) AS chi2, significant, rank"


@query(f"{WITH_CALLS}, sel AS (SELECT * FROM calls WHERE err), base AS (SELECT * FROM calls WHERE NOT coalesce(err, false)), {_scored('sel', 'base')} SELECT {_ROWS} FROM r WHERE rank <= 5")
def t7_triage_errors(spark, sf_dir):
    """What sets failed calls apart from the rest of the scope."""
    calls = T.calls(spark, sf_dir)
    return _rounded(C.triage(calls, calls.filter("err"), DIMS))


@query(f"{WITH_CALLS}, sel AS (SELECT * FROM calls WHERE day >= DATE '2024-01-24'), base AS (SELECT * FROM calls WHERE day BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'), {_scored('sel', 'base')} SELECT {_ROWS} FROM r WHERE rank <= 3")
def t7_triage_previous_week(spark, sf_dir):
    calls = T.calls(spark, sf_dir)
    return _rounded(C.triage(calls, calls.filter("day >= DATE '2024-01-24'"), DIMS, calls.filter("day BETWEEN DATE '2024-01-17' AND DATE '2024-01-23'"), cap=3))


@query(f"{WITH_CALLS} SELECT tool, count(*) AS slow, (SELECT count(*) FROM calls c2 WHERE c2.tool = c.tool AND ms IS NOT NULL) AS timed FROM calls c JOIN {quantile_sql('calls', 'tool', 0.9)} q USING (tool) WHERE ms >= v GROUP BY tool")
def t6_slow_calls(spark, sf_dir):
    """Calls at or above their tool's p90; untimed ones are in neither group."""
    slow, timed = C.slow_calls(T.calls(spark, sf_dir))
    return slow.groupBy("tool").agg(F.count(F.lit(1)).alias("slow")).join(timed.groupBy("tool").agg(F.count(F.lit(1)).alias("timed")), "tool")


@query(f"""{WITH_CALLS}, tot AS (SELECT sum(coalesce(ms, 0))::DOUBLE AS t, coalesce(err, false) AS e FROM calls GROUP BY e),
  sp AS (SELECT dim, value, count(*) AS a, sum(w) AS w FROM ({pairs_sql('calls', ['model', 'tool'], 'coalesce(ms, 0) AS w, err')}) WHERE err GROUP BY dim, value),
  bp AS (SELECT dim, value, count(*) AS b, sum(w) AS v FROM ({pairs_sql('calls', ['model', 'tool'], 'coalesce(ms, 0) AS w, err')}) WHERE NOT coalesce(err, false) GROUP BY dim, value)
  SELECT dim, value, a, coalesce(b, 0) AS b, round(w / (SELECT t FROM tot WHERE e), 6) AS share, round(coalesce(v / (SELECT t FROM tot WHERE NOT e), 0), 6) AS base_share,
    round(w / (SELECT t FROM tot WHERE e) - coalesce(v / (SELECT t FROM tot WHERE NOT e), 0), 6) AS diff, round((w / (SELECT t FROM tot WHERE e)) / nullif(v / (SELECT t FROM tot WHERE NOT e), 0), 6) AS lift
  FROM sp LEFT JOIN bp USING (dim, value)""")
def t3_weighted_by_duration(spark, sf_dir):
    calls = T.calls(spark, sf_dir)
    weight = F.coalesce("ms", F.lit(0))
    sel, base = A.distributions(calls.filter("err"), ["model", "tool"], weight), A.distributions(calls.filter("NOT coalesce(err, false)"), ["model", "tool"], weight)
    return _rounded(C.weighted_scores(sel, base))


@query(f"{WITH_CALLS} SELECT tool, n AS calls_a, m AS calls_b, e AS errors_a, f AS errors_b, CASE WHEN n >= 50 AND m >= 50 THEN round(CASE WHEN (e + f) > 0 AND (n - e + m - f) > 0 THEN (n + m) * power(greatest(0, abs(e * (m - f) - f * (n - e))::DOUBLE - (n + m) / 2.0), 2) / ((e + f)::DOUBLE * (n - e + m - f) * n * m) ELSE 0 END, 6) END AS chi2 FROM (SELECT tool, count(*) FILTER (day < DATE '2024-01-15') AS n, count(*) FILTER (day >= DATE '2024-01-15') AS m, count(*) FILTER (err AND day < DATE '2024-01-15') AS e, count(*) FILTER (err AND day >= DATE '2024-01-15') AS f FROM calls GROUP BY tool)")
def p3_compare_tools(spark, sf_dir):
    calls = T.calls(spark, sf_dir)
    made = C.compare_tools(calls.filter("day < DATE '2024-01-15'"), calls.filter("day >= DATE '2024-01-15'"))
    return made.withColumn("chi2", F.round("chi2", 6))


_SIDE = "SELECT count(*)::DOUBLE AS calls, (count(*) FILTER (err))::DOUBLE AS errors, count(DISTINCT session)::DOUBLE AS sessions, count(DISTINCT (session, day))::DOUBLE AS session_days, count(DISTINCT model)::DOUBLE AS models, count(ms)::DOUBLE AS timed, sum(ms)::DOUBLE AS total_ms, max(ms)::DOUBLE AS max_ms, count(*) FILTER (err) / count(*)::DOUBLE AS error_rate, count(*) / count(DISTINCT session)::DOUBLE AS calls_session FROM calls WHERE "


@query(f"{WITH_CALLS}, xa AS ({_SIDE} tool = 'click'), xb AS ({_SIDE} tool = 'view'), a AS (UNPIVOT xa ON COLUMNS(*) INTO NAME metric VALUE v), b AS (UNPIVOT xb ON COLUMNS(*) INTO NAME metric VALUE w) SELECT metric, v AS a, w AS b, round(w - v, 6) AS delta, round(w / nullif(v, 0), 6) AS ratio FROM a JOIN b USING (metric)")
def p1_compare_metrics(spark, sf_dir):
    calls = T.calls(spark, sf_dir)
    made = C.compare_metrics(C.call_metrics(calls.filter("tool = 'click'")), C.call_metrics(calls.filter("tool = 'view'")))
    return made.filter(~F.col("metric").isin("p50_ms", "p95_ms")).withColumns({"delta": F.round("delta", 6), "ratio": F.round("ratio", 6)})


@query(f"{WITH_CALLS}, f AS (SELECT unnest(files) AS file, session FROM calls), x AS (SELECT file, bool_or(session < 3) AS a, bool_or(session BETWEEN 3 AND 5) AS b FROM f GROUP BY file) SELECT file, CASE WHEN a AND b THEN 'both' WHEN a THEN 'a' ELSE 'b' END AS side FROM x WHERE a OR b")
def p5_compare_files(spark, sf_dir):
    rows = T.calls(spark, sf_dir).select("session", F.explode("files").alias("file"))
    return C.compare_sets(rows.filter("session < 3"), rows.filter("session BETWEEN 3 AND 5"), "file")


@query(f"""{WITH_CALLS}, x AS (SELECT *, (t_ms - min(t_ms) OVER (PARTITION BY session < 75)) // 3600000 AS slot FROM calls),
  n AS (SELECT slot, count(*) FILTER (session < 75) AS a, count(*) FILTER (session >= 75) AS b FROM x GROUP BY slot)
  SELECT slot, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT unnest(range(0, (SELECT max(slot) + 1 FROM n))) AS slot) LEFT JOIN n USING (slot)""")
def w17_compare_slots(spark, sf_dir):
    """Calls per hour since each group's start, empty hours filled."""
    calls = T.calls(spark, sf_dir)
    return C.compare_slots(calls.filter("session < 75"), calls.filter("session >= 75"), 3_600_000)
