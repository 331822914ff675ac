"""Interval and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import intervals as I
from loomspan.operators import turns as U
from loomspan.queries import query
from loomspan.queries.calls import WITH_CALLS
from loomspan.sources import tables as T
from loomspan.streaming.open_calls import replayed
from loomspan.streaming.turns import replayed_turns


def spans(spark, sf_dir):
    """Timed calls as spans of 60 times their length, so that they overlap."""
    return T.calls(spark, sf_dir).filter("ms IS NOT NULL").select("seq", "session", "tool", F.col("t_ms").alias("t0"), (F.col("t_ms") + F.col("ms") * 60).alias("t1"))


SPANS_SQL = f"{WITH_CALLS}, spans AS (SELECT seq, session, tool, t_ms AS t0, t_ms + ms * 60 AS t1 FROM calls WHERE ms IS NOT NULL)"


@query(f"""{WITH_CALLS}, x AS (SELECT session, t_ms, t_ms - lag(t_ms) OVER (PARTITION BY session ORDER BY t_ms) AS g FROM calls),
  y AS (SELECT *, sum(CASE WHEN g <= 300000 THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS i FROM x),
  z AS (SELECT session, i, max(t_ms // 60000) + 1 - min(t_ms // 60000) AS m FROM y GROUP BY ALL) SELECT session, sum(m)::BIGINT AS active_minutes, count(*) AS stretches FROM z GROUP BY session""")
def w5_active_minutes(spark, sf_dir):
    """Active time of each session in whole minutes, pauses of up to five minutes included."""
    made = I.active_minutes(T.calls(spark, sf_dir), ["session"])
    return made.groupBy("session").agg(F.sum(F.col("end_minute") - F.col("first_minute")).alias("active_minutes"), F.count(F.lit(1)).alias("stretches"))


@query(f"""{SPANS_SQL}, x AS (SELECT *, max(t1) OVER (PARTITION BY session ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE t1 > t0),
  y AS (SELECT *, sum(CASE WHEN t0 > reach OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS i FROM x),
  z AS (SELECT session, i, min(t0) AS a, max(t1) AS b FROM y GROUP BY ALL) SELECT session, sum(b - a)::BIGINT AS union_ms, count(*) AS pieces FROM z GROUP BY session""")
def w6_interval_union(spark, sf_dir):
    return I.union_length(spans(spark, sf_dir), ["session"])


@query(f"""{SPANS_SQL}, ev AS (SELECT tool, seq, t0 AS t, 1 AS d FROM spans WHERE t1 > t0 UNION ALL SELECT tool, seq, t1, -1 FROM spans WHERE t1 > t0),
  sw AS (SELECT *, sum(d) OVER w AS open, coalesce(t - lag(t) OVER (PARTITION BY tool ORDER BY t, d), 0) AS gap FROM ev WINDOW w AS (PARTITION BY tool ORDER BY t, d ROWS UNBOUNDED PRECEDING)),
  pk AS (SELECT tool, max(open)::BIGINT AS peak, arg_max(t, (open, -t)) AS peak_at, sum(CASE WHEN open - d >= 2 THEN gap ELSE 0 END)::BIGINT AS at_least_2_ms, sum(CASE WHEN open - d >= 3 THEN gap ELSE 0 END)::BIGINT AS at_least_3_ms FROM sw GROUP BY tool),
  cv AS (SELECT tool, seq, t1 - t0 AS len, (SELECT sum(b - a) FROM (SELECT least(s.t1, max(o.t1)) AS b, greatest(s.t0, min(o.t0)) AS a FROM (
        SELECT *, sum(f) OVER (ORDER BY t0, t1, seq ROWS UNBOUNDED PRECEDING) AS i FROM (
          SELECT *, CASE WHEN t0 > max(t1) OVER (ORDER BY t0, t1, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM spans o2 WHERE o2.tool = s.tool AND o2.seq <> s.seq AND o2.t0 < s.t1 AND o2.t1 > s.t0)) o GROUP BY i)) AS c FROM spans s WHERE t1 > t0),
  sd AS (SELECT tool, count(*) AS calls, count(*) FILTER (coalesce(c, 0) * 2 >= len) AS over, quantile_cont(len, 0.5) FILTER (coalesce(c, 0) * 2 >= len) AS over_p50, quantile_cont(len, 0.5) FILTER (coalesce(c, 0) * 2 < len) AS alone_p50 FROM cv GROUP BY tool)
  SELECT sd.*, peak, peak_at, at_least_2_ms, at_least_3_ms, CASE WHEN over >= 10 AND calls - over >= 10 THEN over_p50 / alone_p50 END AS slowdown FROM sd JOIN pk USING (tool)""")
def w7_overlap_sweep(spark, sf_dir):
    """Contention per tool; the oracle unites every call's neighbours one by one."""
    return I.overlap(spans(spark, sf_dir), "tool", "seq")


@query(f"""{WITH_CALLS}, x AS (SELECT session, tool, row_number() OVER (PARTITION BY session ORDER BY seq) AS p, row_number() OVER (PARTITION BY session, tool ORDER BY seq) AS q FROM calls)
  SELECT session, tool, min(p) AS first, count(*) AS length FROM x GROUP BY session, tool, p - q HAVING count(*) >= 3""")
def w2_repeated_runs(spark, sf_dir):
    return I.runs(T.calls(spark, sf_dir), ["session"], ["seq"], ["tool"]).filter("length >= 3")


@query(f"""{WITH_CALLS}, x AS (SELECT session, seq, (out % 7000) AS c, coalesce(lag(out % 7000) OVER (PARTITION BY session ORDER BY seq), 0) AS b FROM calls WHERE out IS NOT NULL) SELECT session, seq, CASE WHEN c < b THEN c ELSE c - b END AS c_delta FROM x""")
def w11_counter_deltas(spark, sf_dir):
    rows = T.calls(spark, sf_dir).filter("out IS NOT NULL").select("session", "seq", (F.col("out") % 7000).alias("c"))
    return I.counter_deltas(rows, ["session"], ["seq"], ["c"]).drop("c")


@query(f"{WITH_CALLS} SELECT a.seq, (SELECT max(b.seq) FROM calls b WHERE b.session = a.session AND b.tool = 'click' AND b.t_ms <= a.t_ms) AS click FROM calls a WHERE a.tool = 'purchase'")
def j7_latest_click(spark, sf_dir):
    """The latest click of the session at or before each purchase."""
    calls = T.calls(spark, sf_dir)
    clicks = calls.filter("tool = 'click'").select("session", "t_ms", F.col("seq").alias("click"))
    return I.as_of(calls.filter("tool = 'purchase'").select("seq", "session", "t_ms"), clicks, "session", "t_ms", "click").select("seq", "click")


@query(f"{WITH_CALLS} SELECT a.seq, (SELECT min(b.seq) FROM calls b WHERE b.session = a.session AND b.tool = 'view' AND b.t_ms >= a.t_ms) AS view FROM calls a WHERE a.tool = 'signup'")
def j17_next_view(spark, sf_dir):
    calls = T.calls(spark, sf_dir)
    views = calls.filter("tool = 'view'").select("session", "t_ms", F.col("seq").alias("view"))
    return I.as_of(calls.filter("tool = 'signup'").select("seq", "session", "t_ms"), views, "session", "t_ms", "view", forward=True).select("seq", "view")


def _writes(spark, sf_dir):
    c = T.calls(spark, sf_dir).filter("tool IN ('click', 'purchase')")
    return c.select("session", "t_ms", F.concat(F.lit("w"), F.col("session") % 3).alias("top"), F.explode("files").alias("rel"))


_WRITES = "writes AS (SELECT session, t_ms, 'w' || session % 3 AS top, unnest(files) AS rel FROM calls WHERE tool IN ('click', 'purchase')), spawns AS (SELECT DISTINCT session - session % 10 AS parent, session AS child, 1704067200000 AS t0, 1705000000000 AS t1 FROM calls WHERE session % 10 <> 0)"


@query(f"""{WITH_CALLS}, {_WRITES}, p AS (SELECT DISTINCT a.rel, a.session AS a_session, b.session AS b_session, a.t_ms AS a_t, b.t_ms AS b_t, a.top AS a_top, b.top AS b_top FROM writes a JOIN writes b ON a.rel = b.rel AND a.session <> b.session AND b.t_ms - a.t_ms BETWEEN 0 AND 600000 AND (b.t_ms > a.t_ms OR b.session > a.session)),
  q AS (SELECT p.*, d.parent IS NOT NULL OR u.parent IS NOT NULL AS told, CASE WHEN d.parent IS NOT NULL THEN a_t BETWEEN d.t0 AND d.t1 WHEN u.parent IS NOT NULL THEN b_t BETWEEN u.t0 AND u.t1 END AS inside FROM p
    LEFT JOIN spawns d ON d.parent = a_session AND d.child = b_session LEFT JOIN spawns u ON u.parent = b_session AND u.child = a_session)
  SELECT rel, a_session, b_session, a_t, b_t, CASE WHEN a_top = b_top THEN 'conflict' ELSE 'overlap' END AS mark, coalesce(inside, false) AS race FROM q WHERE coalesce(inside, true)""")
def j9_write_conflicts(spark, sf_dir):
    """Writes of different sessions to one file within ten minutes."""
    writes = _writes(spark, sf_dir)
    s = F.col("session")
    spawns = writes.select(s).distinct().filter(s % 10 != 0).select((s - s % 10).alias("parent"), s.alias("child"), F.lit(1704067200000).alias("t0"), F.lit(1705000000000).alias("t1"))
    return I.conflict_marks(writes, spawns, 600_000)


@query(f"{WITH_CALLS}, {_WRITES} SELECT DISTINCT c.top, c.session AS c_session, c.t_ms AS c_t, w.session AS w_session, w.t_ms AS w_t FROM (SELECT session, t_ms, 'w' || session % 3 AS top FROM calls WHERE tool = 'error') c JOIN writes w ON c.top = w.top AND c.session <> w.session AND c.t_ms - w.t_ms BETWEEN 0 AND 300000")
def j10_clobbers(spark, sf_dir):
    commands = T.calls(spark, sf_dir).filter("tool = 'error'").select("session", "t_ms", F.concat(F.lit("w"), F.col("session") % 3).alias("top"))
    return I.clobbers(commands, _writes(spark, sf_dir), 300_000)


@query(f"{SPANS_SQL} SELECT tool AS row, t0 // 21600000 AS cell, count(*) AS n, min(t0) AS t0, max(t1) AS t1 FROM spans GROUP BY ALL")
def w16_timeline(spark, sf_dir):
    return I.timeline(spans(spark, sf_dir), F.col("tool"), 21_600_000)


@query(f"""{SPANS_SQL}, t AS (SELECT seq AS id, CASE WHEN seq % 4 <> 0 THEN seq - seq % 4 END AS parent, tool, t0, t1 FROM spans), k AS (SELECT parent AS id, sum(t1 - t0) AS inner_ms FROM t WHERE parent IS NOT NULL GROUP BY parent)
  SELECT tool, count(*) AS n, sum(t1 - t0)::BIGINT AS total_ms, sum(greatest(t1 - t0 - coalesce(inner_ms, 0), 0))::BIGINT AS self_ms, max(t1 - t0) AS max_ms FROM t LEFT JOIN k USING (id) GROUP BY tool""")
def a29_self_time(spark, sf_dir):
    s = F.col("seq")
    tree = spans(spark, sf_dir).select(s.alias("id"), F.when(s % 4 != 0, s - s % 4).alias("parent"), "tool", "t0", "t1", F.lit(0).alias("graph"))
    return I.self_time(tree, ["graph"], "tool")


@query("SELECT conv_id AS session, turn AS seq, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM conversations")
def w1_turns(spark, sf_dir):
    rows = T.turns(spark, sf_dir).select("session", "seq", "role")
    return I.turn_numbers(rows, ["session"], ["seq"], F.col("role") == "user").drop("role")


@query(f"{WITH_CALLS} SELECT a.seq, (SELECT max(b.seq) FROM calls b WHERE b.session = a.session AND b.tool = 'view' AND b.seq < a.seq) AS cause FROM calls a WHERE a.err")
def f25_error_causes(spark, sf_dir):
    rows = T.calls(spark, sf_dir).select("session", "seq", "tool", "err")
    return I.causes(rows, ["session"], "seq", F.coalesce("err", F.lit(False)), F.col("tool") == "view").select("seq", "cause")


@query(f"""{WITH_CALLS}, a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM calls WHERE tool = 'click'), b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS n FROM calls WHERE tool = 'view')
  SELECT a.seq, b.seq AS result_seq, b.t_ms - a.t_ms AS took FROM a LEFT JOIN b USING (session, n)""")
def j1_call_results(spark, sf_dir):
    """Calls and results paired first in, first out."""
    c = T.calls(spark, sf_dir).select("session", "seq", "t_ms", "tool")
    made = I.pair_results(c.filter("tool = 'click'").drop("tool"), c.filter("tool = 'view'").drop("tool"), ["session"], "seq")
    return made.select("seq", "result_seq", (F.col("result_t_ms") - F.col("t_ms")).alias("took"))


@query(f"""{SPANS_SQL.replace("WITH", "WITH RECURSIVE", 1)}, o AS (SELECT session, seq, t0, t1, row_number() OVER (PARTITION BY session ORDER BY t0, t1, seq) AS n FROM spans),
  p AS (SELECT session, seq, t0, t1, n, 0::BIGINT AS lane, [t1] AS ends FROM o WHERE n = 1 UNION ALL
    SELECT session, seq, t0, t1, n, lane, ends[1:lane] || [t1] || ends[lane + 2:] FROM (
      SELECT o.*, p.ends, (coalesce(list_position(list_transform(p.ends, lambda e: e <= o.t0), true), len(p.ends) + 1) - 1)::BIGINT AS lane FROM p JOIN o ON o.session = p.session AND o.n = p.n + 1))
  SELECT session, seq, t0, t1, lane FROM p""")
def w8_lanes(spark, sf_dir):
    """Greedy lanes of each session's spans."""
    return I.lanes(spans(spark, sf_dir).select("session", "seq", "t0", "t1"), ["session"])


@query(f"""{WITH_CALLS.replace("WITH", "WITH RECURSIVE", 1)}, ev AS (
    SELECT session, CASE WHEN seq % 3 > 0 THEN seq % 2 END AS id, CASE tool WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS kind, seq, t_ms, coalesce(err, false) AS err FROM calls WHERE tool IN ('click', 'view', 'purchase')
  ), o AS (SELECT *, coalesce(id, -1) AS k, row_number() OVER (PARTITION BY session, id ORDER BY seq) AS n FROM ev),
  s AS (SELECT session, k, 0::BIGINT AS n, 0::BIGINT AS opened, 0::BIGINT AS closed, false AS hit, 0::BIGINT AS seq, 0::BIGINT AS t_ms, 0 AS kind, false AS err FROM (SELECT DISTINCT session, k FROM o)
    UNION ALL SELECT o.session, o.k, o.n, opened + (o.kind = 1)::BIGINT, closed + (o.kind = 2 AND closed < opened)::BIGINT, (o.kind = 2 AND closed < opened) OR (o.kind = 3 AND closed > 0), o.seq, o.t_ms, o.kind, o.err
    FROM s JOIN o ON o.session = s.session AND o.k = s.k AND o.n = s.n + 1)
  SELECT c.seq AS place, max(e.t_ms - c.t_ms) AS ms, bool_or(e.err) AS err FROM s c JOIN s e ON c.kind = 1 AND e.hit AND e.session = c.session AND e.k = c.k AND e.closed = c.opened
  WHERE e.kind = 2 OR e.t_ms - c.t_ms < 86400000 GROUP BY c.session, c.k, c.seq""")
def l6_open_calls(spark, sf_dir):
    """Calls closed by later results through streaming state, the table being replayed as a log in four runs."""
    kind = F.when(F.col("tool") == "click", "call").when(F.col("tool") == "view", "result").when(F.col("tool") == "purchase", "more")
    call_id = F.when(F.col("seq") % 3 > 0, (F.col("seq") % 2).cast("string"))
    rows = T.calls(spark, sf_dir).select(F.col("session").cast("string").alias("file"), call_id.alias("call_id"), kind.alias("kind"), F.col("seq").cast("long").alias("place"), F.col("t_ms").cast("long").alias("t_ms"), F.col("tool").alias("name"), "err")
    return replayed(rows.filter("kind IS NOT NULL"), "place", 4, most=1 << 20).filter("ms IS NOT NULL").select("place", "ms", "err")


QUIET = 28_800_000


def log_lines(spark, sf_dir):
    """Events as log lines: clicks are prompts, purchases and half the errors what the harness says of turns, views activity; every
    seventh line has no time, signups are passed over."""
    c = T.calls(spark, sf_dir)
    said = F.when(F.col("tool") == "purchase", "turn started").when(F.col("seq") % 2 == 0, "turn aborted").otherwise(F.concat(F.lit("turn complete · "), F.col("seq") % 90, F.lit(".5s")))
    kind = F.when(F.col("tool") == "click", "user").when(F.col("tool") == "view", "tool").otherwise("meta")
    rows = c.withColumn("text", F.when(F.col("tool").isin("purchase", "error"), said).otherwise(F.col("tool"))).withColumn("kind", U.line_kind(kind, F.col("text")))
    return rows.select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("place"), "kind", F.when(F.col("seq") % 7 != 0, F.col("t_ms")).cast("long").alias("t_ms"), U.told_ms(F.col("text")).alias("ms"))


#: The automaton step by step, one line of every session at a time.
TURNS_SQL = f"""{WITH_CALLS.replace("WITH", "WITH RECURSIVE", 1)}, ln AS (
    SELECT session::VARCHAR AS session, seq AS place, row_number() OVER (PARTITION BY session ORDER BY seq) AS i, CASE WHEN seq % 7 <> 0 THEN t_ms END AS t,
      CASE tool WHEN 'click' THEN 'prompt' WHEN 'view' THEN 'activity' WHEN 'purchase' THEN 'started' WHEN 'error' THEN CASE WHEN seq % 2 = 0 THEN 'aborted' ELSE 'complete' END END AS kind,
      CASE WHEN tool = 'error' AND seq % 2 = 1 THEN (seq % 90) * 1000 + 500 END AS ms FROM calls),
  a AS (
    SELECT session, 0::BIGINT AS i, NULL::BIGINT AS last, false AS open, false AS waits, '' AS why, 0::BIGINT AS n, false AS opened, false AS filled, false AS quieted, '' AS shut, NULL::BIGINT AS place, NULL::VARCHAR AS kind, NULL::BIGINT AS t, NULL::BIGINT AS ms, NULL::BIGINT AS was, false AS late
    FROM ln GROUP BY session
    UNION ALL
    SELECT session, i, greatest(last, t), CASE WHEN opens THEN true WHEN shuts THEN false ELSE open1 END, CASE WHEN opens THEN kind = 'started' WHEN shuts OR fills THEN false ELSE waits1 END,
      CASE WHEN shuts THEN kind ELSE why1 END, n + opens::BIGINT, opens, fills, quiet, CASE WHEN shuts THEN kind ELSE '' END, place, kind, t, ms, last, opens AND kind = 'activity' AND why1 = 'quiet'
    FROM (SELECT *, coalesce(kind IN ('complete', 'aborted'), false) AND open1 AS shuts, coalesce(kind = 'prompt', false) AND waits1 AS fills,
        coalesce(kind = 'started' OR (kind = 'prompt' AND NOT waits1) OR (kind = 'activity' AND NOT open1), false) AS opens
      FROM (SELECT *, open AND NOT quiet AS open1, waits AND NOT quiet AS waits1, CASE WHEN quiet THEN 'quiet' ELSE why END AS why1
        FROM (SELECT a.session, ln.i, a.last, a.open, a.waits, a.why, a.n, ln.place, ln.kind, ln.ms, coalesce(ln.t, a.last) AS t, a.open AND coalesce(coalesce(ln.t, a.last) - a.last > {QUIET}, false) AS quiet
          FROM a JOIN ln ON ln.session = a.session AND ln.i = a.i + 1)))),
  o AS (SELECT session, n, kind, place, t, late FROM a WHERE opened),
  f AS (SELECT session, n, min(place) AS place FROM a WHERE filled OR (opened AND kind = 'prompt') GROUP BY ALL),
  c AS (SELECT session, n, kind, last, t, ms FROM a WHERE shut <> ''),
  q AS (SELECT session, n - opened::BIGINT AS n, was FROM a WHERE quieted),
  x AS (SELECT session, n - 1 AS n, last FROM a WHERE opened),
  e AS (SELECT session, max(last) AS last FROM a GROUP BY session)
  SELECT o.session, o.n AS turn, o.kind AS opened_by, o.place, f.place AS prompt_place, least(o.t, CASE WHEN c.ms > 0 THEN c.t - c.ms END) AS t0,
    greatest(o.t, CASE WHEN c.kind IS NOT NULL THEN c.last WHEN q.n IS NOT NULL THEN q.was WHEN x.n IS NOT NULL THEN x.last ELSE e.last END) AS t1,
    CASE WHEN c.kind IS NOT NULL THEN c.kind WHEN q.n IS NOT NULL THEN 'quiet' WHEN x.n IS NOT NULL THEN 'next' ELSE 'open' END AS closed_by, o.late
  FROM o JOIN e USING (session) LEFT JOIN f USING (session, n) LEFT JOIN c USING (session, n) LEFT JOIN q USING (session, n) LEFT JOIN x USING (session, n)"""


@query(TURNS_SQL)
def w1_turn_spans(spark, sf_dir):
    """Turns of every session with what opened and closed them."""
    return U.turn_spans(log_lines(spark, sf_dir), ["session"], "place", QUIET)


@query(TURNS_SQL)
def i6_running_turns(spark, sf_dir):
    """The same turns by the running summary, the table being replayed as a log in four runs."""
    return replayed_turns(log_lines(spark, sf_dir), "place", 4, QUIET)


@query(f"""{WITH_CALLS}, sp AS (SELECT session, seq AS id, CASE WHEN seq % 2 = 0 THEN seq // 4 END AS call_id, seq AS place, seq % 61 = 0 AS spawns, seq % 4 AS depth, t_ms AS t0, t_ms + ms * 20000 AS t1 FROM calls WHERE ms IS NOT NULL),
  ch AS (SELECT session, seq AS child, CASE WHEN seq % 3 = 0 THEN seq // 4 END AS call_id, CASE WHEN seq % 5 <> 0 THEN t_ms END AS t FROM calls),
  i AS (SELECT child, min(id) AS id FROM ch JOIN sp USING (session, call_id) GROUP BY child),
  s AS (SELECT child, max(place) AS id FROM ch JOIN sp ON sp.session = ch.session AND spawns AND t0 <= t + 1000 GROUP BY child),
  e AS (SELECT child, arg_max(id, r) AS id FROM (SELECT child, {{'depth': depth, 'place': place, 'id': id}} AS r, depth, place, id FROM ch JOIN sp ON sp.session = ch.session AND t BETWEEN t0 AND t1) GROUP BY child)
  SELECT session, child, CASE WHEN i.id IS NOT NULL THEN 'id' WHEN s.id IS NOT NULL THEN 'spawn' WHEN e.id IS NOT NULL THEN 'enclosing' END AS how, coalesce(i.id, s.id, e.id) AS host
  FROM ch LEFT JOIN i USING (child) LEFT JOIN s USING (child) LEFT JOIN e USING (child)""")
def j7_attached_spans(spark, sf_dir):
    """Where each call would hang as a subagent of its session: by id, by the latest spawning call, by the innermost span around it."""
    c, s = T.calls(spark, sf_dir), F.col("seq")
    quarter = F.floor(s / 4)
    held = c.filter("ms IS NOT NULL").select("session", s.alias("id"), F.when(s % 2 == 0, quarter).alias("call_id"), s.alias("place"), (s % 61 == 0).alias("spawns"), (s % 4).alias("depth"), F.col("t_ms").alias("t0"), (F.col("t_ms") + F.col("ms") * 20000).alias("t1"))
    children = c.select("session", s.alias("child"), F.when(s % 3 == 0, quarter).alias("call_id"), F.when(s % 5 != 0, F.col("t_ms")).alias("t"))
    return U.attach_spans(children, held, ["session"]).select("session", "child", "how", "host")
