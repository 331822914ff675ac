"""Cost queries: prices resolved once per model, cost as a view, modes, projection, budget, ownership and fleet merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.operators import aggregate as A
from loomspan.operators import cost as K
from loomspan.operators import ownership as O
from loomspan.operators import rules as R
from loomspan.queries import query
from loomspan.queries.calls import WITH_CALLS
from loomspan.sources import tables as T

# An example price table: m3 and m6 stay unpriced, m1 by its longer prefix, m2 by alias, m5 at a gateway for provider O.
PRICES = [
    ("built-in", None, "m0", 3.0, 15.0, None, None, None, None),
    ("built-in", None, "m1", 2.0, 8.0, 0.2, 2.5, 4.0, None),
    ("community", None, "m4", 5.0, 25.0, 0.5, None, None, None),
    ("user", None, "m4", 4.0, 20.0, None, None, None, None),
    ("alias", None, "m2", None, None, None, None, None, "m0"),
    ("gateway", "O", "m5", 7.0, 9.0, None, 8.0, None, None),
]


def prices(spark):
    return spark.createDataFrame(PRICES, K.PRICE_SCHEMA)


def booked(spark, sf_dir):
    return K.priced(T.requests(spark, sf_dir), prices(spark))


_PRICED = """p(id, provider, src, i, o, cr, cw, cw1) AS (VALUES
    ('m0', NULL, 'built-in', 3.0, 15.0, 0.3, 3.75, 6.0), ('m1', NULL, 'built-in', 2.0, 8.0, 0.2, 2.5, 4.0), ('m2', NULL, 'alias', 3.0, 15.0, 0.3, 3.75, 6.0),
    ('m4', NULL, 'user', 4.0, 20.0, 0.4, 5.0, 8.0), ('m5', 'O', 'gateway', 7.0, 9.0, 0.7, 8.0, 14.0)),
  booked AS (SELECT r.*, CASE WHEN usd_reported > 0 THEN usd_reported ELSE (input * i::DOUBLE + output * o::DOUBLE + cache_read * cr::DOUBLE + write_5m * cw::DOUBLE + write_1h * cw1::DOUBLE) / 1e6 END AS cost,
      CASE WHEN usd_reported > 0 THEN 'reported' ELSE src END AS price_source, input + output + cache_read + write_5m + write_1h AS toks
    FROM requests r LEFT JOIN p ON p.id = left(model, 2) AND (p.provider IS NULL OR p.provider = r.provider))"""
WITH_COST = f"WITH {T.REQUESTS_SQL}, {_PRICED}"


@query(f"{WITH_COST} SELECT model, provider, price_source, count(*) AS requests, round(sum(cost), 4) AS cost, sum(toks)::BIGINT AS tokens FROM booked GROUP BY ALL")
def k12_price_report(spark, sf_dir):
    """Layered price resolution, reported costs first, unpriced tokens never $0."""
    return K.price_report(booked(spark, sf_dir)).withColumn("cost", F.round("cost", 4))


@query(f"""{WITH_COST} SELECT model, grouping(model)::INT AS is_total, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(write_5m + write_1h)::BIGINT AS cache_write,
  sum(CASE WHEN cost IS NULL THEN toks ELSE 0 END)::BIGINT AS unpriced_tokens, count(DISTINCT session) AS sessions, round(sum(cost), 4) AS cost FROM booked GROUP BY ROLLUP (model)""")
def a16_cost_by_model(spark, sf_dir):
    return A.rollup_cost(booked(spark, sf_dir), "model").withColumn("cost", F.round("cost", 4)).withColumn("is_total", F.col("is_total").cast("int"))


_EXACT = "(SELECT * EXCLUDE (cost), cost::DECIMAL(18,8) AS cost FROM booked)"


@query(f"""{WITH_COST} SELECT day, round(sum(CASE WHEN mode = 'A' THEN cost ELSE 0 END), 4)::DOUBLE AS cost_a, round(sum(CASE WHEN mode = 'N' THEN cost ELSE 0 END), 4)::DOUBLE AS cost_n, round(sum(CASE WHEN mode = 'R' THEN cost ELSE 0 END), 4)::DOUBLE AS cost_r,
  round(sum(cost), 4)::DOUBLE AS cost, sum(CASE WHEN cost IS NULL THEN toks ELSE 0 END)::BIGINT AS unpriced_tokens, round(sum(CASE WHEN price_source = 'alias' THEN cost ELSE 0 END), 4)::DOUBLE AS estimated FROM {_EXACT} GROUP BY day""")
def k7_mode_sums(spark, sf_dir):
    rows = booked(spark, sf_dir).withColumn("cost", F.col("cost").cast("decimal(18,8)"))
    made = K.mode_sums(rows, ["day"], ("A", "N", "R"))
    return made.withColumns({c: F.round(c, 4).cast("double") for c in ("cost_a", "cost_n", "cost_r", "cost", "estimated")})


@query(f"""{WITH_COST}, x AS (SELECT *, unnest(list_filter([CASE WHEN day = DATE '1998-06-15' THEN 'today' END, CASE WHEN day BETWEEN DATE '1998-06-09' AND DATE '1998-06-15' THEN 'week' END, CASE WHEN day BETWEEN DATE '1998-06-01' AND DATE '1998-06-15' THEN 'month' END], lambda p: p IS NOT NULL)) AS period FROM {_EXACT})
  SELECT period, round(sum(CASE WHEN mode = 'A' THEN cost ELSE 0 END), 4)::DOUBLE AS cost_a, round(sum(CASE WHEN mode = 'N' THEN cost ELSE 0 END), 4)::DOUBLE AS cost_n, round(sum(CASE WHEN mode = 'R' THEN cost ELSE 0 END), 4)::DOUBLE AS cost_r,
  round(sum(cost), 4)::DOUBLE AS cost, sum(CASE WHEN cost IS NULL THEN toks ELSE 0 END)::BIGINT AS unpriced_tokens, round(sum(CASE WHEN price_source = 'alias' THEN cost ELSE 0 END), 4)::DOUBLE AS estimated FROM x GROUP BY period""")
def k11_summary(spark, sf_dir):
    """Today, seven days and the month so far, by mode."""
    made = K.summary(booked(spark, sf_dir).withColumn("cost", F.col("cost").cast("decimal(18,8)")), "1998-06-15", ("A", "N", "R"))
    return made.withColumns({c: F.round(c, 4).cast("double") for c in ("cost_a", "cost_n", "cost_r", "cost", "estimated")})


@query(f"""{WITH_COST} SELECT session, grouping(session)::INT AS is_total, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(write_5m + write_1h)::BIGINT AS cache_write,
  sum(CASE WHEN cost IS NULL THEN toks ELSE 0 END)::BIGINT AS unpriced_tokens, count(DISTINCT session) AS sessions, round(sum(cost), 4)::DOUBLE AS cost FROM {_EXACT} GROUP BY ROLLUP (session)""")
def a16_cost_by_session(spark, sf_dir):
    rows = booked(spark, sf_dir).withColumn("cost", F.col("cost").cast("decimal(18,8)"))
    return A.rollup_cost(rows, "session").withColumn("cost", F.round("cost", 4).cast("double")).withColumn("is_total", F.col("is_total").cast("int"))


@query(f"{WITH_COST}, u AS (SELECT model, sum(toks) AS t, row_number() OVER (ORDER BY sum(toks) DESC, model) AS n FROM booked WHERE cost IS NULL GROUP BY model) SELECT CASE WHEN n <= 3 THEN model ELSE '(more)' END AS model, sum(t)::BIGINT AS tokens, count(*) AS models FROM u GROUP BY 1")
def k13_unpriced(spark, sf_dir):
    return K.unpriced(booked(spark, sf_dir), 3)


@query(f"""{WITH_COST}, d AS (SELECT day, sum(cost) AS c FROM booked WHERE day >= DATE '1998-06-01' AND day < DATE '1998-06-15' GROUP BY day HAVING sum(cost) > 0),
  h AS (SELECT hour, sum(cost) / (SELECT count(*) FROM d) AS p FROM booked SEMI JOIN d USING (day) GROUP BY hour),
  n AS (SELECT coalesce(sum(cost), 0) AS spent, coalesce(sum(cost) FILTER (hour = 9), 0) AS this_hour FROM booked WHERE day = DATE '1998-06-15')
  SELECT round(spent, 4) AS spent, (SELECT count(*) FROM d) AS active, round(CASE WHEN (SELECT count(*) FROM d) >= 3 THEN spent + (SELECT coalesce(sum(p), 0) FROM h WHERE hour > 9) + greatest(0, (SELECT coalesce(sum(p), 0) FROM h WHERE hour = 9) - this_hour) END, 4) AS projected FROM n""")
def k8_project_today(spark, sf_dir):
    return K.project_today(booked(spark, sf_dir), "1998-06-15", 9).withColumns({"spent": F.round("spent", 4), "projected": F.round("projected", 4)})


@query(f"""{WITH_COST}, d AS (SELECT day, sum(cost) AS c FROM booked WHERE day >= DATE '1998-06-01' AND day < DATE '1998-06-15' GROUP BY day),
  s AS (SELECT count(*) FILTER (c > 0) AS active, min(day) FILTER (c > 0) AS first, sum(c) AS total FROM d), m AS (SELECT coalesce(sum(cost), 0) AS mtd FROM booked WHERE day BETWEEN DATE '1998-06-01' AND DATE '1998-06-15')
  SELECT round(mtd, 4) AS month_to_date, active, round(CASE WHEN active >= 3 THEN mtd + 15 * total / (DATE '1998-06-15' - first) END, 4) AS projected,
    CASE WHEN mtd >= 500 THEN 'over' WHEN mtd + 15 * total / (DATE '1998-06-15' - first) > 500 OR mtd >= 400 THEN 'watch' ELSE 'ok' END AS state FROM s, m""")
def k9_project_month(spark, sf_dir):
    """The month's projection and the state of a budget of $500."""
    made = K.project_month(booked(spark, sf_dir), "1998-06-15", 15, None)
    made = made.withColumn("state", K.budget_state(F.col("month_to_date"), F.col("projected"), 500.0))
    return made.withColumns({"month_to_date": F.round("month_to_date", 4), "projected": F.round("projected", 4)})


@query(f"{WITH_COST}, x AS (SELECT * EXCLUDE (cost), CASE WHEN usd_reported > 0 THEN usd_reported WHEN left(model, 2) IN ('m3', 'm6') THEN (input * 1.0 + output * 2.0 + cache_read * 0.1 + write_5m * 1.25 + write_1h * 2.0) / 1e6 ELSE cost END AS cost FROM booked) SELECT round(sum(cost), 4) AS cost, count(*) FILTER (cost IS NULL) AS unpriced FROM x")
def k5_repriced(spark, sf_dir):
    """A new price row re-prices all history: the same view over another table. The gateway's model has no other price."""
    more = prices(spark).unionByName(spark.createDataFrame([("community", None, m, 1.0, 2.0, None, None, None, None) for m in ("m3", "m6")], K.PRICE_SCHEMA))
    rows = K.priced(T.requests(spark, sf_dir), more)
    return rows.agg(F.round(F.sum("cost"), 4).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


# Copies: a line of an order appears on several hosts; the first in the order of appearance books it.


def _copies(spark, sf_dir):
    r = T.requests(spark, sf_dir)
    s = F.col("session")
    return r.select(
        (F.col("input") + F.col("cache_read") + s % 50).alias("message"), "host", "session", "day", "hour", "model", "output",
        O.message_order(F.unix_date("day").cast("long") * 86_400_000 + F.col("hour") * 3_600_000, F.col("host") % 2 == 1).alias("order_key"),
    )


_COPIES = "copies AS (SELECT input + cache_read + session % 50 AS message, host, session, day, hour, model, output, ((day - DATE '1970-01-01')::BIGINT * 86400000 + hour * 3600000) * 2 + host % 2 AS order_key FROM requests)"
_ORDER = ["order_key", "host", "session", "model", "output"]


@query(f"WITH {T.REQUESTS_SQL}, {_COPIES} SELECT message, host, session, output, order_key FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY order_key, host, session, model, output) AS n FROM copies) WHERE n = 1")
def d1_message_owners(spark, sf_dir):
    """Owner of each message across hosts: smallest order key, host, session."""
    return O.owned(_copies(spark, sf_dir), ["message"], _ORDER).select("message", "host", "session", "output", "order_key")


@query(f"WITH {T.REQUESTS_SQL}, {_COPIES}, o AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY order_key, host, session, model, output) AS n FROM copies) SELECT host, sum(output)::BIGINT AS output_held, sum(CASE WHEN n > 1 THEN output ELSE 0 END)::BIGINT AS output_lost, round(least(1, sum(CASE WHEN n > 1 THEN output ELSE 0 END) / sum(output)::DOUBLE), 9) AS lost_share FROM (SELECT c.*, w.message IS NOT NULL AS won, CASE WHEN w.message IS NOT NULL THEN 1 ELSE 2 END AS n FROM copies c LEFT JOIN (SELECT message, host FROM o WHERE n = 1) w USING (message, host)) GROUP BY host")
def d3_lost_shares(spark, sf_dir):
    """What each host held of messages that another host owns, as the share by which its derived rows shrink."""
    rows = _copies(spark, sf_dir)
    made = O.lost_shares(rows, O.owned(rows, ["message"], _ORDER), ["message"], ["host"], ["output"])
    return made.withColumn("lost_share", F.round("lost_share", 9))


@query(f"WITH {T.REQUESTS_SQL}, {_COPIES}, x AS (SELECT day + INTERVAL 1 HOUR * (hour - 7) AS t, output FROM copies) SELECT t::DATE AS day, hour(t)::BIGINT AS hour, sum(output)::BIGINT AS output FROM x GROUP BY ALL")
def d4_other_time_zone(spark, sf_dir):
    return O.shifted(_copies(spark, sf_dir), -7).groupBy("day", "hour").agg(F.sum("output").alias("output"))


@query("SELECT host, supplier, generation FROM (SELECT s_nationkey AS host, s_name AS supplier, s_suppkey AS generation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS n FROM supplier) WHERE n = 1")
def w12_latest_state(spark, sf_dir):
    """Newest report of each host."""
    rows = T.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("host"), F.col("s_name").alias("supplier"), F.col("s_suppkey").alias("generation"))
    return O.latest(rows, ["host"], "generation")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'remove' ELSE 'upsert' END AS change FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0")
def l9_patch(spark, sf_dir):
    """A topic's patch: rows that changed and keys that went."""
    old = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    new = old.filter("id % 10 <> 0").withColumn("c_acctbal", F.when(F.col("id") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return O.changes(old, new, ["id"])


@query(f"""{WITH_CALLS}, w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_ms DESC, seq DESC) AS n FROM calls WHERE err IS NOT NULL)
  SELECT session, count(*) AS tool_calls, count(*) FILTER (err) AS tool_errors, count(err) AS done, max(t_ms) AS at_ms, CASE WHEN count(err) >= 5 THEN count(*) FILTER (err) / count(err)::DOUBLE END AS tool_error_rate FROM w WHERE n <= 20 GROUP BY session""")
def r5_call_metrics(spark, sf_dir):
    """Error rate over each session's last 20 calls with a result."""
    return R.call_metrics(T.calls(spark, sf_dir), 20, 5)


ERROR_RATE = R.Rule("flaky", "tool_error_rate", ">=", degraded=0.3, critical=0.45)


@query(f"""{WITH_CALLS}, w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_ms DESC, seq DESC) AS n FROM calls WHERE err IS NOT NULL), m AS (SELECT session, count(*) FILTER (err) / count(err)::DOUBLE AS v FROM w WHERE n <= 20 GROUP BY session HAVING count(err) >= 5)
  SELECT session, 'flaky' AS rule, CASE WHEN v >= 0.45 THEN 2 ELSE 1 END::INT AS level, v AS value FROM m WHERE v >= 0.3""")
def r9_snapshot_alerts(spark, sf_dir):
    return R.snapshot(R.call_metrics(T.calls(spark, sf_dir), 20, 5), [ERROR_RATE])


@query(f"""{WITH_CALLS}, s AS (SELECT session, seq, CASE WHEN ms >= 20000 THEN 2 WHEN ms >= 10000 THEN 1 ELSE 0 END AS lv, ms, t_ms FROM calls), t AS (SELECT *, coalesce(lag(lv) OVER (PARTITION BY session ORDER BY t_ms), 0) AS was FROM s)
  SELECT session, 'slow' AS rule, t_ms, was::INT AS from_level, lv::INT AS to_level, CASE WHEN was = 0 THEN 'fire' WHEN lv = 0 THEN 'resolve' WHEN lv > was THEN 'escalate' ELSE 'deescalate' END AS state, ms::DOUBLE AS value FROM t WHERE lv <> was""")
def r7_rule_transitions(spark, sf_dir):
    """Level changes of a rule on call durations in seconds; an untimed call is an absent value."""
    samples = T.calls(spark, sf_dir).select("session", "t_ms", F.col("ms").alias("value"))
    return R.transitions(samples, R.Rule("slow", "command_age", ">=", degraded=10000, critical=20000))


@query(f"""{WITH_CALLS}, s AS (SELECT session, t_ms, ms::DOUBLE AS value, coalesce(ms >= 1000, false) AS d, coalesce(ms >= 10000, false) AS c FROM calls),
  g AS (SELECT *, sum((NOT d)::INT) OVER w AS gd, sum((NOT c)::INT) OVER w AS gc FROM s WINDOW w AS (PARTITION BY session ORDER BY t_ms ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, CASE WHEN c AND t_ms - min(CASE WHEN c THEN t_ms END) OVER (PARTITION BY session, gc) >= 600000 THEN 2 WHEN d AND t_ms - min(CASE WHEN d THEN t_ms END) OVER (PARTITION BY session, gd) >= 600000 THEN 1 ELSE 0 END AS lv FROM g),
  t AS (SELECT *, coalesce(lag(lv) OVER (PARTITION BY session ORDER BY t_ms), 0) AS was FROM l)
  SELECT session, 'slow' AS rule, t_ms, was::INT AS from_level, lv::INT AS to_level, CASE WHEN was = 0 THEN 'fire' WHEN lv = 0 THEN 'resolve' WHEN lv > was THEN 'escalate' ELSE 'deescalate' END AS state, value FROM t WHERE lv <> was""")
def r7_rule_hold_time(spark, sf_dir):
    """The same with a hold time of ten minutes."""
    samples = T.calls(spark, sf_dir).select("session", "t_ms", F.col("ms").cast("double").alias("value"))
    return R.transitions(samples, R.Rule("slow", "command_age", ">=", degraded=1000, critical=10000, hold_s=600))


@query(None)
def i14_skill_attribution(spark, sf_dir):
    """Carried and loaded skill tokens of each request, and the skill table over them."""
    r = T.requests(spark, sf_dir)
    seq = F.unix_date("day").cast("long") * 100 + F.col("hour")
    requests = r.groupBy("session", seq.alias("seq")).agg(*(F.sum(c).alias(c) for c in ("input", "cache_read", "write_5m", "write_1h")))
    requests = requests.withColumn("context", F.col("input") + F.col("cache_read") + F.col("write_5m") + F.col("write_1h"))
    loads = r.filter("host % 3 = 0").select("session", seq.alias("seq"), F.concat(F.lit("skill-"), F.col("host") % 7).alias("name"), (F.col("output") * 2).alias("size"))
    return O.skill_table(O.attribute_skills(requests, loads), loads)


@query(f"WITH {T.REQUESTS_SQL}, t AS (SELECT DISTINCT session, day, 's' || host % 5 AS name FROM requests), n AS (SELECT name, count(*) AS n FROM t GROUP BY name), p AS (SELECT a.name, b.name AS other, count(*) AS shared FROM t a JOIN t b USING (session, day) WHERE a.name < b.name GROUP BY ALL) SELECT p.name, other, shared, round(shared / (a.n + b.n - shared)::DOUBLE, 9) AS jaccard FROM p JOIN n a ON a.name = p.name JOIN n b ON b.name = other WHERE shared >= 1")
def u5_skill_overlap(spark, sf_dir):
    rows = T.requests(spark, sf_dir).select("session", F.col("day").alias("turn"), F.concat(F.lit("s"), F.col("host") % 5).alias("name"))
    return O.overlapping_skills(rows, 1, 0.0).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {T.REQUESTS_SQL}, n AS (SELECT session, provider AS branch, count(*) AS n FROM requests GROUP BY ALL), c AS (SELECT session, sum(output) / 1000.0 AS cost FROM requests GROUP BY session) SELECT branch, round(sum(cost * n / t), 4) AS cost, sum(n)::BIGINT AS commits FROM (SELECT *, sum(n) OVER (PARTITION BY session) AS t FROM n) JOIN c USING (session) GROUP BY branch")
def a20_branch_costs(spark, sf_dir):
    r = T.requests(spark, sf_dir)
    costs = r.groupBy("session").agg((F.sum("output") / 1000.0).alias("cost"))
    return O.branch_costs(costs, r.select("session", F.col("provider").alias("branch"))).withColumn("cost", F.round("cost", 4))
