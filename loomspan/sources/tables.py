"""Canonical activity frames made from the driver's tables.

``events`` become tool calls, ``lineitem`` with ``orders`` become token requests, ``conversations`` become turns. Times are
epoch milliseconds beside a local day and hour (session time zone UTC); unknown values are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tool call: ``session, seq, t, t_ms, day, hour, weekday, tool, ms, err, out, programs, commands, files``."""
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("t"),
        F.unix_millis(t).alias("t_ms"),
        F.to_date("ts").alias("day"),
        F.hour("ts").alias("hour"),
        (F.dayofweek("ts") - 1).alias("weekday"),
        F.col("event_type").alias("tool"),
        F.when(k % 11 != 0, F.round(F.col("value") * 100).cast("long")).alias("ms"),  # every eleventh is untimed
        F.when(F.col("event_type") != "signup", F.col("event_type") == "error").alias("err"),  # a signup has no result yet
        F.when(F.col("event_type") != "signup", k * 1000).alias("out"),
        F.array(F.concat(F.lit("p"), k % 5), F.concat(F.lit("p"), k % 3)).alias("programs"),
        F.array(F.concat(F.lit("p"), k % 5, F.lit(" run"))).alias("commands"),
        F.array(F.concat(F.lit("src/d"), k % 4, F.lit("/f"), k % 20, F.when(k % 2 == 0, ".py").otherwise(".md"))).alias("files"),
        F.concat(F.lit("m"), k % 4).alias("model"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: a session with its parent, repository, harness, cost and copy key; a cost of nothing booked is unknown."""
    booked = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), 4).alias("cost"),
        F.count(F.lit(1)).alias("tools"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.min("ts").alias("started"),
        F.max("ts").alias("updated"),
    )
    customers = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    named = customers.select(F.col("c_custkey").alias("session"), F.col("n_name").alias("repo"), F.lower("c_mktsegment").alias("harness"))
    s = F.col("session")
    return booked.join(named, "session", "left").withColumns({
        "parent": F.when(s % 10 != 0, s - s % 10),
        "copy_key": F.concat(F.lit("k"), F.floor(s / 3)),
        "cwd": F.concat(F.lit("/home/u/"), F.lower("repo"), F.lit("/w"), s % 3),
        "error_rate": F.try_divide("errors", "tools"),
    })


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: a token request of a session (customer) with tokens, model, provider, mode and the harness's own cost."""
    q, line = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    own = F.col("l_extendedprice") / 100000
    return read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("session"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("request"),
        F.col("l_suppkey").alias("host"),
        F.to_date("l_shipdate").alias("day"),
        (line * 3 % 24).alias("hour"),
        F.concat(F.lit("m"), F.col("l_partkey") % 7, F.when(F.col("l_partkey") % 2 == 0, "-20250101").otherwise("")).alias("model"),
        F.col("l_linestatus").alias("provider"),
        F.col("l_returnflag").alias("mode"),
        (q * 100).alias("input"),
        (q * 20).alias("output"),
        (q * line * 10).alias("cache_read"),
        (q * 3).alias("write_5m"),
        q.alias("write_1h"),
        F.when(F.col("l_tax") >= 0.06, own).otherwise(F.lit(0.0)).alias("usd_reported"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation turn: ``session, seq, role, text``."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")


#: The same frames as DuckDB common table expressions, for the oracles.
CALLS_SQL = """calls AS (
  SELECT user_id AS session, event_id AS seq, ts AS t, epoch_us(ts) // 1000 AS t_ms, ts::DATE AS day, hour(ts)::INT AS hour, dayofweek(ts)::INT AS weekday, event_type AS tool,
    CASE WHEN k % 11 <> 0 THEN round(value * 100)::BIGINT END AS ms, CASE WHEN event_type <> 'signup' THEN event_type = 'error' END AS err,
    CASE WHEN event_type <> 'signup' THEN k * 1000 END AS out, ['p' || k % 5, 'p' || k % 3] AS programs, ['p' || k % 5 || ' run'] AS commands,
    ['src/d' || k % 4 || '/f' || k % 20 || CASE WHEN k % 2 = 0 THEN '.py' ELSE '.md' END] AS files, 'm' || k % 4 AS model
  FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)
)"""

SESSIONS_SQL = """sessions AS (
  SELECT b.*, n_name AS repo, lower(c_mktsegment) AS harness, CASE WHEN session % 10 <> 0 THEN session - session % 10 END AS parent, 'k' || session // 3 AS copy_key,
    '/home/u/' || lower(n_name) || '/w' || session % 3 AS cwd, errors / tools::DOUBLE AS error_rate
  FROM (SELECT user_id AS session, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS cost, count(*) AS tools, count(*) FILTER (event_type = 'error') AS errors,
          min(ts) AS started, max(ts) AS updated FROM events GROUP BY user_id) b
  LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON c_custkey = session
)"""

REQUESTS_SQL = """requests AS (
  SELECT o_custkey AS session, l_orderkey || '-' || l_linenumber AS request, l_suppkey AS host, l_shipdate::DATE AS day, (l_linenumber::BIGINT * 3) % 24 AS hour,
    'm' || l_partkey % 7 || CASE WHEN l_partkey % 2 = 0 THEN '-20250101' ELSE '' END AS model, l_linestatus AS provider, l_returnflag AS mode,
    l_quantity::BIGINT * 100 AS input, l_quantity::BIGINT * 20 AS output, l_quantity::BIGINT * l_linenumber::BIGINT * 10 AS cache_read, l_quantity::BIGINT * 3 AS write_5m, l_quantity::BIGINT AS write_1h,
    CASE WHEN l_tax >= 0.06 THEN l_extendedprice / 100000 ELSE 0 END AS usd_reported
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
