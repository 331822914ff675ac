"""Distributions and totals over filtered calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import scalars as S

#: Dimension name -> (column, whether it has several values). Others may be registered.
DIMENSIONS: dict[str, tuple[Callable[[], Column], bool]] = {
    "tool": (lambda: F.col("tool"), False),
    "server": (lambda: S.mcp_server(F.col("tool")), False),
    "model": (lambda: F.coalesce("model", F.lit("unknown")), False),
    "status": (lambda: F.when(F.col("err").isNull(), "unknown").when(F.col("err"), "error").otherwise("ok"), False),
    "duration": (lambda: S.duration_label(F.col("ms")), False),
    "out": (lambda: S.output_label(F.col("out")), False),
    "hour": (lambda: F.hour("t").cast("string"), False),
    "day": (lambda: F.col("day").cast("string"), False),
    "weekday": (lambda: S.weekday_name(F.dayofweek("day") - 1), False),
    "program": (lambda: F.col("programs"), True),
    "command": (lambda: F.col("commands"), True),
    "file": (lambda: F.col("files"), True),
    "ext": (lambda: F.transform("files", S.extension), True),
}


def _named(dim: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(dim).alias("dim"), v.cast("string").alias("value"))


def dimension_pairs(rows: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    """One row per row, dimension and distinct value: all dimensions in a single pass over ``rows``."""
    pairs = []
    for dim in dims:
        build, many = DIMENSIONS[dim]
        values = F.array_distinct(build()) if many else F.array(build())
        pairs.append(F.transform(values, _named(dim)))
    return rows.select(*keep, F.explode(F.flatten(F.array(*pairs))).alias("_p")).select(*keep, "_p.*")


def distributions(calls: DataFrame, dims: list[str], weight: Column | None = None) -> DataFrame:
    """Per dimension and value: calls, weight, errors, duration histogram and maximum. Each call counts once per distinct value."""
    rows = calls.withColumns({"_w": (weight if weight is not None else F.lit(1)).cast("double"), "_b": S.bucket(F.col("ms"))})  # the bucket once a call
    return dimension_pairs(rows, dims, ["_w", "_b", "err", "ms"]).groupBy("dim", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("_w").alias("weight"),
        F.count_if("err").alias("errors"),
        S.histogram(F.col("_b")).alias("hist"),
        F.max("ms").alias("max_ms"),
    )


def with_quantiles(dist: DataFrame, **quantiles: float) -> DataFrame:
    """Histogram quantiles as columns, e.g. ``p50=0.5``."""
    return dist.withColumns({name: S.histogram_quantile(F.col("hist"), q, F.col("max_ms")) for name, q in quantiles.items()})


def session_distributions(calls: DataFrame, sessions: DataFrame, dims: list[str]) -> DataFrame:
    """Per dimension and value: sessions (copies count once), and the booked cost of all their copies."""
    pairs = dimension_pairs(calls, dims, ["session"]).distinct()
    return pairs.join(sessions.select("session", "copy_key", "cost"), "session").groupBy("dim", "value").agg(
        F.count_distinct("copy_key").alias("sessions"), F.sum("cost").alias("cost")
    )


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` without ``b`` per dimension and value: counts clamped at 0, values that reach 0 dropped."""
    right = b.select(F.col("dim").alias("d"), F.col("value").alias("v"), *(F.col(c).alias(f"b_{c}") for c in ("n", "weight", "errors", "hist")))
    less = lambda c: F.greatest(F.col(c) - F.coalesce(f"b_{c}", F.lit(0)), F.lit(0))
    hist = F.zip_with("hist", F.coalesce("b_hist", F.array_repeat(F.lit(0).cast("long"), 16)), lambda x, y: F.greatest(x - y, F.lit(0).cast("long")))
    joined = a.join(right, (a.dim == right.d) & a.value.eqNullSafe(right.v), "left")
    return joined.select("dim", "value", less("n").alias("n"), less("weight").alias("weight"), less("errors").alias("errors"), hist.alias("hist"), "max_ms").filter("n > 0")


def tool_totals(calls: DataFrame, *by: str) -> DataFrame:
    """Per tool (or ``by``): calls, errors, timed calls, time, maximum, output, p50 and p95."""
    made = calls.groupBy(*(by or ("tool",))).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("err").alias("errors"),
        F.count("ms").alias("timed"),
        F.sum("ms").alias("total_ms"),
        F.max("ms").alias("max_ms"),
        F.sum("out").alias("out_bytes"),
        S.histogram_of(F.col("ms")).alias("hist"),
    )
    return with_quantiles(made, p50_ms=0.5, p95_ms=0.95).withColumn("error_rate", F.try_divide("errors", "calls"))


def totals(calls: DataFrame) -> DataFrame:
    """One row: calls, errors, sessions, active days, timed calls, time, maximum and quantiles over all."""
    made = calls.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("err").alias("errors"),
        F.count_distinct("session").alias("sessions"),
        F.count_distinct("session", "day").alias("session_days"),
        F.count_distinct("model").alias("models"),
        F.count("ms").alias("timed"),
        F.sum("ms").alias("total_ms"),
        F.max("ms").alias("max_ms"),
        S.histogram_of(F.col("ms")).alias("hist"),
    )
    return with_quantiles(made, p50_ms=0.5, p95_ms=0.95)


def day_usage(calls: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Pre-aggregate per session and day, mergeable into any coarser count."""
    return calls.groupBy("session", "day").agg(
        F.count(F.lit(1)).alias("day_tools"), F.count_if("err").alias("day_errors"), S.histogram_of(F.col("ms")).alias("hist"), F.max("ms").alias("max_ms"), F.sum("ms").alias("total_ms")
    )


def merge_days(days: DataFrame, *by: str) -> DataFrame:
    """Final aggregation of day rows: sums, histogram sums, maxima and the quantiles of the merged histogram."""
    made = days.groupBy(*by).agg(
        F.sum("day_tools").alias("calls"),
        F.sum("day_errors").alias("errors"),
        F.sum("total_ms").alias("total_ms"),
        F.array(*(F.sum(F.col("hist")[i]) for i in range(16))).alias("hist"),
        F.max("max_ms").alias("max_ms"),
    )
    return with_quantiles(made, p50_ms=0.5, p95_ms=0.95)


def money_once(matching: DataFrame, days: DataFrame, *money: str) -> DataFrame:
    """Sums over the session-days with a matching call, each counted once."""
    return days.join(matching.select("session", "day"), ["session", "day"], "left_semi").agg(*(F.sum(m).alias(m) for m in money), F.count(F.lit(1)).alias("session_days"))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps at most ``k`` rows a group and task before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def top_files(files: DataFrame, n: int) -> DataFrame:
    """The ``n`` most edited files (file, n), by name where equal, and after them what lies outside (an empty or null name), as one row."""
    outside = F.coalesce("file", F.lit("")) == ""
    found = files.filter(~outside).select("file", "n").orderBy(F.col("n").desc(), "file").limit(n)
    rest = files.filter(outside).agg(F.sum("n").alias("n")).filter("n > 0").select(F.lit("").alias("file"), "n")
    return found.unionByName(rest)


def page(rows: DataFrame, key: str, after=None, limit: int = 200) -> DataFrame:
    """Keyset paging in descending order of ``key`` and then ``session``: rows after the cursor (key, session)."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    if after is not None:
        k, s = (F.lit(x) for x in after)
        rows = rows.filter((F.col(key) < k) | ((F.col(key) == k) & (F.col("session") > s)))
    return rows.orderBy(F.col(key).desc(), "session").limit(limit)


def rollup_cost(requests: DataFrame, by: str, cost: str = "cost") -> DataFrame:
    """Cost rows by a key with a total row (null key); the cost is unknown where every token is unpriced."""
    tokens = F.col("input") + F.col("output") + F.col("cache_read") + F.col("write_5m") + F.col("write_1h")
    made = requests.rollup(by).agg(
        F.grouping(by).alias("is_total"),
        *(F.sum(c).alias(c) for c in ("input", "output", "cache_read")),
        F.sum(F.col("write_5m") + F.col("write_1h")).alias("cache_write"),
        F.sum(cost).alias("_cost"),
        F.sum(F.when(F.col(cost).isNull(), tokens).otherwise(0)).alias("unpriced_tokens"),
        F.count_distinct("session").alias("sessions"),
    )
    return made.withColumn("cost", F.col("_cost")).drop("_cost")
