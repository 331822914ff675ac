"""Contrast of a selection with a baseline: shares, lift, chi-square, ranking; and comparison of two groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.scalars import histogram_quantile
from loomspan.operators.aggregate import distributions, minus, tool_totals, totals

SIGNIFICANT = 6.63  # p < 0.01 at one degree of freedom


def chi_square(a: Column, A: Column, b: Column, B: Column) -> Column:
    """Chi-square of a 2x2 table with Yates' correction: a of A against b of B; 0 where a margin is 0."""
    a, A, b, B = (x.cast("double") for x in (a, A, b, B))
    n, c, d = A + B, A - a, B - b
    margins = (a + b) * (c + d) * A * B
    x = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    return F.when(margins > 0, n * x * x / margins).otherwise(F.lit(0.0))


def scores(selected: DataFrame, base: DataFrame, n_selected: int | Column, n_base: int | Column) -> DataFrame:
    """Per dimension and value of the selection: shares, difference, lift (null: new), chi-square and significance."""
    A, B = (F.lit(x) if isinstance(x, int) else x for x in (n_selected, n_base))
    right = base.select(F.col("dim").alias("d"), F.col("value").alias("v"), F.col("n").alias("b"))
    rows = selected.select("dim", "value", F.col("n").alias("a")).join(right, (F.col("dim") == F.col("d")) & F.col("value").eqNullSafe(F.col("v")), "left")
    rows = rows.select("dim", "value", "a", F.coalesce("b", F.lit(0)).alias("b"))
    share_a = F.when(A > 0, F.col("a") / A).otherwise(0.0)
    share_b = F.when(B > 0, F.col("b") / B).otherwise(0.0)
    chi = chi_square(F.col("a"), A, F.col("b"), B)
    return rows.select(
        "dim", "value", "a", "b", share_a.alias("share"), share_b.alias("base_share"), (share_a - share_b).alias("diff"), F.when(F.col("b") > 0, share_a / share_b).alias("lift"), chi.alias("chi2"), (chi >= SIGNIFICANT).alias("significant")
    )


def weighted_scores(selected: DataFrame, base: DataFrame) -> DataFrame:
    """Shares of a weight (cost, tokens, time) instead of counts; support stays the count and no count test applies."""
    total = lambda df: df.groupBy("dim").agg(F.sum("weight").alias("total"))
    a = selected.join(total(selected), "dim").select("dim", "value", F.col("n").alias("a"), F.try_divide("weight", "total").alias("share"))
    b = base.join(total(base), "dim").select(F.col("dim").alias("d"), F.col("value").alias("v"), F.col("n").alias("b"), F.try_divide("weight", "total").alias("base_share"))
    rows = a.join(b, (F.col("dim") == F.col("d")) & F.col("value").eqNullSafe(F.col("v")), "left")
    base_share = F.coalesce("base_share", F.lit(0.0))
    return rows.select("dim", "value", "a", F.coalesce("b", F.lit(0)).alias("b"), "share", base_share.alias("base_share"), (F.col("share") - base_share).alias("diff"), F.try_divide("share", base_share).alias("lift"))


def ranked(rows: DataFrame, cap: int = 5, support: int = 1, under: bool = False) -> DataFrame:
    """Rows with enough support (files: 5 at least) and 1 % of the selection, best difference first, at most ``cap`` a dimension."""
    least = F.when(F.col("dim") == "file", F.greatest(F.lit(5), F.lit(support))).otherwise(F.lit(support))
    kept = rows.filter((F.col("a") >= least) & (F.col("share") >= 0.01))
    if under:
        kept = kept.filter("diff < 0")
    diff = F.col("diff").asc() if under else F.col("diff").desc()
    order = Window.partitionBy("dim").orderBy(diff, F.col("a").desc(), "value")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)


def slow_calls(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Timed calls at or above their tool's p90, and all timed calls (untimed ones are in neither group)."""
    limits = tool_totals(calls.filter("ms IS NOT NULL")).select("tool", "hist", "max_ms")
    limits = limits.select("tool", histogram_quantile(F.col("hist"), 0.9, F.col("max_ms")).alias("p90"))
    timed = calls.filter("ms IS NOT NULL")
    return timed.join(limits, "tool").filter("ms >= p90").drop("p90"), timed


def triage(scope: DataFrame, selection: DataFrame, dims: list[str], baseline: DataFrame | None = None, cap: int = 5, support: int = 1) -> DataFrame:
    """What sets the selected calls apart: ranked rows against ``baseline``, or against the rest of the scope.

    The rest is the scope's counts minus the selection's. Dimensions with one value in the scope say nothing and are left out.
    """
    sel, all_ = distributions(selection, dims), distributions(scope, dims)
    base = minus(all_, sel) if baseline is None else distributions(baseline, dims)
    several = all_.groupBy("dim").agg(F.count(F.lit(1)).alias("values")).filter("values > 1").select("dim")
    n_sel = selection.count()
    n_base = scope.count() - n_sel if baseline is None else baseline.count()
    return ranked(scores(sel.join(several, "dim", "left_semi"), base, n_sel, n_base), cap, support)


def guard(n_selected: int, n_base: int) -> str:
    """Why a triage says little: empty sides, or fewer than 20 selected calls."""
    return "empty selection" if n_selected == 0 else "empty baseline" if n_base == 0 else "small" if n_selected < 20 else ""


def compare_metrics(a: DataFrame, b: DataFrame, key: str = "metric") -> DataFrame:
    """Two long tables (metric, value) side by side: difference and ratio where both are known."""
    right = b.select(F.col(key).alias("_k"), F.col("value").alias("b"))
    rows = a.select(F.col(key), F.col("value").alias("a")).join(right, F.col(key) == F.col("_k"), "full_outer")
    return rows.select(F.coalesce(key, "_k").alias(key), "a", "b", (F.col("b") - F.col("a")).alias("delta"), F.try_divide("b", "a").alias("ratio"))


def call_metrics(calls: DataFrame) -> DataFrame:
    """The comparison's metrics of a group of calls, long."""
    t = totals(calls)
    names = ("calls", "errors", "sessions", "session_days", "models", "timed", "total_ms", "max_ms", "p50_ms", "p95_ms")
    wide = t.select(*(F.col(n).cast("double") for n in names), F.try_divide(F.col("errors"), F.col("calls")).alias("error_rate"), F.try_divide(F.col("calls"), F.col("sessions")).alias("calls_session"))
    return wide.unpivot([], list(wide.columns), "metric", "value")


def compare_tools(a: DataFrame, b: DataFrame, least: int = 50, by: str = "tool") -> DataFrame:
    """Tools of two groups: calls, errors, error rates and the chi-square of errors from ``least`` calls a side."""
    side = lambda df, s: df.groupBy(by).agg(F.count(F.lit(1)).alias(f"calls_{s}"), F.count_if("err").alias(f"errors_{s}"))
    rows = side(a, "a").join(side(b, "b"), by, "full_outer").na.fill(0)
    enough = (F.col("calls_a") >= least) & (F.col("calls_b") >= least)
    return rows.withColumn("chi2", F.when(enough, chi_square(F.col("errors_a"), F.col("calls_a"), F.col("errors_b"), F.col("calls_b"))))


def compare_skills(a: DataFrame, b: DataFrame, sessions_a: DataFrame, sessions_b: DataFrame, least: int = 20) -> DataFrame:
    """Skills of two groups (name, session, usd): loads, dollars, sessions, and the chi-square of the sessions that load them.

    The test needs ``least`` sessions in each group (``sessions_*``: all of a group's), and is unknown below.
    """
    side = lambda df, s: df.groupBy("name").agg(F.count(F.lit(1)).alias(f"loads_{s}"), F.sum("usd").alias(f"usd_{s}"), F.count_distinct("session").alias(f"sessions_{s}"))
    size = lambda df, s: df.agg(F.count_distinct("session").alias(f"_n_{s}"))
    rows = side(a, "a").join(side(b, "b"), "name", "full_outer").na.fill(0)
    rows = rows.join(size(sessions_a, "a").join(size(sessions_b, "b"), F.lit(True)), F.lit(True))  # one row each
    chi = chi_square(F.col("sessions_a"), F.col("_n_a"), F.col("sessions_b"), F.col("_n_b"))
    return rows.withColumn("chi2", F.when((F.col("_n_a") >= least) & (F.col("_n_b") >= least), chi)).drop("_n_a", "_n_b")


def compare_sets(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Values that only a, only b or both have."""
    x, y = a.select(value).distinct().withColumn("_a", F.lit(True)), b.select(value).distinct().withColumn("_b", F.lit(True))
    return x.join(y, value, "full_outer").select(value, F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").otherwise("both").alias("side"))


def compare_slots(a: DataFrame, b: DataFrame, slot_ms: int = 300_000) -> DataFrame:
    """Calls of both groups by slot since each group's first call; slots without calls are filled."""

    def side(df: DataFrame, name: str) -> DataFrame:
        first = df.agg(F.min("t_ms")).scalar()
        return df.groupBy(F.floor((F.col("t_ms") - first) / slot_ms).alias("slot")).agg(F.count(F.lit(1)).alias(name))

    x, y = side(a, "a"), side(b, "b")
    both = x.join(y, "slot", "full_outer")
    every = both.agg(F.max("slot").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("slot"))
    return every.join(both, "slot", "left").na.fill(0)
