"""Alert rules over metrics: one-shot levels as columns, and the level machine with hold times in event order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.intervals import in_order

UNITS = {
    "turn_done": "duration", "approval_wait": "duration", "repeat_run": "count", "command_age": "duration", "stalled": "duration", "spinning": "duration", "session_cost": "usd", "session_tokens": "count",
    "tool_calls": "count", "tool_errors": "count", "tool_error_rate": "ratio", "contention": "count", "contention_family": "count", "skill_reloads": "count", "skill_carry_usd": "usd", "skill_context_share": "ratio",
}


@dataclass(frozen=True)
class Rule:
    id: str
    metric: str
    op: str = ">="
    degraded: float | None = None
    critical: float | None = None
    hold_s: int = 0
    window: int = 0
    min_calls: int = 1
    message: str = ""
    enabled: bool = True
    labels: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.metric not in UNITS:
            raise ValueError(f"rule {self.id}: no metric {self.metric!r}")
        if self.op not in (">", ">=", "<", "<="):
            raise ValueError(f"rule {self.id}: {self.op!r} is no comparison")
        if self.degraded is None and self.critical is None:
            raise ValueError(f"rule {self.id} has no threshold")


# The built-in rules.
BUILT_IN = (
    Rule("waiting", "turn_done", ">=", degraded=0, message="turn finished"),
    Rule("approval", "approval_wait", ">", degraded=20, message="{tool} pending {value}"),
    Rule("loop", "repeat_run", ">=", critical=3, message="{tool} called {value}× in a row with the same arguments"),
    Rule("long-cmd", "command_age", ">", critical=600, message="{cmd} running {value}"),
    Rule("stalled", "stalled", ">", critical=480, message="no log activity {value}"),
    Rule("spinning", "spinning", ">", critical=180, message="busy while the log is silent {value}"),
    Rule("contention", "contention", ">=", degraded=3, hold_s=30, message="{value} heavy commands running", enabled=False),
    Rule("skill-reload", "skill_reloads", ">=", degraded=2, message="{skill} loaded {value}× in one context", enabled=False),
)


def merge_rules(own: list[Rule], base: tuple[Rule, ...] = BUILT_IN) -> list[Rule]:
    """Own rules over the built-in ones: the same id replaces, others follow."""
    by_id = {r.id: r for r in (*base, *own)}
    return list(by_id.values())


def _holds(op: str, value: Column, threshold: float | None) -> Column:
    if threshold is None:
        return F.lit(False)
    found = {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold}[op]
    return F.coalesce(found, F.lit(False))


def level(rule: Rule, value: Column, held_s: Column | None = None) -> Column:
    """0, 1 (degraded) or 2 (critical) of a value that has held for ``held_s``; an absent value is 0."""
    long_enough = F.lit(True) if held_s is None or rule.hold_s <= 0 else held_s >= rule.hold_s
    return F.when(_holds(rule.op, value, rule.critical) & long_enough, 2).when(_holds(rule.op, value, rule.degraded) & long_enough, 1).otherwise(0)


def call_metrics(calls: DataFrame, window: int = 0, min_calls: int = 1) -> DataFrame:
    """Per session: calls, errors and error rate, over all calls or the last ``window`` with a result; the rate needs ``min_calls``."""
    rows = calls
    if window:
        last = Window.partitionBy("session").orderBy(F.col("t_ms").desc(), F.col("seq").desc())
        rows = calls.filter("err IS NOT NULL").withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= window)
    made = rows.groupBy("session").agg(F.count(F.lit(1)).alias("tool_calls"), F.count_if("err").alias("tool_errors"), F.count("err").alias("done"), F.max("t_ms").alias("at_ms"))
    return made.withColumn("tool_error_rate", F.when(F.col("done") >= max(1, min_calls), F.col("tool_errors") / F.col("done")))


def snapshot(metrics: DataFrame, rules: list[Rule], at_ms: str = "at_ms", now_ms: int | None = None) -> DataFrame:
    """Firing alerts without history: ``for`` is judged from the time of the newest record behind the value."""
    held = (F.lit(now_ms) - F.col(at_ms)) / 1000 if now_ms is not None else None
    alerts = [
        F.struct(F.lit(r.id).alias("rule"), level(r, F.col(r.metric), held).alias("level"), F.col(r.metric).cast("double").alias("value"))
        for r in rules
        if r.enabled and r.metric in metrics.columns
    ]
    return metrics.select("session", F.explode(F.array(*alerts)).alias("_a")).select("session", "_a.*").filter("level > 0")


class Machine:
    """Level state of one session and rule: fire, escalate, deescalate, resolve, with hold times."""

    def __init__(self, rule: Rule, level: int = 0, since: tuple[float, float] = (0, 0)):
        self.rule, self.level, self.since = rule, level, list(since)

    def step(self, value: float | None, now_ms: float) -> str | None:
        r, to = self.rule, 0
        for k, threshold in enumerate((r.degraded, r.critical)):
            holds = value is not None and threshold is not None and {">": value > threshold, ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold}[r.op]
            if not holds:
                self.since[k] = 0
                continue
            self.since[k] = self.since[k] or now_ms
            if now_ms - self.since[k] >= r.hold_s * 1000:
                to = k + 1
        was, self.level = self.level, to
        if to == was:
            return None
        return "fire" if was == 0 else "resolve" if to == 0 else "escalate" if to > was else "deescalate"


def transitions(samples: DataFrame, rule: Rule) -> DataFrame:
    """Level changes of a rule over samples (session, t_ms, value; null is absent), each session in time order, then by value.

    The level is a function of the sample and of how long each threshold has held: the time of the first sample since the last
    one that did not hold. Windows of one sort tell both; no session is gathered.
    """
    w = Window.partitionBy("session").orderBy("t_ms", "value")
    marked, long_enough = samples, {}
    for name, threshold in (("critical", rule.critical), ("degraded", rule.degraded)):
        holds = _holds(rule.op, F.col("value"), threshold)
        long_enough[name] = holds
        if rule.hold_s > 0:
            begins = holds & ~F.coalesce(F.lag(holds).over(w), F.lit(False))
            marked = marked.withColumn(f"_{name}", F.when(begins, F.col("t_ms")))
            since = F.last(f"_{name}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
            long_enough[name] = holds & (F.col("t_ms") - since >= rule.hold_s * 1000)
    to = F.when(long_enough["critical"], 2).when(long_enough["degraded"], 1).otherwise(0)
    marked = marked.withColumn("to_level", to).withColumn("from_level", F.coalesce(F.lag("to_level").over(w), F.lit(0)))
    state = F.when(F.col("from_level") == 0, "fire").when(F.col("to_level") == 0, "resolve").when(F.col("to_level") > F.col("from_level"), "escalate").otherwise("deescalate")
    return marked.filter("to_level <> from_level").select("session", F.lit(rule.id).alias("rule"), "t_ms", F.col("from_level").cast("int").alias("from_level"), F.col("to_level").cast("int").alias("to_level"), state.alias("state"), F.col("value").cast("double").alias("value"))


def throttled(alerts: DataFrame, seconds: int = 30) -> DataFrame:
    """Notifications: fires and escalations, per session and rule at most one every ``seconds`` since the last one sent.

    The alerts of a session and rule go by in order; a task holds the time of the last one sent, no list of them. Rows of one time share
    their fate. Alerts without a time are not sent.
    """
    wanted = alerts.filter(F.col("state").isin("fire", "escalate") & F.col("t_ms").isNotNull())

    def start():
        sent: int | None = None

        def step(r: dict) -> list[tuple]:
            nonlocal sent
            if sent is None or r["t_ms"] - sent >= seconds * 1000:
                sent = r["t_ms"]
            return [tuple(r.values())] if r["t_ms"] == sent else []

        return step

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return in_order(wanted, ["session", "rule"], ["t_ms"], start, schema)
