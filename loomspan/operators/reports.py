"""Reports over calls, sessions and skills: waits, agent time, contention, advice, teams, billing, fuzzy search."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import scalars as S
from loomspan.operators.aggregate import with_quantiles
from loomspan.operators.intervals import active_minutes, union_length
from loomspan.operators.skills import told_apart
from loomspan.plans.filters import glob_pattern


def wait_report(calls: DataFrame, key: str, start: str, days: int) -> DataFrame:
    """Waiting per key over a window of days: calls, time, share, quantiles, errors, and the trend against the window before.

    The trend is unknown where the earlier window has no time.
    """
    a = F.lit(start).cast("date")
    now = (F.col("day") >= a) & (F.col("day") < F.date_add(a, days))
    before = (F.col("day") < a) & (F.col("day") >= F.date_sub(a, days))
    rows = calls.filter(now | before)
    made = rows.groupBy(key).agg(
        F.count_if(now).alias("calls"),
        F.count(F.when(now, F.col("ms"))).alias("timed_calls"),
        F.sum(F.when(now, F.col("ms"))).alias("total_ms"),
        F.max(F.when(now, F.col("ms"))).alias("max_ms"),
        F.count_if(now & F.col("err")).alias("errors"),
        F.count_distinct(F.when(now, F.col("session"))).alias("agents"),
        F.sum(F.when(before, F.col("ms"))).alias("prev_total_ms"),
        S.histogram_of(F.when(now, F.col("ms"))).alias("hist"),
    )
    made = with_quantiles(made, p50_ms=0.5, p95_ms=0.95)
    share = F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy())  # one row a key
    return made.withColumns({"share": share, "error_rate": F.try_divide("errors", "calls"), "trend": F.try_divide(F.col("total_ms") - F.col("prev_total_ms"), F.col("prev_total_ms"))})


def agent_time(calls: DataFrame) -> DataFrame:
    """Per session: active time, time in tools (union of its calls), and the model's, which is the rest, never below 0."""
    active = active_minutes(calls, ["session"]).groupBy("session").agg((F.sum(F.col("end_minute") - F.col("first_minute")) * 60000).alias("active_ms"))
    timed = calls.filter("ms IS NOT NULL").select("session", F.col("t_ms").alias("t0"), (F.col("t_ms") + F.col("ms")).alias("t1"))
    tools = union_length(timed, ["session"]).select("session", F.col("union_ms").alias("tool_ms"))
    made = active.join(tools, "session", "left").na.fill(0, ["tool_ms"])
    return made.withColumn("model_ms", F.greatest(F.lit(0), F.col("active_ms") - F.col("tool_ms")))


def contention(spans: DataFrame, key: str, now_ms: int, least_ms: int = 0, old_ms: int = 86_400_000) -> DataFrame:
    """What runs now, per key: running calls, their sessions, the oldest; day-old ones are ignored."""
    age = F.lit(now_ms) - F.col("t0")
    running = spans.filter((F.col("t0") <= now_ms) & (F.coalesce("t1", F.lit(now_ms + 1)) > now_ms) & (age >= least_ms) & (age < old_ms))
    return running.groupBy(key).agg(F.count(F.lit(1)).alias("running"), F.count_distinct("session").alias("sessions"), F.max(age).alias("oldest_ms"))


def calls_with_context(calls: DataFrame, loads: DataFrame, bucket_ms: int = 3_600_000) -> DataFrame:
    """Calls with the skills in context at their start (``t <= call < end``): an equi join on session and time bucket."""
    cut = loads.withColumn("_c", F.explode(F.sequence(F.floor(F.col("t") / bucket_ms), F.floor((F.col("end") - 1) / bucket_ms))))
    rows = calls.select("session", "seq", "t_ms", F.floor(F.col("t_ms") / bucket_ms).alias("_c"))
    met = rows.join(cut.select("session", "_c", "name", "t", "end"), ["session", "_c"]).filter((F.col("t") <= F.col("t_ms")) & (F.col("t_ms") < F.col("end")))
    return met.select("session", "seq", "name").distinct()


#: Name of the loads that are the listing of skills itself.
LISTING = "(listing)"


def advice(loads: DataFrame, listed: DataFrame, days: int, *, now_ms: int | None = None, drift_days: int = 7, min_size: int = 2000, tail_share: float = 0.6, min_sessions: int = 3, min_user_loads: int = 3, reload_sessions: int = 2, compact_loads: int = 3) -> DataFrame:
    """What to change about skills. ``loads``: session, name, trigger, t, end, size, usd, tail_usd, carry_usd, reloaded, n, stub, hash, host.

    A1 carried too long, A2 never loaded by the model, A3 loaded again while in context, A4 loaded again after compaction (what the
    loads cost, without what they cost while carried), A6 listed but never loaded (an even share of what the listing costs), A10 newest
    versions differ between hosts. Loads named :data:`LISTING` are the listing: they count for A6 only. A row of ``n`` loads of
    more than one is no evidence of a second load (A3), a ``stub`` is of no version (A10), and with ``now_ms`` versions older than
    ``drift_days`` are not compared.
    """
    loads = told_apart(loads)
    listing, loads = loads.filter(F.col("name") == LISTING), loads.filter(F.col("name") != LISTING)
    per = 30 / max(1, days)
    table = loads.groupBy("name").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)").alias("size"),
        F.sum("usd").alias("usd"),
        F.sum("tail_usd").alias("tail"),
        F.count_distinct("session").alias("sessions"),
        F.count_if(F.col("trigger") == "user").alias("by_user"),
        F.count_if(F.col("trigger") == "model").alias("by_model"),
        F.count_distinct(F.when(F.col("trigger") == "user", F.col("session"))).alias("user_sessions"),
        F.count_if("reloaded").alias("reloads"),
        F.sum(F.when(F.col("reloaded"), F.col("usd") - F.coalesce("carry_usd", F.lit(0.0)))).alias("reload_usd"),
    )
    w = Window.partitionBy("session", "name").orderBy("t", "usd").rowsBetween(Window.unboundedPreceding, -1)
    twice = loads.filter("n = 1").withColumn("_open", F.max(F.coalesce("end", F.lit(1 << 60))).over(w)).filter(F.col("_open") > F.col("t"))
    twice = twice.groupBy("name").agg(F.count_distinct("session").alias("n"), F.sum("usd").alias("usd")).filter(F.col("n") >= reload_sessions)
    versions = loads.filter("hash IS NOT NULL AND NOT stub")
    if now_ms is not None:
        versions = versions.filter(F.col("t") >= now_ms - drift_days * 86_400_000)
    newest = versions.groupBy("name", "host").agg(F.max_by("hash", "t").alias("hash")).groupBy("name").agg(F.count_distinct("hash").alias("n")).filter("n >= 2")
    row = lambda df, id_, severity: df.select(F.lit(id_).alias("advice"), "name", F.round(severity, 6).alias("severity"))
    long = table.filter((F.col("size") >= min_size) & (F.col("tail") / F.col("usd") >= tail_share) & (F.col("sessions") >= min_sessions))
    manual = table.filter((F.col("by_user") >= min_user_loads) & (F.col("by_model") == 0) & (F.col("user_sessions") >= min_sessions))
    lost = table.filter(F.col("reloads") >= compact_loads)
    names = listed.select("name").distinct()
    share = F.coalesce(listing.agg(F.sum("usd")).scalar() / names.agg(F.count(F.lit(1))).scalar(), F.lit(0.0))
    unused = names.join(loads, "name", "left_anti")
    found = [row(long, "A1", F.col("tail") * per), row(manual, "A2", F.col("usd") * per * 0.1), row(twice, "A3", F.col("usd") * per), row(lost, "A4", F.col("reload_usd") * per), row(unused, "A6", share * per), row(newest, "A10", F.lit(0.0))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def billing_mode(evidence: DataFrame, priority: tuple[str, ...] = ("gateway", "metered", "api", "plan", "unknown")) -> DataFrame:
    """Mode of each session: the first conclusive evidence stays. ``evidence``: session, source (session before process), t_ms, mode."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("mode"))
    conclusive = evidence.filter("mode <> 'unknown'")
    first = conclusive.groupBy("session").agg(F.min_by("mode", F.struct((F.col("source") != "session").alias("later"), "t_ms", place.alias("p"))).alias("mode"))
    return evidence.select("session").distinct().join(first, "session", "left").select("session", F.coalesce("mode", F.lit("unknown")).alias("mode"))


def cost_per_commit(costs: DataFrame, commits: DataFrame) -> DataFrame:
    """Cost of a counted commit per key; unknown without commits or where the cost is."""
    n = commits.filter("counted").groupBy("session").agg(F.count_distinct("sha").alias("commits"))
    return costs.join(n, "session", "left").select("session", "cost", F.coalesce("commits", F.lit(0)).alias("commits"), F.try_divide("cost", "commits").alias("cost_per_commit"))


def native_usage(usage: DataFrame, requests: DataFrame, exported: DataFrame) -> DataFrame:
    """Usage records whose request no span in ``requests`` has and whose session is not ``exported``: two anti joins."""
    return usage.join(requests.select("request").distinct(), "request", "left_anti").join(exported.select("session").distinct(), "session", "left_anti")


def link_processes(processes: DataFrame, sessions: DataFrame, within_ms: int = 60_000) -> DataFrame:
    """Session of each process: by pid, else the nearest start in the same folder within a time, the smaller name of equally near ones.

    Starts meet by folder and time bucket, so a folder of many sessions gives no pairs but those near in time.
    """
    cell = lambda t: F.floor(F.col(t) / within_ms)
    by_pid = processes.join(sessions.select("pid", F.col("session").alias("s1")), "pid", "left")
    starts = sessions.select("cwd", F.col("session").alias("s2"), F.col("start_ms").alias("s_ms"), F.explode(F.array(cell("start_ms") - 1, cell("start_ms"), cell("start_ms") + 1)).alias("_cell"))
    near = by_pid.withColumn("_cell", cell("start_ms")).join(starts, ["cwd", "_cell"], "left").withColumn("gap", F.abs(F.col("start_ms") - F.col("s_ms")))
    best = near.groupBy("pid", "s1").agg(F.min(F.when(F.col("gap") <= within_ms, F.struct("gap", "s2"))).alias("n"))
    return best.select("pid", F.coalesce("s1", "n.s2").alias("session"))


def team_groups(rows: DataFrame, by: str, value: str = "cost") -> DataFrame:
    """Groups with their sum and their two greatest contributors (``member``)."""
    per = rows.groupBy(by, "member").agg(F.sum(value).alias("v"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("v").desc(), "member")))
    return ranked.groupBy(by).agg(
        F.sum("v").alias(value), F.count(F.lit(1)).alias("members"), F.max(F.when(F.col("r") == 1, F.col("member"))).alias("top"), F.max(F.when(F.col("r") == 2, F.col("member"))).alias("second")
    )


def room_rows(sessions: DataFrame, patterns: list[str], columns: list[str]) -> DataFrame:
    """What leaves for a room: shared, running after the share began, in an allowed repository, and only the level's columns."""
    allowed = F.lit(False)
    for p in patterns:
        allowed = allowed | F.lower("repo").rlike(glob_pattern(p.lower()) if "/" in p else "^" + glob_pattern(p.lower() + "/")[1:-2] + "$")
    return sessions.filter(F.col("shared") & ~F.col("paused") & (F.col("started") >= F.col("shared_since")) & allowed).select(*columns)


def visibility(rows: DataFrame, modes: DataFrame) -> DataFrame:
    """Skill rows by mode: shown as they are, ``name`` without amounts, ``omit`` folded into one hidden row."""
    met = rows.join(modes, "name", "left").withColumn("mode", F.coalesce("mode", F.lit("shown")))
    name = F.when(F.col("mode") == "omit", "(hidden)").otherwise(F.col("name"))
    return met.groupBy(name.alias("name")).agg(F.sum(F.when(F.col("mode") != "name", F.col("usd"))).alias("usd"), F.count(F.lit(1)).alias("rows"))


def fuzzy(rows: DataFrame, text: str, term: str, limit: int = 20) -> DataFrame:
    """Rows whose text holds the term's letters in order, best first: runs and word starts score, scattered letters cost."""
    need = ".*".join(f"\\Q{c}\\E" for c in term.lower())

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        def one(t: str) -> float:
            low, best = t.lower(), float("-inf")
            start = low.find(term[0].lower())
            while start >= 0:
                at, total, last, ok = start, 0.0, start - 1, True
                for c in term.lower():
                    at = low.find(c, last + 1)
                    if at < 0:
                        ok = False
                        break
                    total += 8.0 if at == 0 or not low[at - 1].isalnum() else 4.0 if at == last + 1 else 0.0
                    last = at
                if not ok:
                    break
                best = max(best, total - min(80, last - start + 1 - len(term)))
                start = low.find(term[0].lower(), start + 1)
            return best - 0.1 * min(40, len(t))

        return texts.map(one)

    return rows.filter(F.lower(text).rlike(need)).withColumn("score", score(F.col(text))).orderBy(F.col("score").desc(), text).limit(limit)


def quiet_gaps(rows: DataFrame, shown: Column, by: list[str], order: str) -> DataFrame:
    """Runs of hidden rows between shown ones: first, last and number."""
    marked = rows.withColumn("_s", F.coalesce(shown, F.lit(False)))
    group = F.sum(F.col("_s").cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_g", group).filter("NOT _s").groupBy(*by, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("hidden")).drop("_g")
