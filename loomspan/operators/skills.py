"""Skill loads: sizes filled in, invariants, advice from versions, idle loads, overlaps and outcomes, and metrics for rules.

``loads`` have a row per load: session, name, trigger (user, model, compact), turn, t and turn_end and end (epoch ms; null: not
ended), size, hash, usd, tail_usd, carry_usd. Advice is scaled to 30 days from the days observed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _median(column: str) -> Column:
    """The lower median, which is a value of the rows; nulls do not count."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column})")


def sizes_filled(loads: DataFrame) -> DataFrame:
    """Loads with unknown sizes filled by the median of the same text (hash), else of the same name; ``guessed`` tells which."""
    known = loads.filter("size IS NOT NULL")
    by_hash = known.filter("hash IS NOT NULL").groupBy("hash").agg(_median("size").alias("_h"))
    by_name = known.groupBy("name").agg(_median("size").alias("_n"))
    met = loads.join(by_hash, "hash", "left").join(by_name, "name", "left")
    guess = F.coalesce("_h", "_n")
    return met.withColumn("guessed", F.col("size").isNull() & guess.isNotNull()).withColumn("size", F.coalesce("size", guess)).select(*loads.columns, "guessed")


def broken_invariants(loads: DataFrame, contexts: DataFrame) -> DataFrame:
    """What cannot be: (session, problem, n). ``loads`` also have load_tokens, carry_tokens, tail_tokens and why (of the end).

    No part is negative, a tail is part of what was loaded and carried, an end has a reason and only an end has one, and all skills
    of a session hold no more than its ``context_tokens`` (``contexts``). Nothing is returned where all holds.
    """
    held = F.col("load_tokens") + F.col("carry_tokens")
    slots = (F.least("load_tokens", "carry_tokens", "tail_tokens") < 0) | (F.col("tail_tokens") > held)
    problems = F.array_compact(F.array(F.when(slots, "tokens"), F.when(F.col("end").isNull() != F.col("why").isNull(), "state")))
    rows = loads.select("session", F.explode(problems).alias("problem")).groupBy("session", "problem").agg(F.count(F.lit(1)).alias("n"))
    sums = loads.groupBy("session").agg(F.sum(held).alias("held"), F.count(F.lit(1)).alias("n")).join(contexts, "session")
    return rows.unionByName(sums.filter("held > context_tokens + 0.5").select("session", F.lit("context").alias("problem"), "n"))


def _calls_within(spans: DataFrame, calls: DataFrame, key: list[str], sums: dict[str, Column], bucket_ms: int = 600_000) -> DataFrame:
    """Sums over the calls with ``t0 <= t_ms < t1`` per span, 0 without any: an equi join on session and time bucket.

    A call belongs to one bucket, so no pair meets twice; a session's spans and calls are spread over its buckets.
    """
    some = spans.filter("t1 > t0").withColumn("_b", F.explode(F.sequence(F.floor(F.col("t0") / bucket_ms), F.floor((F.col("t1") - 1) / bucket_ms))))
    rows = calls.withColumn("_b", F.floor(F.col("t_ms") / bucket_ms)).drop(*(c for c in key if c != "session"), "t0", "t1")
    met = some.select(*key, "t0", "t1", "_b").join(rows, ["session", "_b"]).filter((F.col("t_ms") >= F.col("t0")) & (F.col("t_ms") < F.col("t1")))
    made = met.groupBy(*key).agg(*(c.alias(n) for n, c in sums.items()))
    return spans.join(made, key, "left").na.fill(0, list(sums))


def told_apart(loads: DataFrame) -> DataFrame:
    """``loads`` with ``n`` (loads in a row, 1 where it is not told) and ``stub`` (a call again whose text is its own, false likewise)."""
    known = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in loads.columns else F.lit(other)
    return loads.withColumns({"n": known("n", 1), "stub": known("stub", False)})


def version_changes(loads: DataFrame, days: int, least: int = 3) -> DataFrame:
    """A5: consecutive versions (hashes, by first load) of a skill with ``least`` sessions each, and what a session costs before and after.

    Loads without a hash and stubs (a second call whose text is its own) are of no version. One row per version goes through the window.
    """
    versions = told_apart(loads).filter("hash IS NOT NULL AND NOT stub").groupBy("name", "hash").agg(
        F.min("t").alias("first_t"), F.count_distinct("session").alias("sessions"), F.sum("usd").alias("usd"), F.sum("tail_usd").alias("tail"), _median("size").alias("size")
    )
    versions = versions.select("name", "hash", "first_t", "sessions", "size", (F.col("usd") / F.col("sessions")).alias("usd_session"), F.try_divide("tail", "usd").alias("tail_share"))
    w = Window.partitionBy("name").orderBy("first_t", "hash")
    before = {f"{c}_before": F.lag(c).over(w) for c in ("hash", "sessions", "size", "usd_session", "tail_share")}
    pairs = versions.withColumns(before).filter((F.col("sessions") >= least) & (F.col("sessions_before") >= least))
    return pairs.withColumn("severity", F.abs(F.col("usd_session") - F.col("usd_session_before")) * F.col("sessions") * (30 / max(1, days)))


def idle_loads(loads: DataFrame, calls: DataFrame, days: int, share: float = 0.5, least: int = 5) -> DataFrame:
    """A7: skills that the model loads and then calls no tool in that turn: judged and idle loads, and the idle ones' dollars.

    Judged are single model loads (``n`` of 1, no stubs) whose turn has ended, in sessions with call rows. Loads of one skill and moment are judged alike.
    """
    kept = calls.select("session").distinct()
    own = told_apart(loads).filter("trigger = 'model' AND turn_end IS NOT NULL AND n = 1 AND NOT stub").join(kept, "session", "left_semi")
    spans = own.groupBy("session", "name", (F.col("t") + 1).alias("t0"), F.col("turn_end").alias("t1")).agg(F.count(F.lit(1)).alias("loads"), F.sum("usd").alias("usd"))
    seen = _calls_within(spans, calls.select("session", "t_ms"), ["session", "name", "t0", "t1"], {"calls": F.count(F.lit(1))})
    idle = F.col("calls") == 0
    rows = seen.groupBy("name").agg(F.sum("loads").alias("judged"), F.sum(F.when(idle, F.col("loads")).otherwise(0)).alias("idle"), F.coalesce(F.sum(F.when(idle, F.col("usd"))), F.lit(0.0)).alias("idle_usd"))
    return rows.filter((F.col("judged") >= least) & (F.col("idle") / F.col("judged") >= share)).withColumn("severity", F.col("idle_usd") * (30 / max(1, days)))


def overlaps(loads: DataFrame, days: int, share: float = 0.6, least: int = 5) -> DataFrame:
    """A8: two skills loaded in the same turns: shared turns, Jaccard of the loading turns; ``name`` is the cheaper, ``pair`` the other.

    Turns with the same set of skills are counted first, so pairs are made once a distinct set and not once a turn; a set is no
    larger than the number of skills with ``least`` turns.
    """
    rows = loads.filter("trigger IN ('user', 'model')").select("name", "session", "turn").distinct()
    spent = loads.groupBy("name").agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    per = rows.groupBy("name").agg(F.count(F.lit(1)).alias("turns")).filter(F.col("turns") >= least).join(spent, "name")
    often = rows.join(per.select("name"), "name", "left_semi")
    sets = often.groupBy("session", "turn").agg(F.array_sort(F.collect_set("name")).alias("names")).filter("size(names) > 1")
    sets = sets.groupBy("names").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select("n", "names", F.posexplode("names").alias("at", "a"))
    pairs = first.select("n", "a", F.explode(F.expr("slice(names, at + 2, size(names))")).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    side = lambda s: per.select(F.col("name").alias(s), F.col("turns").alias(f"turns_{s}"), F.col("usd").alias(f"usd_{s}"))
    met = pairs.filter(F.col("shared") >= least).join(side("a"), "a").join(side("b"), "b")
    met = met.withColumn("jaccard", F.col("shared") / (F.col("turns_a") + F.col("turns_b") - F.col("shared"))).filter(F.col("jaccard") >= share)
    small = F.col("usd_a") <= F.col("usd_b")
    return met.select(
        F.when(small, F.col("a")).otherwise(F.col("b")).alias("name"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("pair"),
        "shared", "jaccard", (F.least("usd_a", "usd_b") * F.col("jaccard") * (30 / max(1, days))).alias("severity"),
    )


def outcomes(loads: DataFrame, calls: DataFrame, sessions: DataFrame, least: int = 10) -> DataFrame:
    """A9: turns that loaded a skill against the other turns of the same projects: calls, errors, test runs passed, commits.

    ``calls`` also have is_test and is_commit, ``sessions`` are (session, repo, turns). Only ended turns and sessions with call
    rows count; a turn counts once a skill, from its first load on. A correlation, no cause.
    """
    sums = {
        "calls": F.count(F.lit(1)), "errors": F.count_if("err"), "tests": F.count_if("is_test"),
        "passed": F.count_if(F.col("is_test") & ~F.col("err")), "commits": F.count_if("is_commit"),
    }
    rows = calls.select("session", "t_ms", "err", "is_test", "is_commit")
    whole = rows.groupBy("session").agg(*(c.alias(n) for n, c in sums.items())).join(sessions.select("session", "repo", F.col("turns").alias("turns")), "session")
    turns = loads.filter("trigger IN ('user', 'model') AND turn_end IS NOT NULL").groupBy("name", "session", "turn").agg(F.min("t").alias("t0"), F.min_by("turn_end", "t").alias("t1"))
    turns = turns.join(whole.select("session"), "session", "left_semi")
    within = _calls_within(turns, rows, ["session", "name", "turn"], sums)
    own = within.groupBy("name", "session").agg(F.count(F.lit(1)).alias("turns"), *(F.sum(n).alias(n) for n in sums))
    placed = own.join(whole.select("session", "repo", F.col("turns").alias("of")), "session")
    fields = ("turns", *sums)
    skill = placed.groupBy("name").agg(*(F.sum(n).alias(n) for n in fields)).filter(F.col("turns") >= least)
    repos = placed.filter("repo IS NOT NULL").select("name", "repo").distinct()
    per_repo = whole.groupBy("repo").agg(*(F.sum(n).alias(f"all_{n}") for n in fields))
    around = repos.join(per_repo, "repo").groupBy("name").agg(*(F.sum(f"all_{n}").alias(f"all_{n}") for n in fields))
    inside = placed.filter("repo IS NOT NULL").groupBy("name").agg(F.sum(F.least("turns", "of")).alias("_in_turns"), *(F.sum(n).alias(f"_in_{n}") for n in sums))
    met = skill.join(around, "name").join(inside, "name")
    rest = {f"other_{n}": F.col(f"all_{n}") - F.col(f"_in_{n}") for n in fields}
    return met.select("name", *fields, *(c.alias(n) for n, c in rest.items())).filter(F.col("other_turns") >= least)


def skill_metrics(loads: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per session: most copies of one skill in context at once, most carry dollars of one skill, share of the context of open loads.

    ``contexts``: session, context_tokens of the newest request; the share is at most 1, and unknown without a context or a size.
    An end at the time of a load comes first.
    """
    steps = loads.select("session", "name", F.explode(F.array(F.struct(F.col("t").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("s")).select("session", "name", "s.*").filter("at IS NOT NULL")
    w = Window.partitionBy("session", "name").orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    copies = steps.withColumn("n", F.sum("d").over(w)).groupBy("session").agg(F.max("n").alias("skill_reloads"))
    carry = loads.groupBy("session", "name").agg(F.sum("carry_usd").alias("c")).groupBy("session").agg(F.max("c").alias("skill_carry_usd"))
    open_ = loads.filter("end IS NULL AND size > 0").groupBy("session").agg(F.sum("size").alias("size")).join(contexts.filter("context_tokens > 0"), "session")
    share = open_.select("session", F.least(F.lit(1.0), F.col("size") / F.col("context_tokens")).alias("skill_context_share"))
    return copies.join(carry, "session").join(share, "session", "left")
