"""Who books what: message owners, copies, cross-host merging, commits and skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.intervals import in_order


def owned(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose owner is the first copy in ``order``, one per ``key``: a grouped minimum of a struct, pre-aggregated in each task."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_o")
    return rows.groupBy(*key).agg(best).select(*key, *(F.col(f"_o.{c}").alias(c) for c in (*order, *rest))).select(rows.columns)


#: Order of the copies of one message: time twice, plus one if copied; then root, not forked, not background, at home, path.
MESSAGE_ORDER = ["order_key", "is_sub", "is_fork", "is_background", "not_home", "path"]


def message_order(t_ms: Column, copied: Column) -> Column:
    return t_ms * 2 + copied.cast("long")


def lost_shares(rows: DataFrame, winners: DataFrame, key: list[str], bucket: list[str], amounts: list[str]) -> DataFrame:
    """Per bucket: what its rows held, what of it other copies own, and the lost part (0 to 1) by which derived rows shrink."""
    own = winners.select(*key, *bucket).withColumn("_won", F.lit(True))
    met = rows.join(own, [*key, *bucket], "left")
    held = met.groupBy(*bucket).agg(*(F.sum(a).alias(f"{a}_held") for a in amounts), *(F.sum(F.when(F.col("_won").isNull(), F.col(a)).otherwise(0)).alias(f"{a}_lost") for a in amounts))
    first = amounts[0]
    return held.withColumn("lost_share", F.least(F.lit(1.0), F.try_divide(f"{first}_lost", f"{first}_held")))


def latest(rows: DataFrame, key: list[str], generation: str) -> DataFrame:
    """The newest row of each key: snapshots and their deltas as one current state."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), generation).alias("_s")).select(*key, *(F.col(f"_s.{c}").alias(c) for c in rest)).select(rows.columns)


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Patch from one state to another: keys with ``upsert`` or ``remove``, told by a hash of each row."""
    sign = lambda df, n: df.select(*key, F.xxhash64(*(c for c in df.columns if c not in key)).alias(n))
    both = sign(old, "_o").join(sign(new, "_n"), key, "full_outer")
    return both.filter(~F.col("_o").eqNullSafe(F.col("_n"))).select(*key, F.when(F.col("_n").isNull(), "remove").otherwise("upsert").alias("change"))


def shifted(rows: DataFrame, hours: int) -> DataFrame:
    """(day, hour) moved by whole hours to another time zone."""
    at = F.timestamp_seconds(F.unix_date("day") * 86400 + (F.col("hour") + hours) * 3600)
    return rows.withColumns({"day": F.to_date(at), "hour": F.hour(at).cast("long")})


def attribute_commits(commits: DataFrame, sessions: DataFrame, git_calls: DataFrame, banners: DataFrame) -> DataFrame:
    """Which session made a commit: one that printed its id, else the only one whose git call spans it, else the sessions at work.

    ``commits``: repo, sha, at_ms; ``sessions``: session, repo, w0, w1; ``git_calls``: session, repo, t0, t1; ``banners``: session,
    short. Only observed commits (banner or single span) are counted; windows give ``reflog`` (one) or ``shared`` (several).
    Commits meet calls and sessions by repository and time bucket (an hour, a day), so a repository's history is dealt over its buckets.
    """

    def within(spans: DataFrame, t0: str, t1: str, rank: int, bucket_ms: int) -> DataFrame:
        cell = lambda t: F.floor(F.col(t) / bucket_ms)
        cut = spans.filter(F.col(t1) >= F.col(t0)).select("repo", "session", t0, t1, F.explode(F.sequence(cell(t0), cell(t1))).alias("_cell"))
        met = commits.withColumn("_cell", cell("at_ms")).join(cut, ["repo", "_cell"]).filter(F.col("at_ms").between(F.col(t0), F.col(t1)))
        return met.select("repo", "sha", "at_ms", "session", F.lit(rank).alias("rank"))

    sized = banners.select(F.col("session").alias("b_session"), "short")
    by_sha = commits.withColumn("short", F.explode(F.transform(F.sequence(F.lit(7), F.least(F.lit(40), F.length("sha"))), lambda n: F.substring(F.col("sha"), F.lit(1), n))))
    banner = by_sha.join(sized, "short").select("repo", "sha", "at_ms", F.col("b_session").alias("session"), F.lit(1).alias("rank"))
    spans, windows = within(git_calls, "t0", "t1", 2, 3_600_000), within(sessions, "w0", "w1", 3, 86_400_000)
    found = banner.unionByName(spans).unionByName(windows).distinct()
    w = Window.partitionBy("repo", "sha")
    best = found.withColumn("_best", F.min("rank").over(w)).filter(F.col("rank") == F.col("_best"))
    n = F.count(F.lit(1)).over(w)
    how = F.when(F.col("rank") == 1, "observed").when((F.col("rank") == 2) & (n == 1), "observed").when(n == 1, "reflog").otherwise("shared")
    return best.withColumn("how", how).withColumn("counted", F.col("how") == "observed").select("repo", "sha", "at_ms", "session", "how", "counted")


def reflog_branches(events: DataFrame) -> DataFrame:
    """Branch at each reflog event: the last checkout's target (``target`` null on other events)."""
    w = Window.partitionBy("gitdir").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("branch", F.last("target", ignorenulls=True).over(w))


def amended(events: DataFrame) -> DataFrame:
    """Events with whether a later amend replaced them: chains count once."""
    later = events.filter("op = 'amend'").select("gitdir", F.col("old").alias("sha")).distinct().withColumn("amended", F.lit(True))
    return events.join(later, ["gitdir", "sha"], "left").withColumn("amended", F.coalesce("amended", F.lit(False)))


def branch_costs(costs: DataFrame, commits: DataFrame) -> DataFrame:
    """A session's cost split over its branches by their share of its commits."""
    n = commits.groupBy("session", "branch").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("session"))
    return n.withColumn("share", share).join(costs, "session").groupBy("branch").agg(F.sum(F.col("cost") * F.col("share")).alias("cost"), F.sum("n").alias("commits"))


def _take(left: list[float], want: float, order: tuple[int, ...]) -> list[float]:
    got = [0.0] * 4
    for i in order:
        part = min(left[i], want)
        left[i], got[i], want = left[i] - part, part, want - part
    return got


def attribute_skills(requests: DataFrame, loads: DataFrame) -> DataFrame:
    """Tokens of each request that loaded skill texts explain, one session at a time.

    ``requests``: session, seq, input, cache_read, write_5m, write_1h, context; ``loads``: session, name, seq (the request that first
    carries it), size. Earlier loads are carried first, oldest first, from cache reads, then new ones are loaded from cache writes,
    bounded by the context's growth (proportionally, largest remainder). A context under half of the last one and below the open
    loads' sum drops them all. Rows: session, seq, name, slot (load or carry), tokens. Requests and loads of a session are read
    in order as one stream; a task holds the open loads of one session and those of one request, not the session.
    """

    def start():
        open_loads: list[dict] = []
        waiting: list[dict] = []
        last = 0.0

        def step(r: dict) -> list[tuple]:
            nonlocal last
            if waiting and waiting[0]["seq"] != r["seq"]:
                waiting.clear()
            if r["_is_request"] == 0:
                waiting.append({"name": r["name"], "seq": r["seq"], "size": float(r["size"])})
                return []
            rows = []
            left = [float(r[c]) for c in ("input", "cache_read", "write_5m", "write_1h")]
            context = float(r["context"])
            if last > 0 and context < 0.5 * last and context < sum(x["size"] for x in open_loads):
                open_loads.clear()
            for x in open_loads:
                rows.append((r["session"], r["seq"], x["name"], "carry", sum(_take(left, x["size"], (1, 2, 3, 0)))))
            new = [dict(x) for x in waiting]
            growth, wanted = context - last, sum(x["size"] for x in new)
            if 0 < growth < wanted:
                exact = [x["size"] * growth / wanted for x in new]
                floors = [float(int(e)) for e in exact]
                spare = int(growth - sum(floors))
                for k in sorted(range(len(new)), key=lambda k: (floors[k] - exact[k], k))[:spare]:
                    floors[k] += 1
                for x, f in zip(new, floors):
                    x["size"] = f
            for x in new:
                rows.append((r["session"], r["seq"], x["name"], "load", sum(_take(left, x["size"], (2, 3, 0, 1)))))
            open_loads.extend(new)
            last = context
            return rows

        return step

    asked = requests.select("session", "seq", "input", "cache_read", "write_5m", "write_1h", "context").withColumn("_is_request", F.lit(1))
    given = loads.select("session", "seq", "name", F.col("size").cast("double").alias("size")).withColumn("_is_request", F.lit(0))
    both = asked.unionByName(given, allowMissingColumns=True)
    return in_order(both, ["session"], ["seq", "_is_request", "name", "size"], start, "session long, seq long, name string, slot string, tokens double")


def skill_table(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """Per skill: loads, sessions, lower-median size, and tokens loaded and carried."""
    sizes = loads.groupBy("name").agg(F.count(F.lit(1)).alias("loads"), F.count_distinct("session").alias("sessions"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)").alias("size_p50"))
    tokens = rows.groupBy("name").agg(F.sum(F.when(F.col("slot") == "load", F.col("tokens"))).alias("load_tokens"), F.sum(F.when(F.col("slot") == "carry", F.col("tokens"))).alias("carry_tokens"))
    return sizes.join(tokens, "name", "left").na.fill(0.0, ["load_tokens", "carry_tokens"])


def overlapping_skills(turns: DataFrame, least: int = 5, jaccard: float = 0.6) -> DataFrame:
    """Pairs of skills loaded in the same turns: shared turns and Jaccard. ``turns``: session, turn, name (bounded names a turn)."""
    rows = turns.select("session", "turn", "name").distinct()
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    pairs = rows.join(rows.withColumnRenamed("name", "other"), ["session", "turn"]).filter("name < other").groupBy("name", "other").agg(F.count(F.lit(1)).alias("shared"))
    both = pairs.join(sizes, "name").join(sizes.select(F.col("name").alias("other"), F.col("n").alias("m")), "other")
    return both.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).filter((F.col("shared") >= least) & (F.col("jaccard") >= jaccard)).select("name", "other", "shared", "jaccard")
