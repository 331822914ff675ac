"""Interval and order operators: unions, gap sessions, runs, overlap sweeps, as-of joins, conflicts, lanes, timelines.

Everything is partitioned by a key, and sweeps over many calls also by time bucket, so no window ever sees a whole table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def active_minutes(rows: DataFrame, by: list[str], t_ms: str = "t_ms", gap: int = 5) -> DataFrame:
    """Intervals of activity in whole clock minutes ``[first, last + 1)``; pauses of up to ``gap`` minutes are activity."""
    order = Window.partitionBy(*by).orderBy(t_ms)
    fresh = F.coalesce(F.col(t_ms) - F.lag(t_ms).over(order) > gap * 60000, F.lit(True))
    marked = rows.select(*by, t_ms).withColumn("_f", fresh.cast("int"))
    islands = marked.withColumn("_i", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    minute = F.floor(F.col(t_ms) / 60000)
    return islands.groupBy(*by, "_i").agg(F.min(minute).alias("first_minute"), (F.max(minute) + 1).alias("end_minute")).drop("_i")


def union_length(spans: DataFrame, by: list[str], t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Per key: length of the union of ``[t0, t1)`` and the number of separate pieces. Pieces that touch are one."""
    order = Window.partitionBy(*by).orderBy(t0, t1)
    reach = F.max(t1).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(t0) > reach, F.lit(True))
    pieces = spans.filter(F.col(t1) > F.col(t0)).withColumn("_f", fresh.cast("int")).withColumn("_i", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = pieces.groupBy(*by, "_i").agg(F.min(t0).alias("a"), F.max(t1).alias("b"))
    return merged.groupBy(*by).agg(F.sum(F.col("b") - F.col("a")).alias("union_ms"), F.count(F.lit(1)).alias("pieces"))


def runs(rows: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Runs of consecutive rows that agree in ``same``: key, value, first place and length."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    own = F.row_number().over(Window.partitionBy(*by, *same).orderBy(*order))
    marked = rows.withColumn("_p", place).withColumn("_g", place - own)
    return marked.groupBy(*by, *same, "_g").agg(F.min("_p").alias("first"), F.count(F.lit(1)).alias("length")).drop("_g")


def counter_deltas(rows: DataFrame, by: list[str], order: list[str], counters: list[str]) -> DataFrame:
    """Cumulative counters as growth per row; where any went backwards all start afresh."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = {c: F.coalesce(F.lag(c).over(w), F.lit(0)) for c in counters}
    reset = F.greatest(*(before[c] - F.col(c) for c in counters), F.lit(0)) > 0
    return rows.withColumns({f"{c}_delta": F.when(reset, F.col(c)).otherwise(F.col(c) - before[c]) for c in counters})


def split_by_bucket(spans: DataFrame, bucket_ms: int) -> DataFrame:
    """Each span cut at the bucket borders: one row a bucket that it touches, with ``bucket, t0, t1`` of the piece."""
    low, high = F.floor(F.col("t0") / bucket_ms), F.floor((F.col("t1") - 1) / bucket_ms)
    cut = spans.filter("t1 > t0").withColumn("bucket", F.explode(F.sequence(low, high)))
    return cut.withColumns({"t0": F.greatest("t0", F.col("bucket") * bucket_ms), "t1": F.least("t1", (F.col("bucket") + 1) * bucket_ms)})


def overlap(spans: DataFrame, group: str, span_id: str, bucket_ms: int = 3_600_000, least: int = 10) -> DataFrame:
    """Contention of ``[t0, t1)`` spans per group.

    Per group: calls, peak concurrency and its first time, ms at two or more and three or more, calls covered half or more by
    others, and the slowdown: median duration of these over that of the others, unknown with fewer than ``least`` on a side.
    Spans that touch do not overlap. The sweep runs per group and time bucket; pieces and covered time add up exactly.
    """
    pieces = split_by_bucket(spans.select(group, span_id, "t0", "t1"), bucket_ms)
    ends = pieces.select(group, span_id, "bucket", F.explode(F.array(F.struct(F.col("t0").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t1").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(group, span_id, "bucket", "e.*")
    w = Window.partitionBy(group, "bucket").orderBy("t", "d")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.withColumns({"open": F.sum("d").over(upto), "gap": F.coalesce(F.col("t") - F.lag("t").over(w), F.lit(0))}).withColumn("was", F.col("open") - F.col("d"))
    swept = swept.withColumn("shared", F.sum(F.when(F.col("was") >= 2, F.col("gap")).otherwise(0)).over(upto))
    peaks = swept.groupBy(group).agg(
        F.max("open").alias("peak"),
        F.max_by("t", F.struct("open", (-F.col("t")).alias("first"))).alias("peak_at"),
        F.sum(F.when(F.col("was") >= 2, F.col("gap")).otherwise(0)).alias("at_least_2_ms"),
        F.sum(F.when(F.col("was") >= 3, F.col("gap")).otherwise(0)).alias("at_least_3_ms"),
    )
    covered = swept.groupBy(group, span_id, "bucket").agg((F.max("shared") - F.min("shared")).alias("c"), (F.max("t") - F.min("t")).alias("len"))
    whole = covered.groupBy(group, span_id).agg(F.sum("c").alias("c"), F.sum("len").alias("len")).withColumn("over", F.col("c") * 2 >= F.col("len"))
    sides = whole.groupBy(group).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("over").alias("over"),
        F.percentile(F.when(F.col("over"), F.col("len")), 0.5).alias("over_p50"),
        F.percentile(F.when(~F.col("over"), F.col("len")), 0.5).alias("alone_p50"),
    )
    enough = (F.col("over") >= least) & (F.col("calls") - F.col("over") >= least)
    return sides.join(peaks, group).withColumn("slowdown", F.when(enough, F.try_divide("over_p50", "alone_p50")))


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, value: str, forward: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the latest ``right`` row at or before its time (or the first at or after)."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, t, F.col(value).alias("_v")).withColumn("_side", F.lit(2 if forward else 0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(t, "_side")
    found = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, found).filter("_side = 1").drop("_side", "_v")


def near_pairs(rows: DataFrame, key: list[str], t: str, within: int, session: str = "session", carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of different sessions under one key at most ``within`` ms apart: an equi join on time buckets, no range scan.

    Every pair of rows is made once; the columns ``carry`` come along as ``a_x`` and ``b_x``.
    """
    rows = rows.select(*key, F.col(session).alias("_s"), F.col(t).alias("_t"), *carry)
    side = lambda x, at: rows.select(*key, F.col("_s").alias(f"{x}_session"), F.col("_t").alias(f"{x}_t"), *(F.col(c).alias(f"{x}_{c}") for c in carry), at.alias("_cell"))
    cell = F.floor(F.col("_t") / within)
    met = side("a", cell).join(side("b", F.explode(F.array(cell - 1, cell))), [*key, "_cell"])  # b is not before a
    after = (F.col("b_t") > F.col("a_t")) | ((F.col("b_t") == F.col("a_t")) & (F.col("b_session") > F.col("a_session")))
    return met.filter(after & (F.col("b_t") - F.col("a_t") <= within) & (F.col("a_session") != F.col("b_session"))).drop("_cell")


def conflict_marks(writes: DataFrame, spawns: DataFrame, within: int) -> DataFrame:
    """Sessions that wrote one file within a time of each other, unless one delegated to the other.

    ``writes``: session, t_ms, top, rel. A parent's and its child's writes do not count outside the child's interval (``spawns``:
    parent, child, t0, t1); inside it they race. Same top: conflict, another worktree: overlap; a conflict wins. A write carries
    its session's spawns into the join (a child has few), since pairs can be many more than writes and do not move again.
    """
    told = spawns.groupBy(F.col("child").alias("session")).agg(F.collect_list(F.struct("parent", "t0", "t1")).alias("spawned"))
    named = writes.select("session", "t_ms", "top", "rel").distinct().join(told, "session", "left")
    pairs = near_pairs(named, ["rel"], "t_ms", within, carry=("top", "spawned"))
    of = lambda child, parent: F.explode_outer(F.filter(f"{child}_spawned", lambda x: x["parent"] == F.col(f"{parent}_session")))
    met = pairs.withColumn("d", of("b", "a")).withColumn("u", of("a", "b"))
    race = F.when(F.col("d.t0").isNotNull(), F.col("a_t").between(F.col("d.t0"), F.col("d.t1"))).when(F.col("u.t0").isNotNull(), F.col("b_t").between(F.col("u.t0"), F.col("u.t1")))
    kept = met.filter(F.coalesce(race, F.lit(True)))
    mark = F.when(F.col("a_top") == F.col("b_top"), "conflict").otherwise("overlap")
    return kept.select("rel", "a_session", "b_session", "a_t", "b_t", mark.alias("mark"), F.coalesce(race, F.lit(False)).alias("race"))


def clobbers(commands: DataFrame, writes: DataFrame, within: int) -> DataFrame:
    """Workspace-wide git commands (session, t_ms, top) that followed another session's write in the same top within a time."""
    cell = lambda t: F.floor(F.col(t) / within)
    a = commands.select("top", F.col("session").alias("c_session"), F.col("t_ms").alias("c_t"), F.explode(F.array(cell("t_ms") - 1, cell("t_ms"))).alias("_cell"))
    b = writes.select("top", F.col("session").alias("w_session"), F.col("t_ms").alias("w_t"), cell("t_ms").alias("_cell")).distinct()
    return a.join(b, ["top", "_cell"]).filter("w_t <= c_t").filter((F.col("c_t") - F.col("w_t") <= within) & (F.col("c_session") != F.col("w_session"))).drop("_cell")


def in_order(rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Callable], schema: str) -> DataFrame:
    """Rows of each key in ``order`` through a state machine that sees one row at a time.

    ``start`` gives a fresh step for each key; a step takes a row as a dict and gives the rows it makes, as tuples of ``schema``.
    Spark deals and sorts the rows (spilling where it must), and a task reads them in Arrow batches: it holds a batch and the
    machine's state, never a whole key.
    """

    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, step = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = tuple(r[c] for c in by)
                if step is None or own != key:
                    key, step = own, start()
                out += step(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(made)], schema=made)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def lanes(spans: DataFrame, by: list[str], lane: str = "lane") -> DataFrame:
    """Greedy lane packing: each span takes the lowest lane that is free at its start; equal spans go by their other columns.

    A key is cut where no span is open, as all lanes are free there, so the parts of one key are packed in different tasks. A
    task holds the spans that are open, no key and no part. Times are not null.
    """
    w = Window.partitionBy(*by).orderBy("t0", "t1")
    reach = F.max("t1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("_fresh", F.coalesce(F.col("t0") >= reach, F.lit(True)).cast("int"))
    cut = fresh.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    columns = spans.columns

    def start():
        busy: list[tuple[int, int]] = []
        free: list[int] = []

        def step(r: dict) -> list[tuple]:
            while busy and busy[0][0] <= r["t0"]:
                heapq.heappush(free, heapq.heappop(busy)[1])
            n = heapq.heappop(free) if free else len(busy)
            heapq.heappush(busy, (r["t1"], n))
            return [(*(r[c] for c in columns), n)]

        return step

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spans.schema) + f", {lane} long"
    return in_order(cut, [*by, "_island"], ["t0", "t1", *(c for c in columns if c not in (*by, "t0", "t1"))], start, schema)


def overlapping_pairs(spans: DataFrame, key: list[str], name: str, other: str = "other", bucket_ms: int = 86_400_000) -> DataFrame:
    """Spans of one key that overlap (ends included), both ways: an equi join on key and time bucket, each pair once a side.

    A pair meets in every bucket that both touch and is kept in the first one, so a hot key is dealt over its buckets.
    """
    first, last = F.floor(F.col("t0") / bucket_ms), F.floor(F.col("t1") / bucket_ms)
    cut = spans.withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, last)))
    right = cut.select(*key, "_bucket", *(F.col(c).alias(f"{other}_{c}") for c in (name, "t0", "t1", "_first")))
    met = cut.join(right, [*key, "_bucket"])
    kept = met.filter((F.col("_bucket") == F.greatest("_first", f"{other}__first")) & (F.col(name) != F.col(f"{other}_{name}")) & (F.col("t0") <= F.col(f"{other}_t1")) & (F.col(f"{other}_t0") <= F.col("t1")))
    return kept.select(*key, name, F.col(f"{other}_{name}").alias(other))


def _pieces(lo: str, hi: str, levels: int) -> str:
    """SQL of the dyadic intervals (level, place) that make up ``[lo, hi]``, at most two a level."""
    left, right = f"shiftright({lo} + shiftleft(1L, j) - 1, j)", f"shiftright({hi} + 1, j)"
    both = f"array(if({left} < {right} AND {left} & 1 = 1, struct(j AS level, {left} AS place), NULL), if({left} < {right} AND {right} & 1 = 1, struct(j AS level, {right} - 1 AS place), NULL))"
    return f"array_compact(flatten(transform(sequence(0, {levels}), j -> {both})))"


def _around(t: str, levels: int) -> str:
    """SQL of the dyadic intervals that hold the time ``t``, one a level."""
    return f"transform(sequence(0, {levels}), j -> struct(j AS level, shiftright({t}, j) AS place))"


def first_overlapping(spans: DataFrame, key: list[str], name: str, order: Column, k: int, other: str = "other", rank: str = "rank", short: int = 128, salts: int = 32, levels: int = 42) -> DataFrame:
    """For each span the first ``k`` spans of its key, by ``order``, that overlap it (ends included): ``key, name, other, rank``.

    ``order`` is ascending and ends with ``name``, which is unique within a key; spans have ``t0 <= t1`` and ``2 ** levels`` ms at most. No
    pairs are made beyond those asked for: every span meets the first ``short`` of its key, and is done if ``k`` of them overlap it,
    since all others come later. The rest ask dyadic intervals of time, of which each holds the first ``k + 1`` spans that start in it,
    and the first ``k + 1`` that it is a piece of. A span overlaps those that start within it after its own start, found by the pieces of
    its time, and those around its start, found by the intervals that hold that; so it meets ``3 (k + 1)`` spans a level at most.
    """
    mine = spans.select(*key, name, "t0", "t1", order.alias("_o"))
    others = mine.select(*key, F.col(name).alias(other), F.col("t0").alias("_s0"), F.col("t1").alias("_s1"), "_o")
    top = lambda df, by, n, at: df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy("_o"))).filter(F.col(at) <= n)
    firsts = top(others, key, short, "_at").drop("_at").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = mine.drop("_o").withColumn("_salt", F.pmod(F.xxhash64(name), F.lit(salts)).cast("int"))
    met = left.join(firsts, [*key, "_salt"]).filter((F.col(name) != F.col(other)) & (F.col("t0") <= F.col("_s1")) & (F.col("_s0") <= F.col("t1")))
    found = top(met.select(*key, name, other, "_o"), [*key, name], k, rank)
    done = found.filter(F.col(rank) == k).select(*key, name)
    ready = found.join(done.hint("merge"), [*key, name], "left_semi")
    rest = mine.drop("_o").join(done.hint("merge"), [*key, name], "left_anti")
    told = lambda cover, nodes: f"transform({nodes}, x -> struct({cover} AS cover, x.level AS level, x.place AS place))"
    tell = lambda starts, covers: F.explode(F.expr(f"concat({told(False, starts)}, {told(True, covers)})"))
    asked = rest.select(*key, name, tell(_pieces("t0 + 1", "t1", levels), _around("t0", levels)).alias("_node"))
    held = others.select(*key, other, "_o", tell(_around("_s0", levels), _pieces("_s0", "_s1", levels)).alias("_node"))
    held = top(held.join(asked.select(*key, "_node").distinct().hint("merge"), [*key, "_node"], "left_semi"), [*key, "_node"], k + 1, "_at").drop("_at")
    more = asked.join(held.hint("merge"), [*key, "_node"]).filter(F.col(name) != F.col(other))
    return ready.unionByName(top(more.select(*key, name, other, "_o"), [*key, name], k, rank)).select(*key, name, other, rank)


def timeline(spans: DataFrame, row: Column, width_ms: int) -> DataFrame:
    """Level of detail: spans of one row merged per cell of ``width_ms``, with their number and whole extent."""
    return spans.groupBy(row.alias("row"), F.floor(F.col("t0") / width_ms).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def self_time(spans: DataFrame, key: list[str], name: str) -> DataFrame:
    """Per name: spans, total and self time (own length less the children's), and the longest. ``spans``: id, parent, t0, t1."""
    length = F.col("t1") - F.col("t0")
    children = spans.filter("parent IS NOT NULL").groupBy(*key, F.col("parent").alias("id")).agg(F.sum(length).alias("inner"))
    own = spans.join(children, [*key, "id"], "left").withColumn("len", length)
    return own.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("total_ms"), F.sum(F.greatest(F.col("len") - F.coalesce("inner", F.lit(0)), F.lit(0))).alias("self_ms"), F.max("len").alias("max_ms")
    )


def turn_numbers(rows: DataFrame, by: list[str], order: list[str], opens: Column) -> DataFrame:
    """Number of the turn each row is in: a new one starts at every row that ``opens`` one (0 before the first)."""
    return rows.withColumn("turn", F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def causes(rows: DataFrame, by: list[str], order: str, failed: Column, reply: Column) -> DataFrame:
    """Each failed row with the place of the nearest earlier reply of its turn."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("cause", F.last(F.when(reply, F.col(order)), ignorenulls=True).over(w)).filter(failed)


def pair_results(calls: DataFrame, results: DataFrame, key: list[str], order: str, call_id: str | None = None) -> DataFrame:
    """Calls with their results, by ``call_id`` within ``key`` if it is given; what that leaves over, first in, first out.

    Equal ids pair in order, an id without a partner and a null id go by place, and null keys meet each other.
    """

    def matched(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
        on = [*by, "_n"]
        x, y = a.withColumn("_n", nth), b.withColumn("_n", nth)
        y = y.select(*(F.col(c).alias(f"_r_{c}") for c in on), *(F.col(c).alias(f"result_{c}") for c in extra))
        same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
        return x.join(y, same, "full_outer")

    extra = [c for c in results.columns if c not in key and c != call_id]
    made = [*calls.columns, *(f"result_{c}" for c in extra)]
    if call_id is None:
        return matched(calls, results, key).filter("_n IS NOT NULL").select(made)
    known = lambda df, yes: df.filter(F.col(call_id).isNotNull() if yes else F.col(call_id).isNull())
    met = matched(known(calls, True), known(results, True), [*key, call_id])
    paired = met.filter("_n IS NOT NULL AND _r__n IS NOT NULL").select(made)
    rest = met.filter("_r__n IS NULL").select(calls.columns).unionByName(known(calls, False))
    loose = met.filter("_n IS NULL").select(*(F.col(f"_r_{c}").alias(c) for c in (*key, call_id)), *(F.col(f"result_{c}").alias(c) for c in extra))
    return paired.unionByName(matched(rest, loose.unionByName(known(results, False)), key).filter("_n IS NOT NULL").select(made))


def spread_untimed(spans: DataFrame, parent: str = "parent") -> DataFrame:
    """Children without times, evenly over their parent's length, each in nine tenths of its slot. ``p0, p1``: the parent's."""
    w = Window.partitionBy(parent)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("seq")) - 1
    slot = (F.col("p1") - F.col("p0")) / n
    return spans.withColumn("t0", F.floor(F.col("p0") + slot * i)).withColumn("t1", F.floor(F.col("p0") + slot * i + slot * 0.9))
