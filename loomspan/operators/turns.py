"""Turns of a session: where they open and close, the spans they make, and the span under which a subagent hangs."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.intervals import in_order

#: Lines that leave a turn open, and lines that close one. Any other kind (or null) is passed over.
OPENERS = ("prompt", "started", "activity")
CLOSERS = ("complete", "aborted")


def line_kind(kind: Column, text: Column) -> Column:
    """Kind of a log line for the automaton: prompts, what the harness says of turns, and activity; null for other meta lines."""
    told = F.when(text == "turn started", "started").when(text.startswith("turn complete"), "complete").when(text == "turn aborted", "aborted")
    return F.when(kind == "user", "prompt").when(kind == "meta", told).when(kind.isNotNull(), "activity")


def told_ms(text: Column) -> Column:
    """Length that a closing line tells (``turn complete · 44.3s``), in ms; null if it tells none."""
    return F.round(F.regexp_extract(text, r"· ([0-9.]+)s", 1).try_cast("double") * 1000).cast("long")


def turn_steps(lines: DataFrame, by: list[str], order: str, quiet_ms: int | None = None) -> DataFrame:
    """``lines`` (``by``, ``order``, kind, t_ms) with what each does: ``opens, closes, late, fills, turn``, and times.

    A prompt opens a turn unless the open one still waits for its prompt (it was ``started``; such a prompt ``fills`` it). ``started``
    always opens one, activity only where none is open; it is ``late`` if a pause closed the last one. ``complete`` and ``aborted``
    close an open turn. A pause of more than ``quiet_ms`` before any line closes it too. A line without a time has that of the latest
    before it. ``turn`` is 0 before the first turn. What is open before a line depends only on the last line that
    opened or closed and on the pauses since, so windows over one sort of each session give the automaton's states.
    """
    whole = Window.partitionBy(*by).orderBy(order)
    upto, before = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(Window.unboundedPreceding, -1)
    last_where = lambda yes: F.last(F.when(yes, F.struct("kind", "_pauses")), ignorenulls=True).over(before)
    opener, closer = F.col("kind").isin(*OPENERS), F.col("kind").isin(*CLOSERS)
    still = lambda s: F.col(s)["_pauses"] == F.col("_pauses")
    no = F.lit(False)
    timed = lines.withColumn("_last", F.max("t_ms").over(upto)).withColumn("t_ms", F.coalesce("t_ms", "_last"))
    pause = F.lit(0) if quiet_ms is None else F.coalesce((F.col("t_ms") - F.lag("_last").over(whole) > quiet_ms).cast("int"), F.lit(0))
    timed = timed.withColumn("_pause", pause).withColumn("_pauses", F.sum("_pause").over(upto))
    timed = timed.withColumn("_d", last_where(opener | closer)).withColumn("_open", F.coalesce(F.col("_d")["kind"].isin(*OPENERS) & still("_d"), no))
    timed = timed.withColumn("closes", F.coalesce(closer & F.col("_open"), no))
    timed = timed.withColumn("_p", last_where(F.col("kind").isin("prompt", "started") | F.col("closes"))).withColumn("_e", last_where(opener | F.col("closes")))
    waits = F.coalesce((F.col("_p")["kind"] == "started") & still("_p"), no)
    timed = timed.withColumn("fills", F.coalesce((F.col("kind") == "prompt") & waits, no))
    opens = (F.col("kind") == "started") | ((F.col("kind") == "prompt") & ~F.col("fills")) | ((F.col("kind") == "activity") & ~F.col("_open"))
    timed = timed.withColumn("opens", F.coalesce(opens, no))
    timed = timed.withColumn("late", F.coalesce(F.col("opens") & (F.col("kind") == "activity") & F.col("_e")["kind"].isin(*OPENERS), no))
    return timed.withColumn("turn", F.sum(F.col("opens").cast("long")).over(upto)).drop("_d", "_p", "_e", "_open", "_pause")


def turn_spans(lines: DataFrame, by: list[str], order: str, quiet_ms: int | None = None) -> DataFrame:
    """One row per turn: ``by, turn, opened_by, place, prompt_place, t0, t1, closed_by, late``.

    ``lines``: ``by``, ``order``, kind, t_ms and ms (the length that a closing line tells; it may move ``t0`` back). ``closed_by`` is complete,
    aborted, quiet, next (another turn opened) or open. A turn ends at its closing line, at the opener that ends it, at
    the last line before the pause, or at the last line; never before an earlier line's time. ``prompt_place`` is null without a prompt.
    Lines of one key and ``order`` come in no certain order. Times are null where no line so far has one. Lines shuffle once.
    """
    steps = turn_steps(lines.select(*by, order, "kind", "t_ms", "ms"), by, order, quiet_ms)
    whole = Window.partitionBy(*by).orderBy(order)
    steps = steps.withColumn("_next", F.lead(F.struct("_last", "_pauses")).over(whole)).filter("turn > 0")
    found = steps.groupBy(*by, "turn").agg(
        F.min_by(F.struct("kind", F.col(order).alias("place"), F.col("t_ms").alias("t"), "late", "_pauses"), order).alias("o"),
        F.min(F.when(F.col("fills") | (F.col("opens") & (F.col("kind") == "prompt")), F.col(order))).alias("prompt_place"),
        F.min_by(F.when(F.col("closes"), F.struct("kind", F.col("_last").alias("end"), F.col("t_ms").alias("t"), "ms")), F.when(F.col("closes"), F.col(order))).alias("c"),
        F.max(F.greatest("_pauses", F.col("_next")["_pauses"])).alias("pauses"),
        F.max_by(F.struct(F.col("_next")["_last"].alias("end"), F.col("_next").isNotNull().alias("known")), order).alias("n"),
        F.max(F.struct(-F.col("_pauses"), F.col("_last"))).alias("stretch"),
        F.max("_last").alias("last"),
    )
    quiet = F.col("pauses") > F.col("o")["_pauses"]
    closed_by = F.when(F.col("c").isNotNull(), F.col("c")["kind"]).when(quiet, "quiet").when(F.col("n")["known"], "next").otherwise("open")
    end = F.when(F.col("c").isNotNull(), F.col("c")["end"]).when(quiet, F.col("stretch")["_last"]).when(F.col("n")["known"], F.col("n")["end"]).otherwise(F.col("last"))
    back = F.when(F.col("c")["ms"] > 0, F.col("c")["t"] - F.col("c")["ms"])
    return found.select(
        *by, "turn", F.col("o")["kind"].alias("opened_by"), F.col("o")["place"].alias("place"), "prompt_place",
        F.least(F.col("o")["t"], back).alias("t0"), F.greatest(F.col("o")["t"], end).alias("t1"), closed_by.alias("closed_by"), F.col("o")["late"].alias("late"),
    )


def innermost(points: DataFrame, spans: DataFrame, by: list[str], name: str) -> DataFrame:
    """``points`` (``by``, t, and more) with ``name``: the ``id`` of the deepest span (``by``, id, place, depth, t0, t1) that holds t, ends included.

    Of equally deep spans the one latest in place is taken; outside all spans, and for a null t, it is null. A key is cut where no span is open, so
    its parts are swept in different tasks; a task holds at most some twice the spans that are open at once.
    """
    carried = [c for c in points.columns if c not in (*by, "t")]
    a = points.select(*by, "t", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_end"), F.struct(*(F.col(c) for c in carried)).alias("_row"), F.lit(None).alias("_span"))
    b = spans.filter("t1 >= t0").select(*by, F.col("t0").alias("t"), F.lit(0).alias("_side"), F.col("t1").alias("_end"), F.lit(None).alias("_row"), F.struct("depth", "place", "id").alias("_span"))
    both = a.unionByName(b)
    w = Window.partitionBy(*by).orderBy("t", "_side", F.col("_end").desc())
    reach = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = both.withColumn("_fresh", F.coalesce(F.col("t") > reach, F.lit(True)).cast("int"))
    cut = cut.withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")

    def start():
        held: list[tuple] = []
        limit = 64

        def step(r: dict) -> list[tuple]:
            nonlocal limit
            t, span = r["t"], r["_span"]
            if span is not None:
                heapq.heappush(held, (-span["depth"], -span["place"], r["_end"], span["id"]))
                if len(held) > limit:  # those that ended lie below deeper ones: put them out, at a constant cost a span
                    held[:] = [h for h in held if h[2] >= t]
                    heapq.heapify(held)
                    limit = 2 * len(held) + 64
                return []
            while held and (t is None or held[0][2] < t):
                heapq.heappop(held)
            return [(*(r[c] for c in by), t, *(r["_row"][c] for c in carried), held[0][3] if held else None)]

        return step

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    kept = [*by, "t", *carried]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{name}` {spans.schema['id'].dataType.simpleString()}"
    return in_order(cut, [*by, "_island"], ["t", "_side"], start, schema)


def attach_spans(children: DataFrame, spans: DataFrame, by: list[str], slack_ms: int = 1000) -> DataFrame:
    """``children`` (``by``, child, call_id, t) with the span of their parent they hang under: ``host`` and ``how``.

    First the span with the child's ``call_id`` (``id``; the first in place, if several), else the spawning call latest in place that started
    at most ``slack_ms`` after the child (``spawn``), else the deepest span that holds the child's start (``enclosing``), else null. A child
    without a time hangs by id only. ``spans``: ``by``, id, call_id, place, spawns, depth, t0, t1. Three passes by key, none of which pairs
    a child with more than one span. Columns of ``children`` beyond the four are kept unless they begin with ``_``.
    """
    known = spans.filter("call_id IS NOT NULL").groupBy(*by, "call_id").agg(F.min_by("id", "place").alias("_host_id"))
    named = children.join(known, [*by, "call_id"], "left")
    a = named.withColumns({"_at": F.col("t") + slack_ms, "_side": F.lit(1), "_s": F.lit(None).cast(spans.select(F.struct("place", "id").alias("s")).schema["s"].dataType)})
    b = spans.filter("spawns AND t0 IS NOT NULL").select(*by, F.col("t0").alias("_at"), F.lit(0).alias("_side"), F.struct("place", "id").alias("_s"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b, allowMissingColumns=True).withColumn("_host_spawn", F.max("_s").over(w)["id"]).filter("_side = 1").drop("_at", "_side", "_s")
    met = innermost(met, spans, by, "_host_enclosing")
    order = {"id": "_host_id", "spawn": F.when(F.col("t").isNotNull(), F.col("_host_spawn")), "enclosing": "_host_enclosing"}
    ways = [(how, F.col(c) if isinstance(c, str) else c) for how, c in order.items()]
    how = reduce(lambda w, x: w.when(x[1].isNotNull(), x[0]), ways, F)
    return met.withColumn("how", how).withColumn("host", F.coalesce(*(c for _, c in ways))).drop("_host_id", "_host_spawn", "_host_enclosing")
