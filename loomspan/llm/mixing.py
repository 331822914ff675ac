"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Documents lie, in a seeded order, on token lines of small shards (a shard is some hundred documents of one source).
A shard's line is cut into equal blocks. Blocks are allotted to the sources by highest quotients ``target / (2q + 1)``,
each source's quota is allotted to its shards in the same way, and every shard takes its quota from a seeded block
onward along its line. All steps are joins, grouped sums and windows of bounded size: the documents of a shard; the distinct
quotients of a source (as many as there are shard lengths, not shards) and, of shards that tie for its last seats, some
thousand at a time. Only the table of the sources itself is sorted in one task; its size is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import SPACE, Scratch, salted_join, spare, stored, word_count


def seeded(seed: int, *parts: str) -> Column:
    """A uniform 60-bit integer, the same on every run and engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(p).cast("string"), F.lit("~")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Targets: ``share`` of all sizes by weight, none above ``most`` times its size.

    ``sources`` has ``sid, source_size, weight``. Sources whose ceiling is low against their weight are filled first;
    one is full when its ceiling is at or below what the rest would give it. One row per source.
    """
    cap = F.col("source_size") * F.lit(most)
    order = Window.orderBy(cap / F.col("weight"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = sources.withColumns({
        "cap": cap,
        "rest": F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        "left": F.sum("weight").over(after),
    }).withColumn("full", F.col("cap") / F.col("weight") <= F.col("rest") / F.col("left"))
    free = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), (F.col("rest") / F.col("left")).alias("level")))).over(whole)
    return level.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(free["level"] * F.col("weight"))).drop("cap", "rest", "left", "full")


def sainte_lague(rows: DataFrame, weight: str, seats: str, key: str, group: str, tmp: Scratch, most: str | None = None, part: int = 4096) -> DataFrame:
    """Add ``quota``: the ``seats`` of each ``group`` allotted to its rows by highest quotients weight/(2q+1).

    ``key``, a long, tells the rows of a group apart and breaks ties; ``most`` names a column with the largest quota of a row.
    The divisor lies between total/(seats + n/2) and total/(seats - n/2), so every row surely has the seats below its lower
    bound and only those up to its upper bound compete: about two candidates a row. Candidates are counted by quotient; all of
    the highest quotients win, and those of the one quotient that is cut are ranked by ``key``, in parts of ``part`` keys.
    """
    sums = rows.groupBy(group).agg(F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("_n"))
    known = rows.join(sums, group)
    ratio = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0.0), F.floor(ratio * (F.col(seats) - F.col("_n") / 2) - F.lit(1.5)))
    high = F.greatest(low, F.ceil(ratio * (F.col(seats) + F.col("_n") / 2) + F.lit(1.5)))
    if most:
        low, high = F.least(low, F.col(most)), F.least(high, F.col(most))
    bounded = tmp.keep(known.select(*rows.columns, low.cast("long").alias("_low"), high.cast("long").alias("_high")), "bounded")
    open_ = bounded.groupBy(group).agg((F.first(seats) - F.sum("_low")).alias("_open"))
    tries = bounded.filter((F.col("_high") > F.col("_low")) & (F.col(weight) > 0)).select(group, key, weight, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_q"))
    tries = tmp.keep(tries.select(group, key, (F.col(weight) / (2 * F.col("_q") + 1)).alias("_quotient")), "tries")
    # By quotient: how many there are before it, and how many of its own win.
    levels = tries.groupBy(group, "_quotient").agg(F.count(F.lit(1)).alias("_held"))
    before = F.coalesce(F.sum("_held").over(Window.partitionBy(group).orderBy(F.col("_quotient").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumn("_before", before).join(open_, group).filter("_before < _open")
    levels = tmp.keep(levels.select(group, "_quotient", (F.col("_open") - F.col("_before")).alias("_left"), (F.col("_held") > F.col("_open") - F.col("_before")).alias("_cut")), "levels")
    in_play = tmp.keep(salted_join(tries, levels, [group, "_quotient"], key), "in_play")
    # The cut quotient's rows by key: whole parts first, then within a part.
    tied = in_play.filter("_cut").withColumn("_part", F.floor(F.col(key) / part))
    parts = tied.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_held"))
    parts = parts.withColumn("_ahead", F.coalesce(F.sum("_held").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_held")
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key)) + F.col("_ahead")
    lucky = tied.join(parts, [group, "_part"]).withColumn("_rank", rank).filter("_rank <= _left").select(group, key)
    won = in_play.filter("NOT _cut").select(group, key).unionByName(lucky).groupBy(group, key).agg(F.count(F.lit(1)).alias("_won"))
    quota = F.col("_low") + F.coalesce("_won", F.lit(0))
    return bounded.join(won, [group, key], "left").select(*rows.columns, quota.cast("long").alias("quota"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    shard_docs: int = 256,
    seed: int = 17,
    max_sources: int = 1_000_000,
) -> DataFrame:
    """What the mix takes of every document.

    Returns one row per input row: ``id, source, size, source_size, target, taken`` and the plan of the take:
    ``rounds`` (whole copies), ``spans``, an array of (first word, words) taken once more, and ``text_hash``. Sources in code-point
    order, null last, have ``weights`` in turn. Error of a source: half a block, and in each shard less than a word
    a block. A null or empty text has size 0 and nothing is taken; repeated rows each count (they lie side by side on
    the line, so any of them may be cut); a null id is an id of its own; an empty table gives no rows; other columns
    are not read, whatever their names; a very long text costs its length. No document is taken more than ``most`` times, rounded
    up to whole copies. Sources are sorted and filled in one task; more than ``max_sources`` of them is an error.
    """
    with Scratch(docs.sparkSession, "mix") as tmp:
        return stored(_mix(docs, id_col, text_col, source_col, weights, share, most, block_words, shard_docs, seed, max_sources, tmp), "mix")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: float, block_words: int, shard_docs: int, seed: int, max_sources: int, tmp: Scratch) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))
    rows = tmp.keep(rows, "sizes")  # the texts are read once
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = tmp.keep(sources, "sources")
    if (n := sources.count()) > max_sources:
        raise ValueError(f"{n} sources; the mix takes {max_sources}")
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("sid", place).withColumn("weight", weight.cast("double"))
    sources = tmp.keep(water_fill(sources, share, most), "targets")

    n_shards = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs))
    placed = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))  # null joins null
    placed = placed.withColumn("h", seeded(seed, "id")).withColumn("shard", F.pmod("h", n_shards)).select("id", "source", "size", "text_hash", "sid", "source_size", "target", "h", "shard")
    line = Window.partitionBy("sid", "shard").orderBy("h", F.col("id").asc_nulls_last(), "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("upto", F.sum("size").over(line))
    lined = tmp.keep(lined, "lines")

    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block_words))).otherwise(F.lit(0)).cast("long")
    shards = lined.groupBy("sid", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", blocks)
    per_source = shards.groupBy("sid").agg(F.sum("blocks").alias("own_blocks"))
    wanted = sources.select("sid", "source_size", "target")
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    allotted = sainte_lague(wanted.withColumn("seats", seats).withColumn("all", F.lit(0)), "target", "seats", "sid", "all", tmp)
    # A source's blocks have the length that its shards gave them; its quota is counted in these.
    ratio = F.when(F.col("source_size") > 0, F.col("quota") * block_words / F.col("source_size")).otherwise(F.lit(0.0))
    held = allotted.join(per_source, "sid").select("sid", F.round(F.least(ratio, F.lit(most)) * F.col("own_blocks")).cast("long").alias("seats"))
    ceiling = F.ceil(F.col("blocks") * F.lit(most)).cast("long")
    quotas = sainte_lague(shards.join(held, "sid").withColumn("ceiling", ceiling), "blocks", "seats", "shard", "sid", tmp, "ceiling")
    quotas = quotas.select("sid", "shard", "words", "blocks", "quota").withColumns({
        "rounds": F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0)).cast("long"),
        "first": F.when(F.col("blocks") > 0, F.pmod(seeded(seed + 1, "sid", "shard"), F.col("blocks"))).otherwise(F.lit(0)).cast("long"),
    }).withColumn("last", F.col("first") + F.col("quota") - F.col("rounds") * F.col("blocks"))
    edge = lambda k: F.expr(f"CASE WHEN blocks > 0 THEN ({k}) * words DIV blocks ELSE 0L END")
    arcs = quotas.select(
        "sid", "shard", "rounds", edge("first").alias("a0"), edge("least(last, blocks)").alias("a1"), edge("greatest(last - blocks, 0L)").alias("b1")
    )
    start = F.col("upto") - F.col("size")

    def cut(a, b):
        """(first word in the document, number of words) of the line's [a, b)."""
        low, high = F.greatest(a, start), F.least(b, F.col("upto"))
        return F.struct((low - start).alias("first"), F.greatest(F.lit(0), high - low).cast("long").alias("words"))

    cuts = F.filter(F.array(cut(F.lit(0).cast("long"), F.col("b1")), cut(F.col("a0"), F.col("a1"))), lambda x: x["words"] > 0)
    out = lined.join(arcs, ["sid", "shard"]).withColumn("spans", cuts)
    taken = F.col("rounds") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return out.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "rounds", "spans", "text_hash")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: the rows of ``docs``, as often and as far as :func:`mix` takes them, columns unchanged.

    A whole copy is the unchanged text; a partial take is a copy whose text is the taken run of words with the white
    space between them. Rows of which nothing is taken are left out. Repeated rows (same id and same text) are told
    apart by a number; null ids and null sources are values like others.
    """
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("words"))
    parts = F.concat(F.when(F.col("rounds") > 0, F.array_repeat(whole, F.col("rounds").cast("int"))).otherwise(F.array()), F.col("spans"))

    h, n, t_id, t_source, t_h, t_n, t_size, part = spare(docs, "_h", "_n", "_t_id", "_t_source", "_t_h", "_t_n", "_t_size", "_part")

    def numbered(df: DataFrame, id_: str, source: str, hash_: Column, *order: str) -> DataFrame:
        """Equal rows by number: the plan's n-th goes to the table's n-th."""
        w = Window.partitionBy(id_, source, h).orderBy(*(order or (h,)))
        return df.withColumn(h, hash_).withColumn(n, F.row_number().over(w))

    takes = numbered(plan.filter((F.col("rounds") > 0) | (F.size("spans") > 0)), "id", "source", F.col("text_hash"), "rounds", "taken")
    takes = takes.select(F.col("id").alias(t_id), F.col("source").alias(t_source), F.col(h).alias(t_h), F.col(n).alias(t_n), F.col("size").alias(t_size), F.explode(parts).alias(part))
    rows = numbered(docs, id_col, source_col, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(t_id)) & F.col(source_col).eqNullSafe(F.col(t_source)) & (F.col(h) == F.col(t_h)) & (F.col(n) == F.col(t_n))
    joined = rows.join(takes, same)
    first, words = F.col(part)["first"], F.col(part)["words"]
    pieces = F.regexp_extract_all(text_col, F.lit("[^\\x20\\x09-\\x0D]+" + SPACE + "*"), 0)
    run = F.rtrim(F.array_join(F.slice(pieces, (first + 1).cast("int"), words.cast("int")), ""))
    text = F.when(words == F.col(t_size), F.col(text_col)).otherwise(run)
    return joined.withColumn(text_col, text).filter(words > 0).select(docs.columns)
