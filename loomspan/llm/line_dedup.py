"""Line dedup by distinct-site spread: lines that occur on many sites are boilerplate.

A HyperLogLog sketch of sites per line hash merges by aggregation (pre-aggregated in every task, so a line that a third of
all documents share costs its reducer one sketch a task). Lines whose estimate is near the threshold get an exact distinct
count. One document, the first by id, keeps a boilerplate line; all others lose it. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, salted_join, spare, stored

_EDGE = " \t\r\x0b\x0c"


def line_key(line: Column) -> list[Column]:
    """128 bits of a line without the white space at its ends: hashes of the line and of the line behind another character."""
    bare = F.btrim(line, F.lit(_EDGE))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.concat(F.lit("#"), bare)).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGE)) != ""


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int, tmp: Scratch) -> DataFrame:
    """Keys ``h1, h2`` of lines on ``min_sites`` sites or more, with ``first_id``, the smallest id that has the line.

    The sketch's standard error is 1.04 / sqrt(2 ** lg_k); estimates within four of these (at least one) of the threshold
    are counted exactly.
    """
    band = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"), F.min("id").alias("first_id"))
    spread = tmp.keep(spread.filter(F.col("estimate") >= min_sites - band), "spread")
    sure = spread.filter(F.col("estimate") > min_sites + band)
    near = spread.filter(F.col("estimate") <= min_sites + band)
    sites = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = sites.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).filter(F.col("sites") >= min_sites).select("h1", "h2")
    return sure.select("h1", "h2", "first_id").unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first_id"))


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 5,
    lg_k: int = 12,
    removed_col: str | None = None,
) -> DataFrame:
    """``docs`` without boilerplate lines: the same rows and columns, ``text_col`` shortened.

    A line has a word; lines are equal without white space at their ends. A null site is one site of its own. Null texts
    stay null, a text may become empty, rows with a null id have no first place (a line whose holders all have null ids is
    kept by none). Repeated rows of the first id keep its lines. An empty table gives an empty table. ``removed_col`` adds
    the number of removed lines (a column of that name is replaced); other columns may have any name. The time grows with the
    number of lines of a text, not its square.
    """
    text = F.col(text_col)
    rest = [c for c in docs.columns if c != removed_col]
    h, bad_id, bad_h, bad_at, split = spare(docs, "_h", "_bad_id", "_bad_h", "_bad_at", "_split")
    with Scratch(docs.sparkSession, "lines") as tmp:
        site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
        found = docs.select(F.col(id_col).alias("id"), site.alias("site"), F.xxhash64(text).alias("x"), F.posexplode(_lines(text)).alias("pos", "line"))
        lines = tmp.keep(found.filter(_has_word(F.col("line"))).select("id", "site", "x", "pos", *line_key(F.col("line"))), "keys")
        boiler = boilerplate(lines, min_sites, lg_k, tmp)
        bad = salted_join(lines, boiler, ["h1", "h2"], "id").filter(~F.col("id").eqNullSafe(F.col("first_id")) | F.col("id").isNull())
        marks = bad.groupBy("id", "x").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # repeated rows have the same places
        marks = stored(marks, "line-marks").select(F.col("id").alias(bad_id), F.col("x").alias(bad_h), F.col("at").alias(bad_at))
    own = docs.select(*rest).withColumn(h, F.xxhash64(text))
    joined = own.join(marks, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.col(h) == F.col(bad_h)), "left")
    joined = joined.withColumn(split, F.when(F.col(bad_at).isNotNull(), _lines(text)))  # once a row
    # The runs of lines between the bad ones; neither lines nor marks are searched.
    edges = F.concat(F.array(F.lit(-1)), F.col(bad_at), F.array(F.size(split)))
    runs = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.slice(split, a + 2, b - a - 1))
    short = F.when(F.col(bad_at).isNull(), text).otherwise(F.array_join(F.flatten(runs), "\n"))
    columns = [short.alias(c) if c == text_col else F.col(c) for c in rest]
    if removed_col:
        columns.append(F.when(F.col(bad_at).isNull(), F.lit(0)).otherwise(F.size(bad_at)).cast("long").alias(removed_col))
    return joined.select(*columns)
