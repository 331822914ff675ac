"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint is cut into ``blocks`` parts. Two fingerprints that differ in at most ``distance`` bits agree in at least
``blocks - distance`` parts, so every close pair meets under one of the C(blocks, distance) choices of agreeing parts.
Only distinct fingerprints are joined (copies share one). The rows of a small bucket meet in a join. In a large one every row
meets two hubs first, the least and the greatest row; buckets whose rows are then in one component are done, and in the others
the rows outside the commonest component meet the rest, dealt by hash into parts of bounded size. No link is lost, and rows
that are linked already are not paired.

Blocks of 64 bits reach pairs that are nearly equal, not a shingle similarity of 0.8: there 10 of 64 bits differ on average,
and blocks that 20 differing bits leave alone would have 3 bits. :func:`similar_groups` therefore takes the pairs that the blocks and
the Hamming distance give first, as above, decides each by the shingle sets, and lets what they cannot reach meet as
:mod:`loomspan.llm.set_join` does, under the Hamming distance of a 512-bit fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, large, salted_join, spare, stored, text_slices
from loomspan.llm.components import components
from loomspan.llm.ngram_join import CountVectors
from loomspan.llm.set_join import set_groups
from loomspan.llm.shingles import mixed, shingle_hashes

def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have; zero for none."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 4, views: int = 1, seed: int = 42) -> list[int]:
    """64-bit SimHashes of the word shingles of a text, repeats included, one per view; no words: zero."""
    return fingerprint_of(shingle_hashes(text, shingle, seed), views)


def fingerprint_of(hashes: np.ndarray, views: int) -> list[int]:
    """The SimHashes of shingle hashes; every further view hashes them anew."""
    found = []
    for view in range(views):
        hashes = mixed(hashes) if view else hashes
        found.append(majority(hashes))
    return found


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """Rows ``id, h, fp``: a hash of the text and its fingerprint (64 bits as a signed long), one per input row."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_slices(batches, 2):
            fps = np.array([fingerprint(t, shingle)[0] for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["id", "h", "fp"])

    return source.mapInArrow(run, f"id {kind}, h long, fp long")


def block_keys(blocks: int, distance: int, word: str = "fp") -> list[Column]:
    """One masked word per choice of blocks that agree."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    masks = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    chosen = [sum(masks[i] for i in c) for c in combinations(range(blocks), blocks - distance)]
    return [F.col(word).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in chosen]


def outside_pairs(buckets: DataFrame, key: list[str], near: Callable[[str, str], Column], chunk: int) -> DataFrame:
    """Pairs ``a, b`` of different ``root`` in a bucket that are ``near``.

    In a bucket the rows outside the commonest root meet all others, which are dealt by hash to parts of about ``chunk`` rows; rows
    of one root never meet. ``buckets`` has ``key``, ``fp``, ``root`` and the columns x that ``near`` knows as ``a_x`` and ``b_x``.
    """
    spread = buckets.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("held"))
    live = spread.groupBy(*key).agg(F.max_by("root", "held").alias("major"), F.ceil(F.sum("held") / chunk).cast("long").alias("parts"), F.count(F.lit(1)).alias("roots"))
    mine = buckets.join(large(live.filter("roots > 1").drop("roots")), key)
    rest = [c for c in buckets.columns if c not in (*key, "fp")]
    told = lambda x, part: mine.select(*key, "major", "parts", F.col("fp").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in rest), part.alias("part"))
    outside = told("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("a_root <> major").drop("major", "parts")
    every = told("b", F.pmod(F.xxhash64("fp"), F.col("parts")))
    once = (F.col("b_root") == F.col("major")) | (F.col("a") < F.col("b"))
    return outside.join(large(every), [*key, "part"]).filter((F.col("a_root") != F.col("b_root")) & once & near("a", "b")).select("a", "b")


def links(fps: DataFrame, tmp: Scratch, distance: int = 4, blocks: int = 7, bucket: int = 16, chunk: int = 1024) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints of column ``fp`` that span every component at ``distance``."""
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    keys = fps.select("fp", F.posexplode(F.array(*block_keys(blocks, distance))).alias("choice", "key"))
    sizes = keys.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("n > 1")
    met = tmp.keep(keys.join(large(sizes), ["choice", "key"]), "buckets")
    few = met.filter(F.col("n") <= bucket).select("choice", "key", F.col("fp").alias("a"))
    pairs = few.join(large(few.withColumnRenamed("a", "b")), ["choice", "key"]).filter((F.col("a") < F.col("b")) & near("a", "b")).select("a", "b")
    many = met.filter(F.col("n") > bucket)
    hubs = many.select(F.col("fp").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter((F.col("a") != F.col("b")) & near("a", "b"))
    found = tmp.keep(pairs.unionByName(hubs).distinct(), "links")
    if many.isEmpty():
        return found
    roots = components(found, "a", "b", tmp)
    rooted = many.select("choice", "key", "fp").join(large(roots), F.col("fp") == F.col("node"), "left").select("choice", "key", "fp", F.coalesce("root", "fp").alias("root"))
    more = outside_pairs(tmp.keep(rooted, "rooted"), ["choice", "key"], near, chunk)
    return found.unionByName(tmp.keep(more.distinct(), "links"))


def _grouped(rows: DataFrame, links: DataFrame, tmp: Scratch) -> DataFrame:
    """``rows`` (``id, h, fp``) with the component of each: its first row's ``first_id, first_h`` (a null id counts last)."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    distinct = tmp.keep(rows.groupBy("fp").agg(F.min(order).alias("first")), "firsts")
    found = tmp.keep(components(links, "a", "b", tmp), "roots")
    rooted = tmp.keep(found.join(large(distinct), found.node == distinct.fp).select("fp", "root", "first"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("best"))
    named = salted_join(rooted, least, ["root"], "fp").select(F.col("fp").alias("f"), "best")
    labels = distinct.join(large(named), distinct.fp == F.col("f"), "left").select("fp", F.coalesce("best", "first").alias("best"))
    labels = tmp.keep(labels, "labels")  # so that copies by the thousand meet their label in a join that Spark can split
    return rows.join(large(labels), "fp").select("id", "h", "fp", F.col("best.id").alias("first_id"), F.col("best.h").alias("first_h"))


def _near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, **settings) -> DataFrame:
    with Scratch(docs.sparkSession, "simhash") as tmp:
        rows = tmp.keep(fingerprints(docs, id_col, text_col, shingle), "fps")
        return stored(_grouped(rows, links(rows.select("fp").distinct(), tmp, **settings), tmp), "simhash-groups")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: ``id, fp, component_id``, the smallest id that links lead to, itself included.

    ``settings``: words per ``shingle`` (4); bits by which linked fingerprints may differ (``distance``, 4); ``blocks`` (7 give 35
    keys of some 27 bits and suit up to about 10^9 distinct fingerprints, 8 give 70 keys of 32 bits for some ten times that);
    ``bucket``, the size up to which rows of a bucket meet at once, and ``chunk``, that of the parts of a large one.

    Null and empty texts (and texts of white space) have fingerprint zero and are linked like any other; a very long text costs
    its length. Repeated rows have equal fingerprints, so share a component. A null id counts last: a component of null ids
    only has a null component id. An empty table gives no rows; other columns are not read, whatever their names.
    """
    return _near_rows(docs, id_col, text_col, **settings).select("id", "fp", F.col("first_id").alias("component_id"))


class Fingerprints:
    """A :class:`~loomspan.llm.set_join.Bound`: SimHashes of the set in several views by their Hamming distance, and its count vector.

    Of ``views`` (8) words of 64 bits at most ``farthest`` may differ (150, from 64 shingles on 130): at a similarity of 0.8 78 differ on
    average with a standard deviation of 8, with the least favourable sets, of four and five shingles, 96 and 9. Six standard
    deviations lie between, so of a billion such pairs about one may be ruled out. The count vector rules out for certain, and much
    of what lies between 0.6 and 0.8, where fingerprints of this length tell little.
    """

    kind = "long"

    def __init__(self, counts: CountVectors, views: int = 8, farthest: tuple[int, int] = (150, 130)):
        self.counts, self.views, self.farthest = counts, views, farthest

    def point(self, hashes: np.ndarray) -> np.ndarray:
        """The fingerprint's words, then the counts."""
        return np.concatenate([np.array(fingerprint_of(hashes, self.views), np.uint64).view(np.int64), self.counts.point(hashes)])

    def allows(self, a: Column, a_size: Column, b: Column, b_size: Column) -> Column:
        (a_bits, b_bits), (a_counts, b_counts) = ([F.slice(x, at, n) for x in (a, b)] for at, n in ((1, self.views), (1 + self.views, self.counts.groups)))
        apart = F.aggregate(F.zip_with(a_bits, b_bits, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        return (apart <= F.when(F.least(a_size, b_size) < 64, self.farthest[0]).otherwise(self.farthest[1])) & self.counts.allows(a_counts, a_size, b_counts, b_size)

    def tile(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = self.counts.tile(a[:, self.views :], a_size, b[:, self.views :], b_size)
        apart = np.bitwise_count((a[i, : self.views] ^ b[j, : self.views]).view(np.uint64)).sum(1, dtype=np.int64)
        fits = apart <= np.where(np.minimum(a_size[i], b_size[j]) < 64, *self.farthest)
        return i[fits], j[fits]


def hamming_pairs(sets: DataFrame, tmp: Scratch, **settings) -> DataFrame:
    """Pairs ``a, b`` of nodes whose SimHash, the first word of their ``point``, is the same or linked by :func:`links`: blocks, join, Hamming distance."""
    words = tmp.keep(sets.select("node", F.element_at("point", 1).alias("fp")), "words")
    names = tmp.keep(words.groupBy("fp").agg(F.min("node").alias("named")), "names")
    same = salted_join(words, names, ["fp"], "node").filter("node <> named").select(F.col("named").alias("a"), F.col("node").alias("b"))
    side = lambda x: names.select(F.col("fp").alias(x), F.col("named").alias(f"{x}_node"))
    near = salted_join(salted_join(links(names.select("fp"), tmp, **settings), side("a"), ["a"], "b"), side("b"), ["b"], "a")
    return same.unionByName(near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))


def _similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, shingle: int = 5, **settings) -> DataFrame:
    return set_groups(docs, id_col, text_col, "similar", Fingerprints(CountVectors(similarity)), shingle, similarity, first=hamming_pairs, **settings)


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: ``id, component_id``, the smallest id that links of ``similarity`` (0.8) or more lead to.

    Similarity is that of the sets of word shingles (``shingle``, 5 words), and every link is decided by the two sets of 64-bit
    shingle hashes. Pairs of :func:`hamming_pairs` come first; :mod:`loomspan.llm.set_join` tells which others meet, :class:`Fingerprints`
    which of them are compared.

    Null and empty texts are equal to each other and to texts of white space; a very long text costs its length; repeated rows
    share a group. A null id counts last: a group of null ids only has a null ``component_id``. An empty table gives no rows;
    other columns are not read, whatever their names.
    """
    return _similar_rows(docs, id_col, text_col, **settings).select("id", F.col("first_id").alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **settings) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the smallest id (null last); columns unchanged.

    Groups are those of :func:`similar_groups` where a ``similarity`` is given, else of :func:`near_duplicates`, with their cases. Rows
    are told apart by id and text, not by id alone: rows of one id, or of a null id, in different groups all stay; of rows with
    the same id in one group, that of the smallest text hash stays, and of rows of the same id and text one.
    """
    if similarity is None:
        found = _near_rows(docs, id_col, text_col, **settings)
    else:
        found = _similar_rows(docs, id_col, text_col, similarity=similarity, **settings)
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    h, gone_id, gone_h = spare(docs, "_h", "_gone_id", "_gone_h")
    told = lambda df: df.select(F.col("id").alias(gone_id), F.col("h").alias(gone_h)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.col(h) == F.col(gone_h))
    kept = docs.withColumn(h, F.xxhash64(text_col)).join(told(found.filter(~stays)), same, "left_anti")
    twice = stored(found.filter(stays).groupBy("id", "h").count().filter("count > 1").drop("count"), "simhash-repeated")
    if not twice.isEmpty():
        kept = kept.join(told(twice), same, "left_anti").unionByName(kept.join(told(twice), same, "left_semi").dropDuplicates([id_col, h]))
    return kept.select(docs.columns)
