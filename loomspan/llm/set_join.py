"""Groups of sets of shingles that links of a Jaccard similarity join, found without making all pairs of a family.

1. Rows of equal sets become one node. Every node is keyed by its first ``n - ceil(similarity n) + l`` shingles in one order of all
   shingles, seldom ones first, with ``l = 1 + n // 20``. Two sets of that similarity share as many such keys as the lesser of their
   ``l``, and in the smaller one they are within its first ``n - ceil(2 similarity / (1 + similarity) n) + l``. Only keys of
   two nodes or more live on, and only nodes with enough live keys, so a passage that unlike texts share makes no candidates of
   them; sets are made for the nodes that are left.
2. Every node is compared with one hub. A block (the nodes of one key) names the node of which the largest share of keys is live, the
   least edited one; a node's hub is the one that most of its blocks name. This joins most families.
3. While large blocks hold several groups, each of their nodes is dealt to a slot of up to 512 nodes of one of its blocks by hash, those of one
   slot meet with their sets, and the links found join groups before the next round. Every round is linear in the nodes. Groups go by
   the names of hubs until then, and only names are joined.
4. What is still apart meets for certain: in small blocks nodes of different groups that share enough keys, in large ones those outside
   the commonest group and all others, dealt to tiles of bounded size on both sides.

Before two sets are intersected, a :class:`Bound` that looks at a small point of each must allow it. Nodes of one group never meet, so
families that are joined cost no more; only nodes that share keys with many and link with none of them are compared with them all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, large, salted_join, sieve, stored, text_slices, told_apart
from loomspan.llm.components import components
from loomspan.llm.shingles import common_shingles, rare_first, shingle_hashes


#: A set has one further key, and must share one more, per so many shingles.
MORE = 20


class Bound(Protocol):
    """What tells, from a small point of each set, that two sets cannot be similar enough."""

    kind: str  # the SQL type of the point's entries

    def point(self, hashes: np.ndarray) -> np.ndarray:
        """The point of a set of hashes."""

    def allows(self, a: Column, a_size: Column, b: Column, b_size: Column) -> Column:
        """Whether two points allow the similarity."""

    def tile(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that two tables of points allow."""


class SetJoin:
    """The steps above over one table of texts; ``rows`` and ``nodes`` hold every row, ``links`` spans the groups of nodes."""

    def __init__(self, source: DataFrame, tmp: Scratch, bound: Bound, shingle: int, similarity: float, every: int = 32, most: int = 1 << 16, slot: int = 512, chunk: int = 512, first: Callable[[DataFrame, Scratch], DataFrame] | None = None):
        """``source``: ``id, h, text``, h a hash of the text. ``chunk``: the side of a tile; blocks of up to a sixteenth of it are small.

        ``first``: pairs ``a, b`` of nodes, of the table of sets, that are compared before all others.
        """
        self.source, self.tmp, self.bound, self.shingle, self.similarity = source, tmp, bound, shingle, similarity
        self.small, self.slot, self.chunk, self.first = max(2, chunk // 16), slot, chunk, first
        self.shared = source.sparkSession.sparkContext.broadcast(common_shingles(source, shingle, every, most))  # at most ``most`` entries
        full, self.nodes = self._rows()
        self.heads = self._live_heads(full)
        self.rows = tmp.keep(full.drop("head"), "narrow")
        tmp.drop(full)
        self.sets = self._sets()
        self.links = self._links()

    def _rows(self) -> tuple[DataFrame, DataFrame]:
        """Per row ``id, h, rid``, its set's hash and size and head; per distinct set its first row and least id."""
        kind, shingle, similarity, shared = self.source.schema["id"].dataType.simpleString(), self.shingle, self.similarity, self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_slices(batches, 2):
                sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                names = np.array([[x >> 64, x & (1 << 64) - 1] for s in sets for x in [xxhash.xxh3_128_intdigest(s.tobytes())]], np.uint64).reshape(-1, 2).view(np.int64)
                heads = [rare_first(s, *shared.value)[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 + len(s) // MORE].view(np.int64) for s in sets]
                columns = [batch.column(0), batch.column(1), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array(heads, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "f1", "f2", "n", "head"])

        rows = self.source.mapInArrow(run, f"id {kind}, h long, f1 long, f2 long, n int, head array<long>")
        rows = self.tmp.keep(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
        order = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
        return rows, self.tmp.keep(rows.groupBy("f1", "f2").agg(F.min("rid").alias("node"), F.min(order).alias("first"), F.count(F.lit(1)).alias("times")), "nodes")

    def _live_heads(self, full: DataFrame) -> DataFrame:
        """``key, node, n, pos, block``, and the node's number of ``keys``, for the keys that two nodes or more have, one of them early enough, of the nodes with enough of them."""
        # Rows that no other row's set equals are nodes; the heads of these do not move.
        told = told_apart(full.filter("n > 0"), F.xxhash64("f1", "f2"), self.nodes.filter("times > 1"), "copied").select("rid", "n", "head", "copied")
        mine = told.filter("copied").join(self.nodes.select(F.col("node").alias("rid")), "rid", "left_semi").unionByName(told.filter("NOT copied"))
        # All keys move once, their rows small, and a key's rows are counted where they lie; a hot key's rows may spill there.
        keyed = mine.select(F.col("rid").alias("node"), "n", F.posexplode("head").alias("pos", "key"))
        keyed = keyed.select("key", "node", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("at"))
        n, pos = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
        early = pos <= n - F.ceil(2 * self.similarity / (1 + self.similarity) * n - 1e-9) + F.floor(n / MORE)
        of_key, of_node = Window.partitionBy("key"), Window.partitionBy("node")
        live = keyed.withColumns({"block": F.count(F.lit(1)).over(of_key), "late": F.min(~early).over(of_key)}).filter("block > 1 AND NOT late")
        first = self.tmp.keep(live.select("key", "node", n.cast("int").alias("n"), pos.cast("int").alias("pos")), "live")
        self.tmp.release()
        # The least that a set of this size shares with another one.
        needed = 1 + F.floor(F.ceil(self.similarity * F.col("n") - 1e-9) / MORE)
        rich = first.withColumn("keys", F.count(F.lit(1)).over(of_node)).filter(F.col("keys") >= needed)
        found = self.tmp.keep(rich.withColumn("block", F.count(F.lit(1)).over(of_key)).filter("block > 1"), "heads")
        self.tmp.drop(first)
        self.tmp.release()
        return found

    def _sets(self) -> DataFrame:
        """``node, hub, is_hub, n, shingles, point`` of the nodes that have a live key, made anew from their texts."""
        shingle, bound = self.shingle, self.bound
        kind = pa.list_(pa.int32() if bound.kind == "int" else pa.int64())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_slices(batches, 3):
                sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                columns = [*batch.columns[:3], pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bound.point(s) for s in sets], kind)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "hub", "is_hub", "n", "shingles", "point"])

        hubs = self.heads.groupBy("key").agg(F.max_by("node", F.struct(F.col("keys") / F.col("n"), "node")).alias("hub"))
        named = self.heads.select("key", "node").join(hubs, "key").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
        named = named.groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))
        self.named = self.tmp.keep(named, "named")
        is_hub = self.named.filter("node <> hub").select(F.col("hub").alias("node")).distinct().withColumn("is_hub", F.lit(True))
        named = self.named.join(is_hub, "node", "left").select(F.col("node").alias("rid"), "hub", F.coalesce("is_hub", F.lit(False)).alias("is_hub"))
        # Both sides by one hash of id and text: rows that are there twice meet in one task, and no set is shuffled to tell them.
        name = lambda h: F.xxhash64(F.struct("id", h)).alias("name")
        asked = self.rows.select("rid", "id", "h").join(named, "rid")
        asked = asked.select(name("h"), F.col("rid").alias("node"), "hub", "is_hub", F.col("id").alias("asked_id"), F.col("h").alias("asked_h"))
        texts = sieve(self.source.select(name("h"), "id", "h", "text"), F.col("name"), asked).join(asked, "name").filter(F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("h") == F.col("asked_h")))
        texts = texts.dropDuplicates(["name", "node"]).select("node", "hub", "is_hub", "text")
        made = texts.mapInArrow(run, f"node long, hub long, is_hub boolean, n int, shingles array<long>, point array<{bound.kind}>")
        found = self.tmp.keep(made, "sets")
        self.tmp.release()
        return found

    def _sets_alike(self) -> Column:
        common = F.size(F.array_intersect("a_shingles", "b_shingles"))
        return common >= F.lit(self.similarity) * (F.col("a_n") + F.col("b_n") - common) - 1e-9

    def _points_allow(self) -> Column:
        return self.bound.allows(F.col("a_point"), F.col("a_n"), F.col("b_point"), F.col("b_n"))

    def _hub_links(self) -> DataFrame:
        """The nodes that are similar to their hubs; points meet first, and only sets of pairs that they allow move."""
        a, b = (self.sets.filter(rows).select(F.col(node).alias(x), *more, *(F.col(c).alias(f"{x}_{c}") for c in ("n", "point"))) for x, node, rows, more in (("a", "node", "node <> hub", [F.col("hub").alias("b")]), ("b", "node", "is_hub", [])))
        return self._verified(a.join(large(b), "b").filter(self._sizes_allow()).filter(self._points_allow()).select("a", "b"))

    def _with_sets(self, pairs: DataFrame, *cols: str) -> DataFrame:
        """``pairs`` with these columns of both sets; where a hub has many partners, Spark's joins split its part."""
        df = pairs
        sets = sieve(self.sets.select("node", *cols), F.xxhash64("node"), pairs.select(F.explode(F.array("a", "b")).alias("node")))  # the others do not move
        for x in "ab":
            df = df.join(large(sets.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in cols))), x)
        return df

    def _verified(self, near: DataFrame) -> DataFrame:
        """Those pairs ``a, b`` of nodes whose sets are similar enough."""
        near = self.tmp.keep(near, "near")
        found = self.tmp.keep(self._with_sets(near, "n", "shingles").filter(self._sets_alike()).select("a", "b"), "found")
        self.tmp.drop(near)
        self.tmp.release()
        return found

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """:meth:`_verified` of the pairs whose points allow it."""
        pairs = self.tmp.keep(pairs, "pairs")
        found = self._verified(self._with_sets(pairs, "n", "point").filter(self._points_allow()).select("a", "b"))
        self.tmp.drop(pairs)
        return found

    def _roots(self, links: DataFrame) -> DataFrame:
        """``node, root`` of the nodes that ``links`` join."""
        return self.tmp.keep(components(links, "a", "b", self.tmp), "roots")

    def _rooted(self, heads: DataFrame, roots: DataFrame) -> DataFrame:
        """``heads`` with each node's group (``root``), in blocks that hold several."""
        heads = heads.select("key", "node", "n", "pos", "block")
        rooted = heads.join(roots.withColumnRenamed("node", "label"), F.col("node") == F.col("label"), "left")
        rooted = rooted.select(*heads.columns, F.coalesce("root", F.col("node")).alias("root"))
        spread = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("held"))
        apart = spread.groupBy("key").agg(F.max_by("root", "held").alias("major"), F.max("held").alias("held"), F.count(F.lit(1)).alias("groups")).filter("groups > 1").drop("groups")
        return self.tmp.keep(rooted.join(self.tmp.keep(apart, "apart"), "key"), "rooted")

    def _links(self) -> DataFrame:
        links = self._hub_links()
        # Hubs name most groups without components; only where a hub has a hub itself are two names those of one group.
        roots, open_names = links.select(F.col("a").alias("node"), F.col("b").alias("root")), links.join(large(links.select(F.col("b").alias("a")).distinct()), "a", "left_semi")
        if self.first is not None:
            roots = self._roots(self._alike(self.first(self.sets, self.tmp)).unionByName(links))
            links, open_names = self._spanning(roots), links.limit(0)
        # Rounds look at large blocks only, and at those only that still hold several groups.
        in_large, turn, before = F.col("block") > self.small, 0, None
        rooted = self._rooted(self.heads.filter(in_large), roots)
        while True:
            # What the last step would compare in large blocks, against what a round costs, and how many groups are still apart there.
            counts = F.coalesce(F.sum(F.when(F.col("root") != F.col("major"), F.col("block"))), F.lit(0)), F.count(F.lit(1)), F.count_distinct("root")
            work, held, groups = rooted.agg(*counts).first()
            if work <= self.chunk * held / (1 if turn else 8) or (before is not None and groups > 0.9 * before):
                break
            before, turn = groups, turn + 1
            roots = self._renamed(roots, self._roots(open_names.unionByName(self._slot_links(rooted, turn))))
            links, open_names = self._spanning(roots), links.limit(0)
            rooted = self._rooted(rooted, roots)
        last = self._small_pairs(self.heads.filter(~in_large), roots, rooted)
        if work:
            last = last.unionByName(self._tile_pairs(rooted))
        return links.unionByName(self._alike(last.distinct()))

    def _renamed(self, roots: DataFrame, names: DataFrame) -> DataFrame:
        """``roots`` after their names, themselves nodes, were joined to groups (``node, root`` of ``names``)."""
        told = roots.join(large(names.select(F.col("node").alias("root"), F.col("root").alias("new"))), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
        return self.tmp.keep(told.unionByName(names).groupBy("node").agg(F.min("root").alias("root")), "renamed")

    def _spanning(self, roots: DataFrame) -> DataFrame:
        """One link ``a, b`` of each node to its root."""
        return roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))

    def _slot_links(self, rooted: DataFrame, turn: int) -> DataFrame:
        """Links between groups that the nodes of one slot span; a node takes part in the least of its blocks by hash, which nodes of many common keys share."""
        bound, similarity = self.bound, self.similarity
        order = F.struct(F.xxhash64("key", F.lit(turn)).alias("order"), "key")
        picked = rooted.groupBy("node", "root", "n").agg(F.min(order).getField("key").alias("key"))
        sizes = picked.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / self.slot, F.sum("n") / (self.slot << 12))).alias("slots"))
        dealt = salted_join(picked, sizes, ["key"], "node").select("node", "root", "key", F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.col("slots")).alias("slot_no"))
        dealt = self.tmp.keep(dealt, "slots")
        met = dealt.join(large(sieve(self.sets, F.xxhash64("node"), dealt).select("node", "n", "shingles", "point")), "node")

        def run(slot: pa.Table) -> pa.Table:
            group, n = (slot.column(c).to_numpy().copy() for c in ("root", "n"))
            names, at = np.unique(group, return_index=True)
            if len(names) > 1:
                points = np.stack(slot.column("point").to_numpy(zero_copy_only=False))
                sets = slot.column("shingles").to_numpy(zero_copy_only=False)
                i, j = bound.tile(points, n, points, n)
                fits = (i < j) & (group[i] != group[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[fits], j[fits]
                shingles, places = np.unique(np.concatenate(sets), return_inverse=True)
                places, has = np.split(places, np.cumsum(n)[:-1]), np.zeros(len(shingles), bool)
                for a in np.unique(i):
                    has[places[a]] = True
                    for b in j[i == a]:
                        if group[a] == group[b]:
                            continue
                        common = np.count_nonzero(has[places[b]])
                        if common >= similarity * (n[a] + n[b] - common) - 1e-9:
                            group[group == group[b]] = group[a]
                    has[places[a]] = False
            first = dict(zip(group[at][::-1].tolist(), names[::-1].tolist(), strict=True))  # the least name of each group
            links = [(x, first[g]) for x, g in zip(names.tolist(), group[at].tolist(), strict=True) if x != first[g]]
            return pa.table({x: pa.array([link[k] for link in links], pa.int64()) for k, x in enumerate("ab")})

        found = self.tmp.keep(met.groupBy("key", "slot_no").applyInArrow(run, "a long, b long"), "found")
        self.tmp.drop(dealt)
        self.tmp.release()
        return found

    def _sizes_allow(self) -> Column:
        return F.least("a_n", "b_n") >= F.lit(self.similarity) * F.greatest("a_n", "b_n") - 1e-9

    def _small_pairs(self, heads: DataFrame, roots: DataFrame, rooted: DataFrame) -> DataFrame:
        """In small blocks, nodes of different groups that share as many keys as they must, less those that may be keys of large blocks (``rooted``)."""
        many = rooted.groupBy("node").agg(F.count(F.lit(1)).alias("large"))
        told = heads.select("key", "node", "n", "pos").join(large(roots), "node", "left").join(large(many), "node", "left")
        small = self.tmp.keep(told.withColumns({"root": F.coalesce("root", "node"), "large": F.coalesce("large", F.lit(0))}), "small")
        left, right = (small.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("root", "n", "pos", "large")), F.col("node").alias(x)) for x in "ab")
        met = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & self._sizes_allow())
        needed = 1 + F.floor(F.least("a_n", "b_n") / MORE)
        # Among the first shingles that two sets share, both have enough shingles left.
        left_over = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) + needed - 1
        met = met.filter(left_over + 1e-6 >= F.lit(self.similarity / (1 + self.similarity)) * (F.col("a_n") + F.col("b_n")))
        shared = met.groupBy("a", "b", "a_n", "b_n", "a_large", "b_large").agg(F.count(F.lit(1)).alias("shared"))
        return shared.filter(F.col("shared") + F.least("a_large", "b_large") >= needed).select("a", "b")

    def _tile_pairs(self, rooted: DataFrame) -> DataFrame:
        """In large blocks the nodes outside the commonest group and all others, tile by tile."""
        bound, similarity = self.bound, self.similarity
        outsiders, everyone = (F.greatest(F.lit(1), F.ceil(x / self.chunk)).cast("int") for x in (F.col("block") - F.col("held"), F.col("block")))
        pointed = self.tmp.keep(rooted.withColumns({"rows_of": outsiders, "cols_of": everyone}).join(self.sets.select("node", "point"), "node"), "pointed")
        own = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
        each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        cols = ["key", "node", "root", "n", "pos", "major", "point"]
        left = pointed.filter("root <> major").select(*cols, own("rows_of").alias("i"), each("cols_of").alias("j"))
        right = pointed.select(*cols, each("rows_of").alias("i"), own("cols_of").alias("j"))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            (a, a_root, a_n), (b, b_root, b_n) = ([t.column(c).to_numpy() for c in ("node", "root", "n")] for t in (left, right))
            if not len(a) or not len(b):
                return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            x, y = (np.stack(t.column("point").to_numpy(zero_copy_only=False)) for t in (left, right))
            i, j = bound.tile(x, a_n, y, b_n)
            small, large = np.minimum(a_n[i], b_n[j]), np.maximum(a_n[i], b_n[j])
            once = (b_root[j] == right.column("major")[0].as_py()) | (a[i] < b[j])
            fits = (a_root[i] != b_root[j]) & once & (small >= similarity * large - 1e-9)
            return pa.table({"a": np.minimum(a[i], b[j])[fits], "b": np.maximum(a[i], b[j])[fits]})

        key = ["key", "i", "j"]
        left, right = (t.toDF(*t.columns) for t in (left, right))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "a long, b long").distinct()

    def grouped(self) -> DataFrame:
        """Every row: ``id, h, n``, and its group's first row ``first_id, first_h`` (a null id counts last)."""
        roots = self.tmp.keep(components(self.links, "a", "b", self.tmp), "roots").select(F.col("node").alias("label"), "root")
        rooted = self.tmp.keep(self.nodes.join(roots, F.col("node") == F.col("label")).select("node", "root", "first"), "rooted")
        least = rooted.groupBy("root").agg(F.min("first").alias("best"))
        named = salted_join(rooted, least, ["root"], "node").select(F.col("node").alias("label"), "best")
        labels = self.nodes.join(named, F.col("node") == F.col("label"), "left").select("f1", "f2", F.coalesce("best", "first").alias("best"))
        labels = self.tmp.keep(labels, "labels")
        copies = self.rows.select("id", "h", "n", "f1", "f2").join(labels, ["f1", "f2"])
        return copies.select("id", "h", "n", F.col("best.id").alias("first_id"), F.col("best.h").alias("first_h"))


def set_groups(docs: DataFrame, id_col: str, text_col: str, name: str, bound: Bound, shingle: int, similarity: float, finish: Callable[[DataFrame], DataFrame] = lambda df: df, **settings) -> DataFrame:
    """:meth:`SetJoin.grouped` of a table of texts, written to the shared folder."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    with Scratch(docs.sparkSession, name) as tmp:
        return stored(finish(SetJoin(source, tmp, bound, shingle, similarity, **settings).grouped()), f"{name}-groups")
