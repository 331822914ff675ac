"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of 0.8 or more, by a count-vector R-tree.

The shingles of a document are hashed into groups; how many fall into each is its point. Two documents share in a group no more
shingles than the lesser of their counts, so their intersection is at most the sum of the coordinate minima; for a box of points the
upper corner gives the same bound. :class:`CountVectors` packs points to a tree (by size, then by the coordinates that vary most)
and goes down where the bound still allows the similarity; pairs that survive are verified by the sets themselves.

One tree over all documents cannot prune here: counts of random shingles lie so close together that at 0.8, where a fifth of the
shingles may differ, nearly every box of a large table is within reach of every point, whatever the packing. So trees are built over the blocks
of :mod:`loomspan.llm.set_join`: documents that share one of their first shingles, in which every link lies. A block of a few
documents is a leaf, whose points all meet; a large one is dealt to tiles, each with its tree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.set_join import set_groups


class CountVectors:
    """A :class:`~loomspan.llm.set_join.Bound`: counts of shingles by hash group, in a packed R-tree.

    The more ``groups`` (256), the sharper: sets of 400 shingles at a similarity of 0.64 differ by some 140 in the sum of 256
    counts, and by some 85 in that of 64, where 0.8 allows 90.
    """

    kind = "int"

    def __init__(self, similarity: float, groups: int = 256, leaf: int = 16, fan: int = 4):
        self.share = similarity / (1 + similarity)  # of the sum of two sizes that must be common
        self.similarity, self.groups, self.leaf, self.fan = similarity, groups, leaf, fan

    def point(self, hashes: np.ndarray) -> np.ndarray:
        return np.bincount((hashes % np.uint64(self.groups)).astype(np.int64), minlength=self.groups).astype(np.int32)

    def allows(self, a: Column, a_size: Column, b: Column, b_size: Column) -> Column:
        most = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda n, x: n + x)
        return most >= F.lit(self.share) * (a_size + b_size) - 1e-9

    def packed(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """An order of the points, and from the leaves up the boxes over equal runs of it: upper corner, least and greatest size."""
        order = np.argsort(sizes, kind="stable")
        slab = self.leaf * max(1, int(np.sqrt(len(points) / self.leaf)))
        for first in range(0, len(order), slab):
            part = order[first : first + slab]
            axis = int(np.argmax(points[part].var(0)))
            order[first : first + slab] = part[np.argsort(points[part, axis], kind="stable")]
        levels, high, least, most = [], points[order], sizes[order], sizes[order]
        run = self.leaf
        while True:
            at = np.arange(0, len(high), run)
            high, least, most = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            levels.append((high, least, most))
            if len(high) <= self.fan:
                return order, levels
            run = self.fan

    def _within(self, a: np.ndarray, a_size: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
        """Which of the pairs of a point i and a box j the bound allows."""
        fits = (least[j] <= a_size[i] / self.similarity + 1e-9) & (most[j] >= self.similarity * a_size[i] - 1e-9)
        for first in range(0, len(i), chunk):
            part = np.flatnonzero(fits[first : first + chunk]) + first
            common = np.minimum(a[i[part]], high[j[part]]).sum(1, dtype=np.int64)
            fits[part] = common >= self.share * (a_size[i[part]] + least[j[part]]) - 1e-9
        return fits

    def tile(self, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, levels = self.packed(b, b_size)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(levels[-1][0])), indexing="ij"))
        for depth in range(len(levels) - 1, -1, -1):
            fits = self._within(a, a_size, *levels[depth], i, j)
            i, j = i[fits], j[fits]
            below, run = (len(levels[depth - 1][0]), self.fan) if depth else (len(b), self.leaf)
            i, j = np.repeat(i, run), (j[:, None] * run + np.arange(run)).ravel()
            there = j < below
            i, j = i[there], j[there]
        j = order[j]
        fits = self._within(a, a_size, b, b_size, b_size, i, j)
        return i[fits], j[fits]


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, groups: int = 256, **settings) -> DataFrame:
    """One row per input row: ``id, n_shingles, component_id``, the smallest id that links of ``similarity`` or more lead to.

    Sets are of distinct shingles of ``shingle`` words, ASCII letters lower-cased, told apart by 64-bit hashes; a text of fewer words is one
    shingle. A text without words, or a null one, has an empty set and is linked with nothing, not even another such text. Pairs
    are made only as far as groups need them, so no number of links is told. Repeated rows, and different texts of equal sets, share a
    group. A null id counts last: a group of null ids only has a null ``component_id``. A very long text costs its length; an
    empty table gives no rows; other columns are not read, whatever their names. ``settings`` are those of
    :class:`~loomspan.llm.set_join.SetJoin`; they change the work, not the result.
    """

    def finish(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("first_id")).alias("component_id"))

    return set_groups(docs, id_col, text_col, "ngram", CountVectors(similarity, groups), shingle, similarity, finish, **settings)
