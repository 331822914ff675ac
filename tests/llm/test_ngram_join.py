"""The n-gram Jaccard join against all pairs, its tree against plain bounds, and how its candidates grow in families."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import set_join, simhash
from loomspan.llm.common import Scratch, sieve, told_apart
from loomspan.llm.components import components
from loomspan.llm.ngram_join import CountVectors, jaccard_classes
from tests.llm.test_operators import WORDS, edited, empty, frame, odd_rows, prose, similar_components


def word_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("settings", [{}, {"chunk": 8, "every": 1}])
def test_classes_against_all_pairs(spark, settings):
    rnd = random.Random(11)
    texts = [prose(rnd, rnd.choice([6, 9, 40, 150, 700])) for _ in range(30)]
    texts += [edited(rnd, rnd.choice(texts), rnd.choice([0.0, 0.005, 0.01, 0.03, 0.08])) for _ in range(140)] + ["a b c", "A b  c", "a b"]
    passage = prose(rnd, 60)
    texts += [f"{prose(rnd, 90)} {passage}" for _ in range(50)]
    rows = list(enumerate(texts))
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_classes(frame(spark, [(*r, None, None, None) for r in rows]), **settings).collect()}
    want = similar_components(rows, 0.8)
    assert got == {i: (len(word_set(t)), want[i]) for i, t in rows}


def test_defined_cases(spark):
    rows = odd_rows()
    got = [tuple(r) for r in jaccard_classes(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    named = {i: c for i, _, c in got if i is not None}
    assert named == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 7, 8: 1}  # texts without words are linked with nothing
    assert sorted(str(c) for i, _, c in got if i is None) == ["1", "None"]
    assert {n for i, n, _ in got if i in (2, 3, 4)} == {0}
    assert jaccard_classes(empty(spark)).count() == 0


def test_points_trees_and_bounds(spark):
    rng = np.random.default_rng(2)
    bound = CountVectors(0.8, groups=16, leaf=4, fan=3)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 60), dtype=np.uint64)) for _ in range(25)]
    sets += [np.unique(np.concatenate([s[rng.integers(0, len(s), max(1, len(s) - k))], s[k:]])) for s in sets for k in (1, 2, 4, 8)]
    points, sizes = np.stack([bound.point(s) for s in sets]), np.array([len(s) for s in sets])
    i, j = bound.tile(points, sizes, points, sizes)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    common = np.minimum(points[:, None], points[None]).sum(2)
    sums = sizes[:, None] + sizes[None]
    fits = (common >= 0.8 / 1.8 * sums - 1e-9) & (np.minimum(sizes[:, None], sizes[None]) >= 0.8 * np.maximum(sizes[:, None], sizes[None]) - 1e-9)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(fits)), strict=True)) and len(found) < len(sets) ** 2 / 2
    for a in range(0, len(sets), 7):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert both < 0.8 * (sizes[a] + sizes[b] - both) or (a, b) in found
    df = spark.createDataFrame([(p.tolist(), int(n), q.tolist(), int(m)) for p, n, q, m in zip(points[:30], sizes[:30], points[5:35], sizes[5:35], strict=True)], "a array<int>, an int, b array<int>, bn int")
    told = [r[0] for r in df.select(bound.allows(F.col("a"), F.col("an"), F.col("b"), F.col("bn"))).collect()]
    assert told == [bool(common[k, k + 5] >= 0.8 / 1.8 * (sizes[k] + sizes[k + 5]) - 1e-9) for k in range(30)]


@pytest.mark.parametrize("join", [simhash.similar_groups])
def test_candidates_of_a_family_grow_with_its_rows(spark, monkeypatch, join):
    """Texts of 34 paragraphs out of a pool of 40: some 0.64 alike, so most share keys and few link."""
    rnd, seen = random.Random(31), []
    pool = [" ".join(rnd.choice(WORDS) + str(rnd.randrange(10**6)) for _ in range(12)) for _ in range(40)]
    plain = set_join.SetJoin._alike

    def counted(self, pairs):
        pairs = self.tmp.keep(pairs, "counted")
        seen[-1] += pairs.count()
        return plain(self, pairs)

    monkeypatch.setattr(set_join.SetJoin, "_alike", counted)
    for n in (120, 480):
        texts = ["\n".join(pool[k] for k in sorted(rnd.sample(range(40), 34))) for _ in range(n)]
        rows = list(enumerate(texts))
        seen.append(0)
        got = {r.id: r.component_id for r in join(frame(spark, [(*r, None, None, None) for r in rows])).collect()}
        if n == 120:
            assert got == similar_components(rows, 0.8)
    assert seen[1] < 6 * seen[0] and seen[1] < 480 * 480 / 12, seen


def test_few_rows_pass_that_are_not_asked_for(spark):
    df = spark.range(20000).withColumn("text", F.concat(F.lit("t"), "id"))
    asked = spark.range(0, 20000, 50)
    key = F.xxhash64("id")
    kept = {r.id for r in sieve(df, key, asked).collect()}
    assert kept >= set(range(0, 20000, 50)) and len(kept) < 500
    full = {r.id for r in told_apart(df, key, asked, "maybe", bits=7).filter("maybe").collect()}  # more keys than places
    assert full >= set(range(0, 20000, 50)) and len(full) > 10000
    assert told_apart(df, key, asked.limit(0), "maybe").filter("maybe").count() == 0


def test_keys_move_once_and_sets_after_points(spark, monkeypatch):
    """Texts that are windows over one text, each like the next few only, in blocks of 50."""
    written, plain = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: written.append(name) or plain(self, df, name))
    words = [f"w{i}" for i in range(1000)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 200]), None, None, None) for k in range(200)] + [(500, " ".join(words[:90]), None, None, None)]
    got = {r.id: r.component_id for r in jaccard_classes(frame(spark, rows), chunk=8).collect()}
    assert got == {k: 0 for k in range(200)} | {500: 500}
    # The first keep of live keys is of the rows that have them, and none joins all keys again; sets of a pair move after its points.
    assert written.index("live") < written.index("heads") < written.index("near") < written.index("found")
    assert "rich" not in written and written.count("live") == 1


def test_stars_are_components_at_once(spark, monkeypatch):
    written, plain = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: written.append(name) or plain(self, df, name))
    with Scratch(spark, "test") as tmp:
        stars = spark.createDataFrame([(1, 5), (7, 1), (1, 9), (3, 4)], "a long, b long")
        found = {(r.node, r.root) for r in components(stars, "a", "b", tmp).collect()}
        assert found == {(1, 1), (5, 1), (7, 1), (9, 1), (3, 3), (4, 3)} and len(written) == 1
        chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (50, 61)], "a long, b long")
        found = {(r.node, r.root) for r in components(chain, "a", "b", tmp).collect()}
        assert found == {(i, 0) for i in range(41)} | {(i, 50) for i in (50, 60, 61)}
