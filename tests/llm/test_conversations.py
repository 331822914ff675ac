"""Conversation repair against a plain programme over all rows, and source divergence against plain sums."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import conversation_repair as cr
from loomspan.llm import divergence as dv

SPACES = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """Cheapest (cost, audit) by the least pair for every state after every row; rows of (initial, must go, cut)."""
    far = (10**9, "")
    ways = {"": (0, "")}

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit) in list(ways.items()):
                to = "a" if state == "u" else "u"
                ways[to] = min(ways.get(to, far), (cost + 2, audit + "I"))
        return ways

    for initial, must, cut in rows:
        now: dict = {}
        for state, (cost, audit) in inserted(ways).items():
            to = "a" if state == "u" else "u"
            options = [(state, 3, "D")]
            if not must:
                options.append((to, 2 + cut, "R"))
                if initial == to or (initial == "s" and state == ""):
                    options.append((initial, cut, "K"))
            for end, more, edit in options:
                now[end] = min(now.get(end, far), (cost + more, audit + edit))
        ways = now
    ways = inserted(ways)
    return min(ways.get("", far), ways.get("a", far))


def plain_report(rows):
    """rows: turn, role, text in order."""
    seen, kinds, out = set(), [], Counter()
    for turn, role, text in rows:
        bare = text.rstrip(SPACES)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        out[kind] += 1
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = plain_edits([(r[1][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(rows, kinds, strict=True)])
    made, at = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(at)
        if edit == "K":
            made.append((row[1], row[2]))
        elif edit != "D":
            made.append(("assistant" if made and made[-1][0][:1] == "u" else "user", row[2] if row else ""))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, out["blank"], out["duplicate"], out["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def random_rows(rnd):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    texts = ["Yes.", "No", "", " \n", "Why?", "So it is!", "a b c", "Ünï. "]
    return [(rnd.choice([None, *range(12)]), rnd.choice(roles), rnd.choice(texts) * rnd.choice([1, 1, 2])) for _ in range(rnd.choice([0, 1, 2, 5, 9, 20]))]


def test_runs_give_the_same_edits_as_rows():
    powers = cr.Powers()
    for symbols in product([("s", 0), ("u", 0), ("a", cr.TRUNCATED), ("", cr.BLANK), ("", 0)], repeat=4):
        for lengths in [(1, 1, 1, 1), (3, 1, 2, 5)]:
            runs = list(zip(symbols, lengths, strict=True))
            rows = [(i, f in (1, 2), int(f == 3)) for (i, f), n in runs for _ in range(n)]
            assert cr.cheapest_edits(runs, powers) == plain_edits(rows)


def test_a_very_long_run_is_unrolled():
    cost, audit = cr.cheapest_edits([(("u", 0), 200_001)], cr.Powers())
    assert cost == 200_002 and audit.count("K") + audit.count("R") + audit.count("D") == 200_001


def test_repair_against_rows(spark):
    rnd = random.Random(5)
    convs = {i: random_rows(rnd) for i in range(60)} | {None: random_rows(rnd)}
    table = [(i, *r, 1) for i, rows in convs.items() for r in rows] + [(i, None, "user", "gone", 0) for i in convs]
    df = spark.createDataFrame(table, "conv long, turn long, role string, text string, times int").repartition(5)
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in cr.repair_report(df).collect()}
    assert got == {i: plain_report(in_order(rows)) for i, rows in convs.items()}


def test_repaired_rows_nulls_and_clashing_names(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, None, None), (1, 2, "assistant", "Well, hi."), (None, None, "assistant", "Odd"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("clash") for c in ("conv", "times", "digest", "head", "cost", "audit", "key", "name")})
    got = sorted(((r.conv is None, r.conv, r.place, r.role, r.text) for r in cr.repair(df).collect()), key=str)
    assert got == [(False, 1, 0, "user", "Hello."), (False, 1, 1, "assistant", "Well, hi.")]
    counted = cr.conversation_rows(df, "conv_id", "turn", "role", "text")
    assert {r.conv: (r.blank, r.audit) for r in cr.repair_report(counted).collect()} == {1: (1, "KDK"), 2: (1, "D"), None: (0, "D")}
    assert cr.repair(df.limit(0)).count() == cr.repair_report(counted.limit(0)).count() == 0


def test_damage(spark):
    df = cr.damaged(spark.createDataFrame([(i, i % 7, "assistant", "Yes. No! Why?", 1) for i in range(400)], "conv long, turn long, role string, text string, times int"))
    seen = Counter((r.role, r.text, r.times) for r in df.collect())
    assert set(seen) == {("assistant", "Yes. No! Why?", 1), ("assistant", "Yes. No! Why?", 0), ("assistant", "", 1), ("assistant", "Yes No Why", 1), ("assistant", "Yes. No! Why?", 2), ("user", "Yes. No! Why?", 1)}


# source divergence


def plain_divergence(docs, least, ranks):
    docs = [tuple(x or "" for x in d) for d in docs]
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    out = []
    for lang in {d[1] for d in docs}:
        mine = [(s, words(t)) for t, g, s in docs if g == lang]
        spread = Counter(w for _, ws in mine for w in set(ws))
        kept = {w for w, n in spread.items() if n >= least}
        counts = {s: Counter() for s, _ in mine}
        for s, ws in mine:
            counts[s].update(w for w in ws if w in kept)
        p = lambda c, w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        whole = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(b, sum(gap(p(c, w), p(counts[b], w)) for w in kept)) for b in counts if b != s]
            terms = [(w, gap(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, x, v, k) for k, (x, v) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"index_rows": (3, 3), "block": 2, "ranks": 2}])
def test_divergence_against_plain_sums(spark, settings):
    rnd = random.Random(3)
    pool = ["Ab", "cd", "ünï", "漢字", "e1f", "x-y", "Zeta", "éa", "the", "THE", "q"]
    docs = [(" ".join(rnd.choices(pool, k=rnd.choice([0, 3, 30]))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "s3", "s4", None])) for _ in range(120)]
    docs += [(None, "en", "s9"), ("", "xx", "s1"), ("a b c", "xx", "s2"), ("word " * 5000, "en", "s1"), docs[0], docs[0]]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "first", "part", "value")})
    got = sorted(tuple(r) for r in dv.divergence(df, **settings).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(docs, 10, settings.get("ranks", 10))


def test_divergence_of_nothing_and_of_too_few_documents(spark):
    df = spark.createDataFrame([("a b", "en", "x"), ("b c", "en", "y")], "text string, lang string, source string")
    assert sorted(tuple(r) for r in dv.divergence(df).select("source", "item", "value", "rank").collect()) == [("x", "y", 0, 1), ("y", "x", 0, 1)]
    assert dv.divergence(df.limit(0)).count() == 0


def test_row_accumulation_in_small_chunks_and_exact_smoothing():
    rng = np.random.default_rng(1)
    cells = {(int(t), int(s)): int(rng.integers(2, 1000)) for t, s in rng.integers(0, 9, (40, 2))}
    keys = sorted(cells)
    terms, sources, p = (np.array(x, np.int64) for x in (*zip(*keys, strict=True), [cells[k] for k in keys]))
    zero = np.arange(1, 10, dtype=np.int64)
    for row, sums in dv.row_accumulation(terms, sources, p, zero, 9, np.arange(9), chunk=4):
        for peer in range(9):
            want = sum((a - b) ** 2 // (a + b) for t in range(9) for a, b in [(cells.get((t, row), row + 1), cells.get((t, peer), peer + 1))])
            assert sums[peer] == want
    counts, total = np.array([0, 10**14, 123456789012345], np.int64), 10**15 + 7
    assert dv.smoothed(counts, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 2) // total for c in counts]
    with pytest.raises(ValueError, match="words"):
        dv.smoothed(counts, np.int64(1 << 60))
    assert sum(dv.term_lists("Ab 1 cD, é", most=2), []) == [b"ab", b"cd", "é".encode()]
