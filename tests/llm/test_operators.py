"""Dealt operators against brute force and libraries, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import re
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from loomspan.llm import bpe, exact_dedup, language_id, line_dedup, mixing, pii, repetition, simhash, token_counts, token_files
from loomspan.llm.common import Scratch, fresh_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under moonlit towers".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ed", ","]) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows."""
    rnd = random.Random(7)
    long = prose(rnd, 6000)
    text = prose(rnd, 80)
    return [
        (1, text, "en", "a", 5), (2, None, None, None, None), (None, text, "en", "a", 1), (3, "", "de", "b", 0), (4, " \t\n ", "de", None, 3), (5, long, "en", "a", 9),
        (6, text, "en", "b", 5), (6, text, "en", "b", 5), (7, "é ñ 漢字 \U0001f642 x", None, "c", 2), (8, text + " more", "en", "c", 4), (None, None, None, None, None),
    ]


def frame(spark, rows):
    """With columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("id", "fp", "size", "target", "digest", "ids", "h", "shard", "x", "site")})


def empty(spark):
    return frame(spark, []).limit(0)


# exact dedup


def dedup_files(spark, df, **settings):
    path = fresh_dir(spark, "test-docs")
    df.repartition(3).write.parquet(path)
    return exact_dedup.exact_dedup(spark, path, **settings)


@pytest.mark.parametrize("files", [None, 1])
def test_exact_dedup_groups_and_keeps(spark, files):
    rows = odd_rows()
    got = [(r.id, r.keep_id, r.group_size, r.kept, r.digest) for r in dedup_files(spark, frame(spark, rows), max_files_per_trigger=files).collect()]
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups: dict[str, list] = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    assert len(got) == len(rows)
    for key, members in groups.items():
        digest = hashlib.sha256(key.encode()).hexdigest()
        mine = [g for g in got if g[4] == digest]
        assert len(mine) == len(members) and {g[2] for g in mine} == {len(members)}
        assert {g[1] for g in mine} == {min(members)[3]}
        assert sum(g[3] for g in mine) == 1 and next(g for g in mine if g[3])[0] == min(members)[3]


def test_exact_dedup_decides_on_bytes(spark):
    """A digest that collides all the time changes nothing but the digest."""
    got = dedup_files(spark, frame(spark, odd_rows()), digest=lambda n: F.substring(F.sha2(n, 256), 1, 0)).select("id", "keep_id", "group_size", "kept").collect()
    want = dedup_files(spark, frame(spark, odd_rows())).select("id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_dedup_resumes_with_new_files(spark):
    """A second call with the same folder takes up the new file: the newest state of each group, over all rows."""
    path, work = fresh_dir(spark, "test-docs"), fresh_dir(spark, "test-work")
    first = [(1, "a b"), (2, "c")]
    spark.createDataFrame([(*r, None, None, None) for r in first], SCHEMA).coalesce(1).write.parquet(path)
    one = exact_dedup.exact_dedup(spark, path, work_dir=work)
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in one.collect()) == [(1, 1, 1, True), (2, 2, 1, True)]
    spark.createDataFrame([(3, "a  b", None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    two = exact_dedup.exact_dedup(spark, path, work_dir=work, max_bytes_per_trigger=1)
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in two.collect()) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True)]


def test_exact_dedup_empty(spark):
    assert dedup_files(spark, empty(spark)).count() == 0


# SimHash


def brute_components(rows, distance=4, shingle=4):
    fps = [simhash.fingerprint(t or "", shingle)[0] for _, t, *_ in rows]
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                label[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], fps[i], least.get(find(i))) for i, r in enumerate(rows)]


def near_rows(n=120):
    rnd, rows = random.Random(3), odd_rows()
    base = [prose(rnd, 150) for _ in range(4)]
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words), "en", "s", 0))
    return rows


@pytest.mark.parametrize("bucket,chunk", [(16, 1024), (2, 8)])
def test_simhash_components(spark, bucket, chunk):
    rows = near_rows()
    got = simhash.near_duplicates(frame(spark, rows), bucket=bucket, chunk=chunk).collect()
    want = brute_components(rows)
    assert sorted(str((r.id, r.fp % (1 << 64), r.component_id)) for r in got) == sorted(map(str, want))


def test_simhash_fingerprint_bits():
    import xxhash

    words = "A b c D e f".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint("A b\tc D\ne f") == [want] and simhash.fingerprint(" \n") == [0]


def test_simhash_representatives(spark):
    rows = near_rows()
    kept = [r.doc_id for r in simhash.representatives(frame(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, {c for _, _, c in brute_components(rows)}))
    assert simhash.representatives(frame(spark, rows)).columns == frame(spark, []).columns
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.representatives(empty(spark)).count() == 0


def similar_components(rows, similarity):
    """Smallest id that chains of pairs of this shingle similarity reach, for rows (id, text), by comparing all pairs."""

    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least: dict = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(i, least.get(r, i))
    return {i: least[r] for (i, _), r in zip(rows, root, strict=True)}


def edited(rnd, text, share):
    """A copy with this share of its words replaced."""
    return " ".join(rnd.choice(WORDS) + "x" if rnd.random() < share else w for w in text.split())


@pytest.mark.parametrize("settings", [{}, {"chunk": 8}])
def test_similar_groups_against_all_pairs(spark, settings):
    """All pairs of 0.8 and more are linked and no others, whatever the size of the buckets."""
    rnd = random.Random(23)
    texts = [prose(rnd, rnd.choice([6, 40, 150, 700])) for _ in range(30)]
    texts += [edited(rnd, rnd.choice(texts), rnd.choice([0.0, 0.005, 0.01, 0.08, 0.2])) for _ in range(150)] + ["a b c", "A b  c", "", None, " \n", "a b"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows), **settings).collect()}
    assert got == similar_components([r[:2] for r in rows], 0.8)


@pytest.mark.parametrize("settings", [{}, {"chunk": 8, "every": 1}])
def test_similar_groups_large_families_by_sets(spark, settings):
    """Families of more than 16 near copies about the limit, and a passage that all rows share: right at every bucket size."""
    rnd = random.Random(41)
    bases, passage = [prose(rnd, 120) for _ in range(4)], prose(rnd, 60)
    texts = [edited(rnd, base, share) for base in bases for share in (0.015, 0.02, 0.025) for _ in range(15)]
    texts += [f"{prose(rnd, 90)} {passage}" for _ in range(60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows), **settings).collect()}
    assert got == similar_components([r[:2] for r in rows], 0.8)


def test_similar_groups_recall_at_the_limit(spark):
    """Each of 400 pairs of a similarity of 0.80 to 0.82 is found, short sets and long ones; those of 0.78 to 0.8 are not."""
    rnd, texts, near = random.Random(47), [], {}
    while len(near) < 400:
        n = rnd.choice([14, 30, 60, 150, 400])
        one = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
        two = list(one)
        for at in range(rnd.randrange(3, 10), n - 5, rnd.randrange(40, 56)) if n > 60 else [n - 1 - rnd.randrange(2)]:
            two[at] = f"v{rnd.randrange(10**9)}"
        a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (one, two))
        likeness = len(a & b) / len(a | b)
        if 0.78 <= likeness <= 0.82:
            near[len(texts)] = likeness >= 0.8
            texts += [" ".join(one), " ".join(two)]
    got = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert {i: got[i + 1] == i for i in near} == near and 50 < sum(near.values()) < 350


def test_similar_groups_short_texts(spark):
    """Pairs of short texts of similarity 0.8 or a little more share no sample; all meet."""
    rnd, texts = random.Random(43), []
    for n in (9, 10, 11, 12, 14, 18, 23, 28):
        for _ in range(15):
            words = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, *(f"v{rnd.randrange(10**9)}" for _ in range((n - 4) // 4))])]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()}
    want = similar_components([r[:2] for r in rows], 0.8)
    assert got == want and sum(want[i] != i for i in want) == 120


@pytest.mark.parametrize("settings", [{"similarity": 0.8}, {}])
def test_representatives_tell_rows_of_one_id_apart(spark, settings):
    """Repeated and null ids: one row of each group stays, whatever its id."""
    rnd = random.Random(29)
    a, b, c = (prose(rnd, 200) for _ in range(3))
    rows = [(1, a), (1, b), (None, a + " end"), (None, b), (None, c), (None, c), (None, c + " end"), (2, None), (2, ""), (1, a)]
    kept = simhash.representatives(frame(spark, [(*r, "en", "s", i) for i, r in enumerate(rows)]), **settings).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept if r.doc_id) == sorted([(1, a), (1, b), (2, "")])
    assert [r.text for r in kept if r.doc_id is None] in ([c], [c + " end"])
    texts = [prose(rnd, 100) for _ in range(3)]
    lost = simhash.representatives(frame(spark, [(None, t, None, None, None) for t in texts]), **settings)
    assert sorted(r.text for r in lost.collect()) == sorted(texts)


def test_similar_groups_defined_cases(spark):
    rows = odd_rows()
    got = simhash.similar_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    named = {r.id: r.component_id for r in got if r.id is not None}
    assert named[2] == named[3] == named[4] == 2 and named[1] == named[6] == named[8] == 1 and named[5] == 5 and named[7] == 7
    assert sorted(str(r.component_id) for r in got if r.id is None) == ["1", "2"]
    kept = simhash.representatives(frame(spark, rows), similarity=0.8).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 5, 7]
    assert simhash.similar_groups(empty(spark)).count() == 0 and simhash.representatives(empty(spark), similarity=0.8).count() == 0


# mixing


def test_mix_follows_targets(spark):
    rnd = random.Random(5)
    rows = odd_rows() + [(100 + i, prose(rnd, rnd.randrange(1, 300)), "en", rnd.choice("aaabbcdef"), 0) for i in range(500)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    by: dict = {}
    for r in got:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.size
        s[1] += r.taken
    assert all(s[0] == s[3] and abs(s[1] - s[2]) <= 64 + s[0] * 0.01 for s in by.values())
    assert abs(sum(s[2] for s in by.values()) - 1.5 * sum(s[0] for s in by.values())) < 1e-6
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_are_what_was_taken(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, rnd.randrange(0, 200)), "en", rnd.choice("abc"), 0) for i in range(200)] + [(1, None, None, None, 0), (2, "", "en", "a", 0)]
    plan: dict = {}
    for r in mixing.mix(frame(spark, rows)).collect():
        plan[r.id, r.source] = plan.get((r.id, r.source), 0) + r.taken
    out = mixing.mixed_documents(frame(spark, rows))
    assert out.columns == frame(spark, []).columns
    words: dict = {}
    for r in out.collect():
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + len(r.text.split())
        assert r.text in dict(((x[0], x[3]), x[1] or "") for x in rows)[r.doc_id, r.source]
    assert words == {k: v for k, v in plan.items() if v}


def test_mix_empty_and_wordless(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0
    got = mixing.mix(frame(spark, [(1, None, None, None, None), (2, " ", None, "a", 0)])).collect()
    assert [(r.size, r.taken) for r in got] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("part", [4096, 2])
def test_sainte_lague_is_highest_quotients(spark, part):
    """Ties too: many rows of a group have the same weight."""
    rnd = random.Random(8)
    rows = [(g, i, float(rnd.choice([5, 40, 40, rnd.randrange(1, 1000)])), {"p": 57, "q": 7, "r": 0}[g]) for g in "pqr" for i in range(12)]
    with Scratch(spark, "test") as tmp:
        got = mixing.sainte_lague(spark.createDataFrame(rows, "g string, i long, w double, seats int"), "w", "seats", "i", "g", tmp, part=part).collect()
    for g, seats in {"p": 57, "q": 7, "r": 0}.items():
        quotients = sorted(((-w / (2 * q + 1), i, q) for gg, i, w, _ in rows if gg == g for q in range(seats)))[:seats]
        want = {i: sum(1 for _, j, _ in quotients if j == i) for gg, i, _, _ in rows if gg == g}
        assert {r.i: r.quota for r in got if r.g == g} == want


def test_mix_checks_the_number_of_sources(spark):
    rows = [(i, "some words here", "en", f"s{i}", 0) for i in range(9)]
    with pytest.raises(ValueError, match="9 sources"):
        mixing.mix(frame(spark, rows), max_sources=8)


# byte-level BPE


def tiktoken_encoding():
    import tiktoken

    pairs = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def test_bpe_equals_library():
    rnd, library = random.Random(1), tiktoken_encoding()
    texts = ["".join(rnd.choice("ab cñé\n\t 1漢字\U0001f642\xa0") for _ in range(rnd.randrange(200))) for _ in range(1500)]
    texts += ["a" * n for n in range(60)] + ["ab" * 5000, "thethe" * 3000, "", "  \n\n  x  "] + ["".join(rnd.choice("thersinao") for _ in range(3000)) for _ in range(20)]
    encoder = bpe.TextEncoder(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN, most=500)
    for start in range(0, len(texts), 100):
        ids, begin = encoder(texts[start : start + 100])
        for i, t in enumerate(texts[start : start + 100]):
            assert ids[begin[i] : begin[i + 1]].tolist() == library.encode_ordinary(t)


@pytest.mark.parametrize("unit", ["ab", "the"])
def test_bpe_on_very_long_pre_tokens(unit):
    """One pre-token of 20 and of 320 kB: right, and the time grows with the length, not its square."""
    import time

    import tiktoken

    pairs = bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=pairs.ranks, special_tokens={})
    seconds = {}
    for size in (20_000, 320_000):
        text = (unit * size)[:size]
        began = time.process_time()
        ids, _ = pairs.encode([text.encode()])
        seconds[size] = time.process_time() - began
        assert pairs.decode(ids.tolist()).decode() == text
        if size == 20_000:
            assert ids.tolist() == library.encode_ordinary(text)
    assert seconds[320_000] < 3 * 16 * seconds[20_000]


def test_rank_bitmap():
    bits, held, rnd = bpe.RankBitmap(100_000), set(), random.Random(2)
    for _ in range(3000):
        x = rnd.randrange(100_000)
        (bits.add(x), held.add(x)) if rnd.random() < 0.6 else (bits.discard(x) if x in held else None, held.discard(x))
        assert bits.first() == min(held, default=-1)


def test_bpe_frames(spark):
    path, library = P.path("byte_bpe_multi_50k.tiktoken"), tiktoken_encoding()
    rows = odd_rows()
    coded = bpe.encode(frame(spark, rows), path, P.PATTERN)
    assert coded.columns == [c for c in frame(spark, []).columns if c != "ids"] + ["ids"]
    back = bpe.decode(coded, path).collect()
    assert sorted(str((r.doc_id, list(r.ids), bytes(r.decoded))) for r in back) == sorted(str((i, library.encode_ordinary(t or ""), (t or "").encode())) for i, t, *_ in rows)
    for r in bpe.round_trip(frame(spark, rows), path, P.PATTERN).filter("id = 5").collect():
        ids = library.encode_ordinary(rows[5][1])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[5][1].encode()).hexdigest())
    assert bpe.round_trip(empty(spark), path, P.PATTERN).count() == 0 and bpe.encode(empty(spark), path, P.PATTERN).count() == 0


# token files


def library_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_chunks_encode_like_whole_texts():
    rnd, library = random.Random(5), library_tokenizer()
    texts = ["Don't stop 'tis the dogs' ',x' a'b''c It'S L'ÉTÉ ÉtÉ× ÷é ß ÿÞ é1,2a 3.x: ªº µm a\x1fb <|ENDOFTEXT|> <|endoftext|>", "İstanbul ΑΣ ΑΣ. ΣΑΣ", "ﬁ ẛ̣ 가 ᄀ ᅡ", "", "  ", "​z﻿"]
    texts += ["".join(rnd.choice(letters) for _ in range(60)) for letters in ("aBtsÉß '.,1|<>\ńé…Σxσ", "aBtsÉß '.,1|<>\n#é", "ab c.d,") for _ in range(800)]
    ids, begin = token_files.WordTokenizer(P.path("word_bpe_49k.json"), most=100)(texts)
    for i, t in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seq_len,batch", [(2048, 64), (16, 3)])
def test_token_files_round_trip(spark, seq_len, batch):
    library, rows = library_tokenizer(), odd_rows()
    out = fresh_dir(spark, "test-token-files")
    manifest = token_files.write_token_files(frame(spark, rows), out, P.path("word_bpe_49k.json"), seq_len=seq_len, batch=batch, shards=3).collect()
    got = sorted((r.start, r.n_tokens, r.ids_crc32, r.id) for r in token_files.read_token_files(spark, out).collect())
    all_ids = {}
    for i, t, *_ in rows:
        all_ids.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    start = 0
    for r in got:
        mine = next(x for x in all_ids[r[3]] if zlib.crc32(x.tobytes()) == r[2] and len(x) == r[1])
        assert r[0] == start
        start += len(mine)
    assert [r[3] for r in got] == sorted((x[0] for x in rows), key=lambda x: (x is None, x or 0))
    whole = []
    for m in sorted(manifest, key=lambda m: m.shard):
        shard = token_files.Shard(out, m.file)
        for i in range(m.n_sequences):
            ids, mask = shard.sequence(i)
            assert len(ids) == seq_len == len(mask) and ids.dtype == np.uint16 and not ids.flags.owndata
            whole += ids[np.array(mask.to_pylist())].tolist()
    assert len(whole) == start


def test_a_worker_keeps_its_tokenizer_while_the_file_stays(tmp_path):
    path = tmp_path / "words.json"
    path.write_bytes(Path(P.path("word_bpe_49k.json")).read_bytes())
    kept = token_files.shared_tokenizer(str(path))
    first = [x.tolist() for x in kept(["one two", "two three"])]
    known = kept.known
    again = token_files.shared_tokenizer(str(path))
    assert again is kept and [x.tolist() for x in again(["one two", "two three"])] == first and again.known == known
    fresh = token_files.WordTokenizer(str(path))(["three four one", ""])
    assert all((x == y).all() for x, y in zip(again(["three four one", ""]), fresh, strict=True))
    path.write_bytes(path.read_bytes() + b"\n")
    assert token_files.shared_tokenizer(str(path)) is not kept


def test_token_files_empty(spark):
    out = fresh_dir(spark, "test-token-files")
    token_files.write_token_files(empty(spark), out, P.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, out).count() == 0


# token counts


def test_counts_equal_library(spark):
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    def library(pieces, unknown, byte_fallback):
        t = Tokenizer(models.Unigram(pieces, unknown, byte_fallback))
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[\x20\x09-\x0D]+"), "removed"), pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)])
        return t

    rnd = random.Random(2)
    pieces, unknown = token_counts.vocabulary(P.path("piece_bpe_32k.model"))
    whole, counter = library(pieces, unknown, True), token_counts.UnigramCounter(pieces, unknown, most=50)
    texts = ["".join(rnd.choice("abc the▁é漢\U0001f642ñß<0x>unk") for _ in range(rnd.randrange(40))) for _ in range(800)] + ["<unk> <s> </s> <0x41> ▁▁▁▁ a▁▁b"] + [prose(rnd, 200) for _ in range(20)]
    assert [counter.count(t) for t in texts] == [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    small = [("<unk>", -100.0), ("▁", -1.0), ("a", -1.0), ("b", -2.0), ("ab", -3.0), ("ba", -3.0), ("aba", -4.0), ("▁a", -2.0), ("bb", -4.0)]
    tied, counter = library(small, 0, False), token_counts.UnigramCounter(small, 0)
    for _ in range(2000):
        t = "".join(rnd.choice("aabbc d") for _ in range(rnd.randrange(12)))
        assert counter.count(t) == len(tied.encode(t, add_special_tokens=False).ids), t
    rows = odd_rows()
    got = token_counts.token_counts(frame(spark, rows), P.path("piece_bpe_32k.model")).collect()
    assert sorted(str((r.id, r.n_tokens)) for r in got) == sorted(str((i, len(whole.encode(t or "", add_special_tokens=False).ids))) for i, t, *_ in rows)
    assert token_counts.token_counts(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


# language


def test_language_mixture_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = language_id.train(docs.filter(fold != 1))
    held = docs.filter(fold == 1)
    found = language_id.identify(held.withColumn("truth", F.col("lang")), model, carry=("truth",)).collect()
    assert len(found) == held.count() and sum(r.truth == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 < r.score <= 1 and r.languages[0] == r.lang_pred and abs(sum(r.shares) - 1) < 1e-6 for r in found)
    by_lang = {lang: held.filter(F.col("lang") == lang).first().text for lang in ("de", "fr")}
    both = spark.createDataFrame([(1, by_lang["de"] + " " + by_lang["fr"])], "doc_id long, text string")
    assert set(language_id.identify(both, model).first().languages) == {"de", "fr"}


def test_language_cases(spark):
    rows = odd_rows() + [(50, "123 !?", "en", "a", 1)]
    model = language_id.train(frame(spark, rows))
    got = language_id.identify(frame(spark, rows), model).collect()
    assert len(got) == len(rows) and model.languages == ("de", "en") or model.languages == ("en",)
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: str(r.id)), sorted(rows, key=lambda r: str(r[0])), strict=True):
        assert str(r.id) == str(i)
    und = {r.id for r in got if r.lang_pred == "und"}
    assert und >= {2, 3, 4, 50} and 1 not in und and all(r.score == 0 for r in got if r.lang_pred == "und")
    none = language_id.train(empty(spark))
    assert none.languages == () and {r.lang_pred for r in language_id.identify(frame(spark, rows), none).collect()} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


def test_language_mixture_of_five():
    """Every language of a mixture is found, in about its share."""
    names, rnd = "abcde", random.Random(5)
    words = [[" ".join("".join(rnd.choice("abcdefghijklmnop"[3 * i : 3 * i + 4]) for _ in range(6)) for _ in range(80))] for i in range(5)]
    counts = np.full((1 << 12, 5), 0.05)
    for i, text in enumerate(words):
        found, _ = language_id.grams(text, 12)
        np.add.at(counts[:, i], found, 1)
    model = language_id.Model(tuple(names), np.log(counts / counts.sum(0)).astype(np.float32), 12)
    theta, _ = language_id.infer([" ".join(w[0] for w in words), words[2][0]], model)
    assert (abs(theta[0] - 0.2) < 0.03).all() and theta[1].tolist() == [0, 0, 1, 0, 0]


def test_single_language_is_naive_bayes():
    """With one language allowed the chosen one has the greatest likelihood."""
    rnd = np.random.default_rng(0)
    p = rnd.dirichlet(np.ones(1 << 8), 3).T
    model = language_id.Model(("a", "b", "c"), np.log(p).astype(np.float32), 8)
    texts = ["".join(rnd.choice(list("abcdefgh "), 50)) for _ in range(40)]
    theta, _ = language_id.infer(texts, model, most=1)
    for t, row in zip(texts, theta):
        found, _ = language_id.grams([t], 8)
        assert row.argmax() == np.log(p)[found].sum(0).argmax()


# lines


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(4)
    pool = [prose(rnd, 6) for _ in range(30)]
    rows = odd_rows()
    for i in range(150):
        rows.append((100 + i, "\n".join(rnd.choice(pool[: 5 + i % 25]) + rnd.choice(["", " ", "\r"]) if rnd.random() < 0.7 else rnd.choice(["", "  ", prose(rnd, 4)]) for _ in range(rnd.randrange(8))), "en", rnd.choice("abcdefg") if i % 9 else None, 0))
    out = line_dedup.line_dedup(frame(spark, rows), min_sites=5, removed_col="size")
    assert out.columns == [c for c in frame(spark, []).columns if c != "size"] + ["size"]
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    sites, first = {}, {}
    for i, t, _, s, _ in rows:
        for x in {bare(y) for y in (t or "").split("\n")} - {""}:
            sites.setdefault(x, set()).add(s)
            if i is not None:
                first[x] = min(first.get(x, i), i)
    boiler = {x for x, s in sites.items() if len(s) >= 5}
    want = []
    for i, t, *_ in rows:
        kept = None if t is None else [y for y in t.split("\n") if not (bare(y) in boiler and (i is None or i != first.get(bare(y))))]
        want.append(str((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept))))
    assert sorted(str((r.doc_id, r.text, r["size"])) for r in out.collect()) == sorted(want)
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_of_a_text_of_many_lines(spark):
    """40,000 lines, half of them boilerplate, beside a short text: no step compares lines with lines."""
    lines = [f"line number {i}" for i in range(40_000)]
    rows = [(i, "\n".join(lines[::2]), "en", f"s{i}", 0) for i in range(5)] + [(9, "\n".join(lines), "en", "s9", 0)]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows), removed_col="n").collect()}
    assert got[0].n == 0 and got[9].n == 20_000 and got[9].text == "\n".join(lines[1::2]) and got[1].text == ""


def test_line_dedup_many_sites(spark):
    """Far above the threshold the sketch decides, near it the exact count: 89, 90 and 400 sites at a threshold of 90."""
    rows = [(1000 * k + i, f"line {k}", "en", f"site{i}", 0) for k, n in ((1, 89), (2, 90), (3, 400)) for i in range(n)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA), min_sites=90, lg_k=8).filter("text <> ''").groupBy("text").count().collect()
    assert {r.text: r["count"] for r in out} == {"line 1": 89, "line 2": 1, "line 3": 1}


# repetition


def brute_longest(words):
    n = len(words)

    def common(i, j):
        k = 0
        while i + k < n and j + k < n and words[i + k] == words[j + k]:
            k += 1
        return k

    return [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]


def test_longest_repeats():
    rnd = random.Random(3)
    for _ in range(150):
        docs = [[rnd.randrange(rnd.choice([1, 2, 3, 10])) for _ in range(rnd.randrange(40))] for _ in range(rnd.randrange(1, 6))]
        got = repetition.longest_repeats(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]), rnd.choice([1, 4]))
        want = np.array([x for d in docs for x in brute_longest(d)], np.int64)
        assert (np.where(got < 4, 0, got) == np.where(want < 4, 0, want)).all()


@pytest.mark.parametrize("window,repeat", [(1, 1), (2, 2), (3, 3)])
def test_repetition_of_short_windows(window, repeat):
    """Short windows too, and a text's figures do not depend on the texts beside it."""
    rnd, rules = random.Random(17), repetition.Rules(window=window, repeat_words=repeat)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(1, 40))) for _ in range(60)] + ["x y z " * 30]
    both = repetition.measure(texts, rules)
    for i, t in enumerate(texts):
        longest = brute_longest(t.split())
        assert both["n_repeat_words"][i] == len({q for p, n in enumerate(longest) if n >= window for q in range(p, p + window)})
        assert both["longest_repeat"][i] == max([n for n in longest if n >= repeat], default=0)


def test_repetition_rules_against_brute_force(spark):
    rnd, rows = random.Random(9), odd_rows()
    for i in range(60):
        part = prose(rnd, rnd.choice([4, 5, 12, 60]))
        rows.append((100 + i, "\n".join(rnd.choice([part, prose(rnd, rnd.randrange(30)), "", "# $ |"]) for _ in range(rnd.randrange(1, 6))), "en", "a", 0))
    rows[5] = (5, rows[5][1][:3000], "en", "a", 9)
    rules = repetition.Rules()
    got = {str((r.id, r.n_words, r.word_chars)): r for r in repetition.repetition_rules(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        t = t or ""
        words = [w.decode() for w in t.encode().split()]
        longest = brute_longest(words)
        windows, spans = set(), set()
        for p, n in enumerate(longest):
            if n >= 5:
                windows |= set(range(p, p + 5))
            if n >= rules.repeat_words:
                spans |= set(range(p, p + n))
        lines = [x for x in t.split("\n") if x.split()]
        base = len(words) < 10 or 100 * len(windows) > 20 * len(words)
        fine = 100 * len(spans) <= rules.covered_percent * len(words) and max([n for n in longest if n >= rules.repeat_words], default=0) <= rules.longest_words
        r = got[str((i, len(words), sum(map(len, words))))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(windows), base, not base and fine)
    kept = repetition.accepted(frame(spark, rows))
    assert kept.columns == frame(spark, []).columns and kept.count() == repetition.repetition_rules(frame(spark, rows)).filter("kept").count()
    assert repetition.repetition_rules(empty(spark)).count() == 0 and repetition.accepted(empty(spark)).count() == 0


# PII


def test_surrogates(spark):
    rows = [
        (1, "Mail a.b@x.org or A.B@x.org, c.d@x.org; Herr Müller and Frau Anna Müller, Mr. John Smith. IP 10.1.2.3! card 4111 1111 1111 1111 or 4111111111111111. tel +1 (743) 555-3824", "en", "a", 0),
        (2, 'г-жа Анна Иванова token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### élan.19@mail5.example.com### SSN 123-45-6789, Mr. John Smith. 10.1.2.3', "en", "b", 0),
        (3, "nothing here, 3.14 and 12345678901234567890123", None, None, None), *odd_rows(),
    ]
    out = pii.pseudonymise(frame(spark, rows), "key", count_col="size").orderBy("doc_id")
    got = {r.doc_id: r for r in out.filter("size > 0 OR doc_id = 3").collect() if r.doc_id in (1, 2, 3) and r.text and ("@" in r.text or "nothing" in r.text)}
    one, two = got[1].text, got[2].text
    for secret in ("a.b@", "Müller", "John", "Smith", "10.1.2.3", "4111", "743", "Анна", "Иванова", "24be64", "123-45", "élan"):
        assert secret not in one + two
    assert got[1]["size"] == 10 and got[2]["size"] == 6 and got[3]["size"] == 0 and got[3].text == rows[2][1]
    import re

    herr, frau = re.search(r"Herr (\w+)", one)[1], re.search(r"Frau (\w+) (\w+)", one)
    assert herr == frau[2] and frau[1].endswith(("na", "lia", "ra", "tta", "sa", "nne", "ria"))
    assert re.search(r"Mr\. (\w+ \w+)", one)[1] == re.search(r"Mr\. (\w+ \w+)", two)[1]
    assert re.search(r"г-жа ([а-яА-Я]+) ([а-яА-Я]+)", two)
    mails = re.findall(r"(\w\.\w)@(\w)\.org", one)
    assert mails[0][0].upper() == mails[1][0] and mails[0] != mails[2] and len({m[1] for m in mails}) == 1
    cards = re.search(r"card (\d{4}) (\d{4}) (\d{4}) (\d{4}) or (\d{16})", one)
    digits = "".join(cards.groups()[:4])
    assert digits == cards[5] and sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"tel \+1 \(\d{3}\) \d{3}-\d{4}", one) and re.search(r'token = "[0-9a-f]{40}"###', two) and re.search(r"SSN \d{3}-\d{2}-\d{4}", two)
    assert set(re.findall(r"\d+\.\d+\.\d+\.\d+", one)) == set(re.findall(r"\d+\.\d+\.\d+\.\d+", two))
    plain = {str((r[0], r[1])) for r in odd_rows()}
    assert sorted(str((r.doc_id, r.text)) for r in out.collect() if str((r.doc_id, r.text)) in plain) == sorted(str((r[0], r[1])) for r in odd_rows())
    other = pii.pseudonymise(frame(spark, rows[:1]), "another").first().text
    assert other != one and pii.pseudonymise(empty(spark), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    """All 10 one-digit-free forms collide at first: distinct entities keep distinct replacements, none a real entity."""
    rows = [(i, f"Mr. {chr(65 + i % 26)}{chr(97 + i // 26)}x", "en", "a", 0) for i in range(600)]
    before = {r[1] for r in rows}
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").collect()]
    assert len(set(got)) == len(before) and not set(got) & before


def test_surrogates_never_run_out(spark):
    """26 one-letter addresses at one short domain, and more numbers than a format has forms: all distinct, and none fails."""
    rows = [(i, f"to {chr(97 + i)}@x.org", "en", "a", 0) for i in range(26)]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), "k").collect()]
    assert len(set(got)) == 26 and not set(got) & {r[1] for r in rows} and all(t.endswith(".org") for t in got)
    crowd = spark.createDataFrame([("ipv6", f"{i:x}", "", f"{i:x}") for i in range(16)], "kind string, canon string, gender string, sample string")
    with Scratch(spark, "test") as tmp:
        settled = pii.settle(crowd, F.lit("k"), tmp, most_attempts=3)
        made = [r.made for r in pii.with_surrogate(settled, F.lit("k"), "sample").collect()]
    assert len(set(made)) == 16 and all(m.startswith("ipv6-") for m in made)


def test_surrogates_of_further_kinds(spark):
    text = "Dr. Ada Long and Mr Long: DE44 5001 0517 5407 3249 31 or DE44500105175407324931, 2001:0db8:85a3:0000:0000:8a2e:0370:7334, sk-abcDEF1234567890abcDEF, " + "ab" * 100 + "; end"
    (row,) = pii.pseudonymise(spark.createDataFrame([(1, text, None, None, None)], SCHEMA), "k", count_col="n").collect()
    import re

    assert row.n == 7 and not any(x in row.text for x in ("Ada", "Long", "5407", "85a3", "abcDEF", "abab"))
    names = re.match(r"Dr\. (\w+) (\w+) and Mr (\w+):", row.text)
    assert names[2] == names[3]
    ibans = re.search(r": (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}),", row.text)
    assert ibans[1].replace(" ", "") == ibans[2]
    assert re.search(r", [0-9a-f]{4}(:[0-9a-f]{4}){7}, sk-[a-z]{3}[A-Z]{3}\d{10}[a-z]{3}[A-Z]{3}, [0-9a-f]{200}; end$", row.text)


def test_surrogates_key_is_in_no_plan(spark):
    out = pii.pseudonymise(frame(spark, [(1, "Mr. John Smith", None, None, None)]), "very-secret-key")
    assert "very-secret-key" not in out._jdf.queryExecution().toString()


def test_surrogates_against_plain_replacement(spark):
    """Every mention is replaced as its entity alone would be, and nothing else changes."""
    import re

    rnd = random.Random(12)
    entities = ["a.b@x.org", "c@y.net", "10.1.2.3", "743-555-3824", "123-45-6789", "Mr. John Smith", "Mrs Eva Smith"]
    rows = [(i, " ".join(rnd.choice([*entities, "word", "3.14", "x,"]) for _ in range(rnd.randrange(12))), None, None, None) for i in range(60)]
    rows += [(100 + i, e, None, None, None) for i, e in enumerate(entities)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, rows), "k").collect()}
    alone = {e: got[100 + i] for i, e in enumerate(entities)}
    assert len(set(alone.values())) == len(alone) and not set(alone) & set(alone.values())
    pattern = re.compile("|".join(map(re.escape, entities)))
    assert all(got[i] == pattern.sub(lambda m: alone[m[0]], t) for i, t, *_ in rows)


def test_language_mixture_against_plain_em():
    """Proportions and the chosen set against EM over every set of languages, document by document."""
    rnd = np.random.default_rng(3)
    p = rnd.dirichlet(np.full(1 << 8, 0.3), 4).T
    model = language_id.Model(("a", "b", "c", "d"), np.log(p).astype(np.float32), 8)
    texts = ["".join(rnd.choice(list("abcdefghijklmnop "), 90)) for _ in range(25)]
    theta, _ = language_id.infer(texts, model, tolerance=1e-9)
    for t, row in zip(texts, theta):
        found, _ = language_id.grams([t], 8)

        def fit(chosen):
            q, mix = np.exp(model.log_p[found][:, chosen].astype(np.float64)), np.full(len(chosen), 1 / len(chosen))
            for _ in range(3000):
                share = q * mix
                mix = (share / share.sum(1, keepdims=True)).mean(0)
            return np.log(q @ mix).sum(), mix

        order = np.argsort(-fit(list(range(4)))[1], kind="stable")
        sets = [[i] for i in range(4)] + [sorted(order[:k].tolist()) for k in (2, 3, 4)]
        score = {tuple(c): fit(c)[0] - 3 * np.log(len(found)) * (len(c) - 1) for c in sets}
        best = max(score, key=score.get)
        near = [c for c in score if score[c] > score[best] - 0.01]
        mine = tuple(np.flatnonzero(row > 1e-6).tolist())
        assert any(set(mine) <= set(c) for c in near)
        assert abs(row[list(best)] - fit(list(best))[1]).max() < 0.02 or len(near) > 1


#: Texts with what must go, what must stay.
NAMED = [
    ("Ms Anna Maria Smith called", ("Anna", "Maria", "Smith"), "called"), ("Mr J. Smith left", ("J.", "Smith"), "left"), ("by MR SMITH today", ("SMITH",), "today"), ("then mr smith came", ("smith",), "came"),
    ("Mrs. Jane  Doe slept", ("Jane", "Doe"), "slept"), ("Mr Smith Then left", ("Smith",), "Then left"), ("at 2001:db8::1 up", ("2001:db8::1",), "up"), ("Dr Anna Smith won", ("Anna", "Smith"), "won"),
    ("Herr Karl von der Heide ging", ("Karl", "Heide"), "ging"), ("Frau\tErika\xa0Muster-Mann. Sie", ("Erika", "Muster-Mann"), ". Sie"), ("Prof van Dyke spoke", ("Dyke",), "spoke"), ("Mr T.S. Eliot wrote", ("T.S.", "Eliot"), "wrote"),
    ("господин Иван Петров ушёл", ("Иван", "Петров"), "ушёл"), ("took 5 ms later, a::b stays", (), "took 5 ms later, a::b stays"), ("mrs doubtfire", ("doubtfire",), "mrs"), ("MS Word opens", (), "MS Word opens"),
]


def test_pii_names_of_any_run_case_and_blanks(spark):
    rows = [(i, t, None, None, None) for i, (t, _, _) in enumerate(NAMED)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, rows), "k").collect()}
    left = [(got[i], w) for i, (_, gone, _) in enumerate(NAMED) for w in gone if re.search(rf"(?<!\w){re.escape(w)}(?!\w)", got[i])]
    assert not left and all(stays in got[i] for i, (_, _, stays) in enumerate(NAMED))
    # One person, one name: by any title, in any case; different initials stay different.
    assert got[0].split()[1] == got[7].split()[1] and got[0].split()[3] == got[7].split()[2] == got[5].split()[1]
    assert got[2].split()[2] == got[5].split()[1].upper() and got[3].split()[2].lower() == got[5].split()[1].lower()
    assert re.fullmatch(r"Mr [A-Z]\.[A-Z]\. \w+ wrote", got[11]) and "  " in got[4] and "von der " in got[8] and "\t" in got[9] and "\xa0" in got[9]


def test_token_files_of_other_tokenizers_take_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["Hello World don't STOP", "", None, "  two  blanks\n\nÄß 'x'", "it's 12,345 <|endoftext|> end", "a" * 5000 + " B"]
    for file, sure in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = P.path(file)
        assert token_files.parts_surely(path) == sure
        out = str(tmp_path / file)
        token_files.write_token_files(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), out, path, seq_len=16, batch=4, shards=2)
        want = [[*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        got = {r.id: (r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, out).collect()}
        assert got == {i: (len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)}


def test_token_files_refuse_ids_that_are_no_integers(spark, tmp_path):
    with pytest.raises(TypeError, match="integral"):
        token_files.write_token_files(spark.createDataFrame([("x", "a")], "doc_id string, text string"), str(tmp_path / "none"), P.path("word_bpe_49k.json"))


@pytest.mark.parametrize("bucket", [2, 16])
def test_simhash_gathers_no_table_in_the_driver(spark, monkeypatch, bucket):
    """Tables of fingerprints, links and roots grow with the input, so no join broadcasts one, however small its files are."""
    plans, keep = [], simhash.Scratch.keep

    def kept(tmp, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(tmp, df, name)

    monkeypatch.setattr(simhash.Scratch, "keep", kept)
    rnd = random.Random(5)
    texts = [prose(rnd, 30) for _ in range(6)]
    rows = [(i, texts[i % 6] + (" end" * (i % 4)), None, None, None) for i in range(60)]
    found = simhash.near_duplicates(frame(spark, rows), bucket=bucket)
    assert found.count() == 60 and any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_surrogates_join_texts_alike_at_every_size(spark):
    """Texts meet their replacements by merging, however few these are, so the disk a GB does not jump where a broadcast ends."""
    docs = frame(spark, [(i, f"mail x{i}@example.com now", None, None, None) for i in range(5)])
    plan = pii.pseudonymise(docs, "a key of some length")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
