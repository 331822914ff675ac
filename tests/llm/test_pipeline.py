"""The pipeline's stages against brute force on a small fixture, and its queries' SQL."""

from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from loomspan.llm import bpe, mixing, repetition
from tests.llm.test_operators import SCHEMA, prose, similar_components, tiktoken_encoding


def fixture():
    rnd = random.Random(11)
    licence = " ".join(prose(rnd, 12) for _ in range(5))
    rows = [(i, "\n".join([prose(rnd, 80), licence if i % 3 == 0 else prose(rnd, 9)]), "en", f"s{i % 8}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s9", 0) for i in range(0, 20, 2)]  # exact copies
    rows += [(200 + i, rows[i][1].replace("wizards", "lizards", 1), "en", "s9", 0) for i in range(1, 20, 2)]  # near copies
    rows += [(300, "buy now " * 40, "en", "s1", 0), (301, None, None, None, None), (302, "", "en", "s1", 0), (303, "too short", "en", "s1", 0)]
    return rows


def test_pipeline_stages(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA)
    by_name = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mix_sources", "byte_bpe"]
    ids = lambda df: sorted(r.doc_id for r in df.collect())

    one = by_name["quality_rules"](spark, docs, "").cache()
    verdicts = {r.id: r.kept for r in repetition.repetition_rules(docs).collect()}
    assert ids(one) == sorted(i for i, k in verdicts.items() if k) and not {300, 301, 302, 303} & set(ids(one)) and set(range(60)) <= set(ids(one))

    two = by_name["line_dedup"](spark, one, "").cache()
    assert ids(two) == ids(one) and two.columns == docs.columns
    licence = fixture()[0][1].split("\n")[1]
    assert [r.doc_id for r in two.filter(F.col("text").contains(licence)).collect()] == [0]

    three = by_name["simhash_near_dedup"](spark, two, "").cache()
    groups = similar_components([(r.doc_id, r.text) for r in two.collect()], 0.8)
    assert ids(three) == sorted({*groups.values()}) and three.columns == docs.columns and len(ids(three)) < len(ids(two))

    four = by_name["mix_sources"](spark, three, "").cache()
    taken = {r.id: r.taken for r in mixing.mix(three).collect()}
    words: dict = {}
    for r in four.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {i: n for i, n in taken.items() if n} and four.columns == docs.columns

    library = tiktoken_encoding()
    five = by_name["byte_bpe"](spark, four, "").collect()
    texts = [(r.doc_id, library.encode_ordinary(r.text)) for r in four.collect()]
    assert sorted((r.doc_id, list(r.ids)) for r in five) == sorted(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in five)


def test_round_trip_column_tells_of_lost_bytes(spark):
    rows = [(1, "plain text, é 漢字", None, None, None), (2, None, None, None, None), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("same", F.lit(7))
    got = bpe.encode(docs, public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN, same_col="same")
    assert got.columns == [*docs.columns[:-1], "ids", "same"] and {r.doc_id: r.same for r in got.collect()} == {1: True, 2: True, 3: True}
    torn = bpe.encode(docs, public_tokenizers.path(corpus_pipeline.RANKS), r"[a-z]+", same_col="same")
    assert {r.doc_id: r.same for r in torn.collect()} == {1: False, 2: True, 3: True}


def test_pipeline_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_pipeline_handles_clashing_columns(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA).withColumns({c: F.lit(1) for c in ("id", "fp", "size", "ids", "decoded", "_k")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[-6:] == ["id", "fp", "size", "ids", "decoded", "_k"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_near_duplicate_stage_goes_by_simhash(spark, monkeypatch):
    """The stage's first pairs are those of SimHash blocks and Hamming distance: all within the distance, and near copies among them."""
    from loomspan.llm import simhash

    seen, made = [], simhash.hamming_pairs

    def told(sets, tmp):
        pairs = made(sets, tmp)
        words = {r.node: r.fp for r in sets.select("node", F.element_at("point", 1).alias("fp")).collect()}
        seen.extend(((words[r.a] ^ words[r.b]) % (1 << 64)).bit_count() for r in pairs.collect())
        return pairs

    monkeypatch.setattr(simhash, "hamming_pairs", told)
    rnd = random.Random(2)
    texts = [prose(rnd, 300) for _ in range(12)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(100 + i, t + " end", "en", "s", 0) for i, t in enumerate(texts)]
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(12)) and len(seen) >= 6 and max(seen) <= 4
