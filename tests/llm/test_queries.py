"""The queries of the training-data operators on the smallest tables: their columns, their SQL where there is one, and contracts."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

from loomspan.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import library_tokenizer, tiktoken_encoding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    sql = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in sql.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: str(row)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(sql.fetchall(), key=key)


def test_op1(spark, docs):
    got = QUERIES["op1_language_mixture"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95


def test_op2(spark, docs):
    library, start, want = library_tokenizer(), 0, {}
    for i in sorted(docs):
        ids = np.array([*library.encode(docs[i].text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_files"](spark, SF).collect()} == want


def test_op3(spark, docs):
    library, want = tiktoken_encoding(), {}
    for i, r in docs.items():
        ids = library.encode_ordinary(r.text or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op3_byte_bpe"](spark, SF).collect()} == want


def test_op9_leaves_no_entity_and_no_change_elsewhere(spark, docs):
    import re

    private = re.compile(r"[\w.+-]+@[\w.-]+\.com|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\+1 \(\d+\) \d+-\d+|\b[0-9a-f]{40}\b")
    for r in QUERIES["op9_pii_surrogates"](spark, SF).collect():
        found = private.findall(docs[r.doc_id].text)
        assert not [x for x in found if x in r.text] and (found or r.text == docs[r.doc_id].text) and (r.n_replaced > 0) == bool(found)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_conversation_repair", "op13_source_divergence"}))
def test_one_row_per_document(spark, docs, name):
    df = QUERIES[name](spark, SF)
    assert "doc_id" in df.columns and sorted(r.doc_id for r in df.select("doc_id").collect()) == sorted(docs)


def test_vocabularies_are_parameters():
    assert P.path("word_bpe_49k.json").endswith("word_bpe_49k.json")
