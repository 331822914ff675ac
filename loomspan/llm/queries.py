"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.bpe import round_trip
from loomspan.llm.common import documents, fresh_dir
from loomspan.llm.conversation_repair import conversation_rows, damaged, repair_report
from loomspan.llm.divergence import divergence
from loomspan.llm.exact_dedup import exact_dedup
from loomspan.llm.language_id import identify, train
from loomspan.llm.line_dedup import line_dedup
from loomspan.llm.mixing import mix
from loomspan.llm.ngram_join import jaccard_classes
from loomspan.llm.pii import pseudonymise
from loomspan.llm.repetition import repetition_rules
from loomspan.llm.simhash import near_duplicates
from loomspan.llm.token_counts import token_counts
from loomspan.llm.token_files import read_token_files, write_token_files


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    docs = docs.select("doc_id", "text", "lang", (fold == 1).alias("held_out"))
    model = train(docs.filter("NOT held_out"))
    return identify(docs, model, carry=("held_out",)).withColumnRenamed("id", "doc_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "token-files")
    write_token_files(documents(spark, sf_dir), out, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, out).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op4_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Micro-batches of 32 MB of files a core: 250 GB on 8,000 cores, so some 400 batches over 100 TB.
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet", max_bytes_per_trigger=spark.sparkContext.defaultParallelism << 25)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS k, count(*) OVER (PARTITION BY h) AS g,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, g AS group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text", "source"), removed_col="n_removed").select("doc_id", "n_removed", "text")


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM lines
), boiler AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('=' || source, '')) >= 5
), marked AS (
  SELECT doc_id, line, pos, b.k IS NOT NULL AND doc_id <> first_id AS bad FROM keyed LEFT JOIN boiler b USING (k)
), cut AS (
  SELECT doc_id, count(*) FILTER (bad) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS text FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE cut.text END AS text FROM documents d LEFT JOIN cut USING (doc_id)
"""


def op8_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonymise(docs, "an example key; a deployment passes its own", count_col="n_replaced")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sizes GROUP BY source
), w AS (
  SELECT *, (CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM src
), lvl AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w
), free AS (
  SELECT arg_min(rest / open_weight, cap / weight) AS level FROM lvl WHERE cap / weight > rest / open_weight
), tgt AS (
  SELECT sid, source, source_size, n_docs, CASE WHEN cap / weight <= rest / open_weight THEN cap ELSE level * weight END AS target FROM lvl LEFT JOIN free ON true
), lined AS (
  SELECT z.doc_id, z.size, t.sid, t.source_size, t.target, h % greatest(1, ceil(n_docs / 256.0)::BIGINT) AS shard, h,
         sum(z.size) OVER (PARTITION BY t.sid, h % greatest(1, ceil(n_docs / 256.0)::BIGINT) ORDER BY h, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM (SELECT *, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS h FROM sizes) z
  JOIN tgt t ON z.source IS NOT DISTINCT FROM t.source
), shards AS (
  SELECT sid, shard, sum(size)::BIGINT AS words, CASE WHEN sum(size) > 0 THEN greatest(1, round(sum(size) / 64.0))::BIGINT ELSE 0 END AS blocks FROM lined GROUP BY sid, shard
), seats AS (SELECT round(sum(target) / 64)::BIGINT AS n FROM tgt),
q1 AS (
  SELECT sid, row_number() OVER (ORDER BY target / (2 * q + 1) DESC, sid, q) AS place
  FROM (SELECT sid, target, unnest(range(0, (SELECT n FROM seats))) AS q FROM tgt WHERE target > 0)
), won1 AS (
  SELECT tgt.sid, source_size, count(place) AS quota FROM tgt LEFT JOIN (SELECT * FROM q1 WHERE place <= (SELECT n FROM seats)) q USING (sid) GROUP BY tgt.sid, source_size
), held AS (
  SELECT sid, round(least(CASE WHEN source_size > 0 THEN quota * 64 / source_size::DOUBLE ELSE 0 END, 2.0) * own)::BIGINT AS n
  FROM won1 JOIN (SELECT sid, sum(blocks) AS own FROM shards GROUP BY sid) USING (sid)
), q2 AS (
  SELECT sid, shard, n, row_number() OVER (PARTITION BY sid ORDER BY blocks / (2 * q + 1)::DOUBLE DESC, shard, q) AS place
  FROM (SELECT s.sid, shard, blocks, n, unnest(range(0, 2 * blocks)) AS q FROM shards s JOIN held USING (sid))
), plan AS (
  SELECT s.sid, s.shard, words, blocks, quota, CASE WHEN blocks > 0 THEN quota // blocks ELSE 0 END AS rounds,
         CASE WHEN blocks > 0 THEN ('0x' || substr(md5('18:' || s.sid || ':' || s.shard), 1, 15))::BIGINT % blocks ELSE 0 END AS a
  FROM shards s JOIN (SELECT s.sid, s.shard, count(place) AS quota FROM shards s LEFT JOIN (SELECT * FROM q2 WHERE place <= n) q USING (sid, shard) GROUP BY ALL) USING (sid, shard)
), arcs AS (
  SELECT sid, shard, rounds, CASE WHEN blocks > 0 THEN a * words // blocks ELSE 0 END AS a0,
         CASE WHEN blocks > 0 THEN least(a + quota - rounds * blocks, blocks) * words // blocks ELSE 0 END AS a1,
         CASE WHEN blocks > 0 THEN greatest(a + quota - rounds * blocks - blocks, 0) * words // blocks ELSE 0 END AS b1 FROM plan
)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(a1, upto) - greatest(a0, upto - size)) + greatest(0, least(b1, upto) - greatest(0, upto - size)))::BIGINT AS taken
FROM lined JOIN arcs USING (sid, shard)
"""

def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    return repair_report(damaged(rows)).withColumnRenamed("conv", "conv_id")


def _edit(costs: str, cost: str, letter: str) -> str:
    """SQL: nine digits of cost and the audit so far, after one more edit."""
    return f"(printf('%09d', substr({costs}, 1, 9)::INTEGER + {cost}) || substr({costs}, 10) || '{letter}')"


def _reached(keeps: str, states: tuple[str, ...], initial: str, deleted: str) -> str:
    """SQL: the least way to a state by deletion, or from ``states`` by keeping a row of ``initial`` or (if ``keeps`` has R) re-roling it."""
    ways = [_edit(deleted, "3", "D")]
    for x in states:
        ways.append(f"CASE WHEN NOT must AND initial = '{initial}' THEN {_edit(x, 'extra', 'K')} END")
        if "R" in keeps:
            ways.append(f"CASE WHEN NOT must THEN {_edit(x, '2 + extra', 'R')} END")
    return f"least({', '.join(ways)})"


_INSERTED = f"least(v2, {_edit('v0', '2', 'I')}, {_edit('v1', '2', 'I')}, {_edit('v3', '2', 'I')})"
OP12_SQL = rf"""
WITH RECURSIVE table_of AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))
), given AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes
  FROM conversations
), diced AS (
  SELECT conv, turn, role, text, xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS dice FROM given, table_of
), damage AS (
  SELECT conv, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role,
         CASE dice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN dice = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM diced WHERE dice <> 0
), seen AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n FROM damage
), lined AS (
  SELECT conv, turn, role, text, n, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) AS before FROM seen
), steps AS (
  SELECT conv, n, initial, blank OR dup AS must, cut::INTEGER AS extra FROM lined
), ids AS (SELECT DISTINCT conv FROM given),
dp(conv, n, v0, v1, v2, v3) AS (
  SELECT conv, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM ids
  UNION ALL
  SELECT conv, n, {_edit("v0", "3", "D")}, {_reached("K", ("v0",), "s", "v1")}, {_reached("KR", ("v0", "v1", "v3"), "u", "v2")}, {_reached("KR", ("v2",), "a", "v3")}
  FROM (SELECT conv, n, must, extra, initial, v0, v1, v2, least(v3, {_edit("v2", "2", "I")}) AS v3
        FROM (SELECT s.conv, s.n, must, extra, initial, v0, v1, {_INSERTED} AS v2, v3 FROM dp JOIN steps s ON s.conv IS NOT DISTINCT FROM dp.conv AND s.n = dp.n + 1))
), ended AS (
  SELECT conv, least(v0, v3, {_edit("v2", "2", "I")}) AS best FROM (SELECT conv, v0, {_INSERTED} AS v2, v3 FROM dp QUALIFY n = max(n) OVER (PARTITION BY conv))
), answers AS (
  SELECT conv, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM ended
), edits AS (
  SELECT conv, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS place FROM answers WHERE audit <> ''
), fed AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv ORDER BY place) AS n FROM edits
), made AS (
  SELECT f.conv, e, role, text, row_number() OVER (PARTITION BY f.conv ORDER BY place) AS k FROM fed f LEFT JOIN lined l ON e <> 'I' AND l.conv IS NOT DISTINCT FROM f.conv AND l.n = f.n WHERE e <> 'D'
), led AS (
  SELECT *, (k - max((k = 1 AND e = 'K' AND left(role, 1) = 's')::INTEGER) OVER (PARTITION BY conv)) % 2 = 1 AS is_user FROM made
), joined AS (
  SELECT conv, string_agg(CASE WHEN e = 'K' THEN role WHEN is_user THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS whole FROM led GROUP BY conv
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM lined GROUP BY conv
)
SELECT i.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids i JOIN answers a ON a.conv IS NOT DISTINCT FROM i.conv LEFT JOIN counts c ON c.conv IS NOT DISTINCT FROM i.conv LEFT JOIN joined j ON j.conv IS NOT DISTINCT FROM i.conv
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir).select("lang", "source", "text"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), occurs AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counted AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurs GROUP BY ALL
), kept AS (
  SELECT lang, term FROM occurs GROUP BY ALL HAVING count(DISTINCT k) >= 10
), vocabulary AS (
  SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), used AS (
  SELECT c.* FROM counted c JOIN kept USING (lang, term)
), grp AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN vocabulary USING (lang) LEFT JOIN used USING (lang, source) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 2) // (g.total + 2 * g.v) AS p
  FROM grp g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)
), whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 2) // (any_value(total) + 2 * any_value(v)) AS q
  FROM used JOIN (SELECT lang, any_value(v) AS v, sum(total)::HUGEINT AS total FROM grp GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', item, value::BIGINT FROM terms
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM rows
QUALIFY part = 'pair' OR rank <= 10
"""

QUERIES = {
    "op1_language_mixture": op1_language_mixture,
    "op2_token_files": op2_token_files,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_unigram_counts": op4_unigram_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_line_spread": op7_line_spread,
    "op8_suffix_repetition": op8_suffix_repetition,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_mix_sources": op10_mix_sources,
    "op11_ngram_jaccard": op11_ngram_jaccard,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {"op5_exact_dedup": OP5_SQL, "op7_line_spread": OP7_SQL, "op10_mix_sources": OP10_SQL, "op12_conversation_repair": OP12_SQL, "op13_source_divergence": OP13_SQL}
