"""Source divergence audit: how far the words of every source of a language lie from those of every other source of it.

A group is a (language, source). Counts of its terms are smoothed to whole numbers ``p``, and two groups differ by the sum of
``floor((p - q)^2 / (p + q))`` over the language's terms. The sum is made by Gustavson's row accumulation: postings are dealt by term,
so that a task holds a term-major index of its terms; each group scatters its terms through that index into one dense accumulator
over its peers, and no pair of postings is ever a row. A term that a side lacks has that side's zero baseline there, so an
accumulator starts from "nobody has any term" and is corrected for the peer's terms, the group's terms, and those of both.
Spark deals terms to tasks by hash and adds up one partial row per pair of groups and task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, salted_join, stored, text_slices

#: ASCII letters in lower case and all bytes above ASCII stay; everything else parts terms.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Numerators over 10^9 are divided three digits at a time, so totals up to this stay within 64 bits.
_MOST = (1 << 63) // 1000
SCALE_STEPS = 3


def term_lists(text: str, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about ``most`` bytes, so that a very long text is never one list."""
    data, start = text.encode("utf-8", "surrogatepass").translate(_TERMS), 0
    while start < len(data):
        end = data.find(b" ", start + most)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def smoothed(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (count + 2) / total)``, exactly."""
    if np.max(total, initial=1) >= _MOST:
        raise ValueError(f"a group has more than {_MOST} words")
    whole, rest = np.divmod(count + 2, total)
    for _ in range(SCALE_STEPS):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return 1 + whole


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _counted(batches: Iterator[pa.RecordBatch], held: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Words and documents per group and term; a row without a term tells of the group itself. Told whenever ``held`` terms are held."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (words, docs) in found.items():
            terms = pa.array([None, *words], pa.binary()).cast(pa.string())
            columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            numbers = [pa.array([0, *(x[w] for w in words)], pa.int64()) for x in (words, docs)]
            yield pa.RecordBatch.from_arrays([*columns, terms, *numbers], ["lang", "source", "term", "n", "docs"])

    for batch, texts in text_slices(batches, 2):
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            words, docs = found.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in term_lists(text):
                words.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(x) for x, _ in found.values()) > held:
            yield from told()
            found.clear()
    yield from told()


def row_accumulation(terms: np.ndarray, sources: np.ndarray, p: np.ndarray, zero: np.ndarray, n_terms: int, rows: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``rows``, the sums over ``n_terms`` terms of its gap to every group.

    ``terms, sources, p`` are postings in order of terms, ``zero`` each group's value for a term that it lacks. At most ``chunk``
    entries are expanded at once.
    """
    starts = np.searchsorted(terms, np.arange(n_terms + 1))
    by_source = np.argsort(sources, kind="stable")
    ends = np.searchsorted(sources[by_source], np.arange(len(zero) + 1))
    # Equal values of one group are corrected once.
    values = [np.unique(p[by_source[ends[i] : ends[i + 1]]], return_counts=True) for i in range(len(zero))]
    owner = np.repeat(np.arange(len(zero)), [len(v) for v, _ in values])
    value, times = (np.concatenate([x[k] for x in values]) if len(owner) else np.empty(0, np.int64) for k in (0, 1))
    for row in rows:
        nothing = _gap(zero[row], zero)
        sums = n_terms * nothing
        np.add.at(sums, owner, times * (_gap(zero[row], value) - nothing[owner]))
        for v, n in zip(*values[row], strict=True):
            sums += n * (_gap(v, zero) - nothing)
        mine = by_source[ends[row] : ends[row + 1]]
        lengths = starts[terms[mine] + 1] - starts[terms[mine]]
        upto = np.cumsum(lengths)
        first = 0
        while first < len(mine):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + chunk, "right")))
            part, long = mine[first:last], lengths[first:last]
            at = np.repeat(starts[terms[part]] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            peer, q, own = sources[at], p[at], np.repeat(p[part], long)
            np.add.at(sums, peer, _gap(own, q) - _gap(own, zero[peer]) - _gap(zero[row], q) + nothing[peer])
            first = last
        yield int(row), sums


def divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 10, ranks: int = 10, index_rows: tuple[int, int] = (1 << 14, 1 << 21), block: int = 256
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank`` for every group that occurs.

    Part ``pair``: ``item`` is each other source of the language, ``value`` the summed gap over the kept terms. Part ``term``: ``item``
    is a kept term that the group uses and more than its language does, ``value`` its gap to the language; ``ranks`` of them at most
    (a report of the highest). Ranks start at 1 per group and part, values descending, items in order of their UTF-8 bytes.
    Terms are runs of ASCII letters (lower-cased) and characters above ASCII; those in ``least`` documents of a language are kept.

    A task's index holds as many postings as there are pairs of sources, within ``index_rows``, so partial rows never outnumber
    postings; it accumulates ``block`` groups. Memory is bounded by these, however many rows one source or language has.

    Null text, language and source count as ''. A group without (kept) terms has its pairs, with the zero baseline for every term; in
    a language without kept terms all values are 0. Repeated rows count as often as they occur, very long texts cost their length
    (and one term may be as long as its text), an empty table gives no rows; other columns are not read. A group of
    9 x 10^15 words raises an error.
    """
    source = docs.select(*(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(y) for x, y in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    low, high = index_rows

    def accumulate(key, postings: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        lang, blocks, n_kept, lang_words = (groups.column(x)[0].as_py() for x in ("lang", "blocks", "n_kept", "lang_words"))
        names, words = groups.column("source").combine_chunks(), groups.column("words").to_numpy()
        rows = np.arange(key[2].as_py(), len(names), blocks)
        found_terms = pc.unique(postings.column("term").combine_chunks())
        found_terms = found_terms.take(pc.sort_indices(found_terms))
        terms = pc.index_in(postings.column("term"), found_terms).to_numpy().astype(np.int64)
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        sources = pc.index_in(postings.column("source"), names).to_numpy().astype(np.int64)[order]
        n = postings.column("n").to_numpy()[order]
        out: list[tuple[int, str, pa.Array, np.ndarray]] = []
        if n_kept:
            p, zero = smoothed(n, words[sources] + 2 * n_kept), smoothed(np.zeros_like(words), words + 2 * n_kept)
            sums = row_accumulation(terms, sources, p, zero, len(found_terms), rows)
            in_lang = np.zeros(len(found_terms), np.int64)
            np.add.at(in_lang, terms, n)
            q = smoothed(in_lang, np.int64(lang_words + 2 * n_kept))[terms]
            value = _gap(p, q)
            over = np.flatnonzero(p > q)
            over = over[np.lexsort((terms[over], -value[over], sources[over]))]
            begin = np.searchsorted(sources[over], rows)
            for row, at in zip(rows, begin, strict=True):
                best = over[at : at + ranks]
                best = best[sources[best] == row]
                out.append((row, "term", found_terms.take(pa.array(terms[best])), value[best]))
        else:
            sums = ((int(row), np.zeros(len(names), np.int64)) for row in rows)
        for row, total in sums:
            others = np.delete(np.arange(len(names)), row)
            out.append((row, "pair", names.take(pa.array(others)), total[others]))
        columns = {"lang": pa.array([lang] * sum(len(x[3]) for x in out), pa.string())}
        columns["source"] = pa.concat_arrays([names.take(pa.array(np.repeat(x[0], len(x[3])))) for x in out] or [names[:0]])
        columns["part"] = pa.concat_arrays([pa.array([x[1]] * len(x[3]), pa.string()) for x in out] or [names[:0]])
        columns["item"] = pa.concat_arrays([x[2] for x in out] or [names[:0]])
        columns["value"] = pa.array(np.concatenate([x[3] for x in out] or [words[:0]]), pa.int64())
        return pa.table(columns)

    with Scratch(docs.sparkSession, "divergence") as tmp:
        # One shuffle, by language and term, serves the counts of a group and the number of documents of a language.
        counted = source.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
        counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        kept = counted.select("*", F.sum("docs").over(of_term).alias("spread"), (F.min("source").over(of_term) == F.col("source")).alias("first"))
        kept = tmp.keep(kept.filter(F.col("term").isNull() | (F.col("spread") >= least)).select("lang", "source", "term", "n", "first"), "kept")
        is_term = F.col("term").isNotNull()
        size = F.least(F.greatest(F.count_if(~is_term) * F.count_if(~is_term), F.lit(low)), F.lit(high))
        langs = kept.groupBy("lang").agg(
            F.count_if(is_term & F.col("first")).alias("n_kept"),
            F.sum("n").alias("lang_words"),
            F.greatest(F.ceil(F.count_if(is_term) / size), F.lit(1)).cast("int").alias("parts"),
            F.ceil(F.count_if(~is_term) / block).cast("int").alias("blocks"),
        )
        langs = tmp.keep(langs, "langs")
        each_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("row_block")
        dealt = salted_join(kept.filter(is_term).select("lang", "source", "term", "n"), langs, ["lang"], "term")
        dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("index_part"), each_block, "source", "term", "n")
        groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("words")).join(langs, "lang")
        groups = groups.select("lang", "source", "words", "blocks", "n_kept", "lang_words", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("index_part"))
        groups = groups.select("lang", "index_part", each_block, "source", "words", "blocks", "n_kept", "lang_words")
        key = ["lang", "index_part", "row_block"]
        dealt, groups = (x.toDF(*x.columns) for x in (dealt, groups))  # both come from ``kept``
        partial = dealt.groupBy(*key).cogroup(groups.groupBy(*key)).applyInArrow(accumulate, "lang string, source string, part string, item string, value long")
        found = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
        return stored(found.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= ranks)), "divergence-groups")
