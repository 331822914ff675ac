"""Quality rules: repetition by suffix array and longest-common-prefix intervals, beside counted base rules.

The words of a slice of documents are sorted as suffixes by prefix doubling (only suffixes that still share a prefix are
sorted again), each document against itself. The adjacent longest common prefixes are read from the doubling's ranks.
A suffix's deepest LCP interval is the longest substring at its place that occurs elsewhere in the document, so the spans
of the maximal repeated substrings are the union of these prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import text_slices

_WHITE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits. Base: at least ``min_words`` words, at most ``window_percent`` of them in repeated windows of ``window`` words.

    Method: repeats of ``repeat_words`` words or more may cover at most ``covered_percent`` of the words, and none may be
    longer than ``longest_words``.
    """

    min_words: int = 10
    window: int = 5
    window_percent: int = 20
    repeat_words: int = 10
    covered_percent: int = 20
    longest_words: int = 50


def longest_repeats(words: np.ndarray, sizes: np.ndarray, least: int = 1) -> np.ndarray:
    """For every place, how many words from it on occur at another place of the same document too.

    ``words`` are word numbers of documents laid end to end; ``sizes`` are the documents' lengths. Lengths under ``least`` may
    be given as 0.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    active, h, levels = order, 1, []
    base = np.zeros(n, np.int64)  # the rank at which the active suffix's old group starts
    sorted_key = key[order]
    while True:
        # ``active`` is sorted; equal keys share the rank of the first of them.
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        place = np.arange(len(active))
        if levels:
            old = np.concatenate([[True], base[1:] != base[:-1]])
            place = base + place - np.maximum.accumulate(np.where(old, place, 0))
        mine = place[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        rank[active] = mine
        levels.append(rank.copy())
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        active = active[shared]
        if not len(active):
            break
        follow = active + h
        inside = follow < end[active]
        second = np.where(inside, rank[np.where(inside, follow, 0)].astype(np.int64) + 1, 0)
        first = rank[active].astype(np.int64)
        sorted_key = first * (n + 1) + second
        order = np.argsort(sorted_key, kind="stable")
        active, sorted_key, base, h = active[order], sorted_key[order], first[order], h * 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    a, b = suffixes[:-1], suffixes[1:]
    # Level k tells prefixes of 2**k words; neighbours that differ in the last one that ``least`` covers are left out.
    told = levels[min(max(least, 1).bit_length() - 1, len(levels) - 1)]
    at = np.flatnonzero(told[a] == told[b])
    a, b, common = a[at], b[at], np.zeros(len(at), np.int64)
    for level, ranks in reversed(list(enumerate(levels))):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (ranks[np.where(inside, x, 0)] == ranks[np.where(inside, y, 0)])
        common += same.astype(np.int64) << level
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a span."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def per_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def measure(texts: list[str], rules: Rules) -> dict[str, np.ndarray]:
    """Counts and verdicts of a slice of texts."""
    number = _Numbers()
    each = [np.fromiter(map(number.__getitem__, t.encode("utf-8", "surrogatepass").split()), np.int64) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    words = np.concatenate(each) if each else np.zeros(0, np.int64)
    longest, n = longest_repeats(words, sizes, min(rules.window, rules.repeat_words)), len(words)
    at = np.flatnonzero(longest >= rules.window)
    in_windows = per_document(covered(at, np.full(len(at), rules.window), n), sizes)
    at = np.flatnonzero(longest >= rules.repeat_words)
    in_repeats = per_document(covered(at, longest[at], n), sizes)
    worst = np.zeros(len(texts), np.int64)
    np.maximum.at(worst, np.repeat(np.arange(len(texts)), sizes)[at], longest[at])
    lines = []
    for t in texts:
        full = [x for x in t.split("\n") if x.strip(_WHITE)] if "\n" in t else ()
        lines.append(len(full) - len(set(full)))
    base = (sizes < rules.min_words) | (100 * in_windows > rules.window_percent * sizes)
    fine = (100 * in_repeats <= rules.covered_percent * sizes) & (worst <= rules.longest_words)
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, _WHITE)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": in_windows,
        "base_failed": base,
        "kept": ~base & fine,
        "covered_words": in_repeats,
        "longest_repeat": worst,
    }


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Counts and verdict of every row: ``id`` and the columns of :func:`measure`.

    A null or empty text has no words and fails the base rule; repeated rows get equal results each; an empty table gives
    no rows; other columns are not read. Memory: some million characters of text at a time, or one longer text.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch, texts in text_slices(batches, 1):
            found = measure(texts, rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values())], ["id", *found])

    return source.mapInArrow(run, f"id {kind}, {_OUT}")


def accepted(docs: DataFrame, *, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose text the rules keep, all columns unchanged. Cases as in :func:`repetition_rules`."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch, texts in text_slices(batches, at):
            yield batch.filter(pa.array(measure(texts, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
