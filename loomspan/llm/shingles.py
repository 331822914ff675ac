"""Hashes of word shingles, and an order of all shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import text_slices

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(h: np.ndarray) -> np.ndarray:
    """Another hash of each hash, for a further independent view (the finaliser of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; a text of fewer words is one shingle, one of none has none."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    joined, n = b" ".join(words), len(words)
    k = min(shingle, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[i:j], seed) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def common_shingles(texts: DataFrame, shingle: int, every: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that three texts or more of a sample (one in ``every`` by hash) have, sorted, and in how many.

    Only the ``most`` frequent are told. They order shingles; another sample changes the work, not the result.
    """

    def run(batches):
        for _, part in text_slices(batches, 0):
            found, n = np.unique(np.concatenate([np.unique(shingle_hashes(t, shingle)) for t in part]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["h", "n"])

    taken = texts.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counted = taken.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2")
    top = counted.orderBy(F.col("n").desc(), "h").limit(most).toArrow()
    hashes, times = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], times[order]


def rare_first(hashes: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A set of shingle hashes in one order of all shingles, seldom ones first."""
    rank = np.zeros(len(hashes), np.int64)
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.lexsort((mixed(hashes), rank))]
