"""Byte-level BPE encoding with a hierarchical-bitmap rank queue, and decoding.

All pre-tokens of a batch of documents are laid end to end in one linked list of symbols. Every adjacent pair that has
a merge rank is a position in the bucket of that rank; a bitmap tree over the ranks tells by find-first-set which bucket
comes next. A popped bucket drops its stale positions (their pair has changed since), merges the others at once as
arrays, and puts the new neighbours' pairs into their buckets. Some ranks may not be merged at once, as a merge of theirs can
bring a pair that comes first; of these a bucket gives the first position of each pre-token at a time and keeps the others in
heaps. So the time grows with the length of a pre-token (and the logarithm of it), however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import text_slices

_EMPTY = np.empty(0, np.int64)
_NO_SLOTS = np.empty(0, np.int32)


class RankBitmap:
    """A set of ranks as a tree of 64-bit words; the smallest member is found by first set bits from the root down."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, rank: int) -> None:
        for level in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            if level[rank] & bit:
                return
            level[rank] |= bit

    def discard(self, rank: int) -> None:
        for level in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            level[rank] &= ~bit
            if level[rank]:
                return

    def first(self) -> int:
        """The smallest rank, or -1."""
        if not self.levels[-1][0]:
            return -1
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        return rank


class BytePairs:
    """A vocabulary of byte strings with ranks (ids), and what merging needs of it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = self.none = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * n
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made, sooner = [], [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(rank)
                # A longer token of lower rank starts or ends with a or b: after merging one of these, its pairs may come before the others of its rank.
                sooner.update(x for x in (a, b) if x is not None and x > rank)
        keys = np.array(left, np.int64) * (n + 1) + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, np.int32)[order]
        self.one_by_one = np.zeros(n, bool)
        self.one_by_one[list(sooner)] = True
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; ``none`` where no token is made of it."""
        if not len(self.keys):
            return np.full(len(left), self.none, np.int32)
        keys = left.astype(np.int64) * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], np.int32(self.none))

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and where each piece's ids begin (with the end as last)."""
        n, none = len(pieces), self.none
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        todo = [p for p, w in zip(pieces, whole.tolist(), strict=True) if w < 0]
        counts = np.where(whole >= 0, 1, 0)
        ids = _EMPTY
        if todo:
            sizes = np.fromiter(map(len, todo), np.int64, len(todo))
            ends = np.cumsum(sizes + 1) - 1  # each piece is followed by a slot that pairs with nothing
            symbols = np.full(int(ends[-1]) + 1, none, np.int32)
            inside = np.ones(len(symbols), bool)
            inside[ends] = False
            symbols[inside] = self.byte[np.frombuffer(b"".join(todo), np.uint8)]
            alive = self._merge(symbols, np.repeat(np.arange(len(todo), dtype=np.int32), sizes + 1))
            stays = alive & inside
            ids = symbols[stays]
            counts[whole < 0] = np.diff(np.concatenate([[0], np.cumsum(stays)[ends]]))
        begin = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(begin[-1]), np.int64)
        known = np.repeat(whole >= 0, counts)
        out[known], out[~known] = whole[whole >= 0], ids
        return out, begin

    def _merge(self, symbols: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merge in place; returns which slots are left."""
        size, none = len(symbols), self.none
        after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        alive = np.ones(size, bool)
        rank = np.full(size, none, np.int32)  # of the pair that starts at a slot
        rank[:-1] = self.pair_rank(symbols[:-1], symbols[1:])
        merged = np.zeros(size, bool)  # the slots of the current step, else clear
        buckets: dict[int, list[np.ndarray]] = {}
        queue = RankBitmap(none + 1)

        def put(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r < none], r[r < none]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for one, part in zip(r[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                held = buckets.get(one)
                if held is None:
                    buckets[one] = [part]
                    queue.add(one)
                else:
                    held.append(part)

        put(np.arange(size, dtype=np.int32))
        waiting: dict[int, dict[int, list[int]]] = {}  # by rank and piece, heaps of positions
        while (r := queue.first()) >= 0:
            held = buckets.pop(r, None)
            queue.discard(r)
            if held is not None:
                at = np.sort(np.concatenate(held)) if len(held) > 1 else held[0]
                at = at[alive[at] & (rank[at] == r)]  # the others are stale
            else:
                at = _NO_SLOTS
            if self.one_by_one[r] and (len(at) > 1 or r in waiting):
                heaps = waiting.setdefault(r, {})
                at = self._first_of_each(at, piece, heaps, lambda x, r=r: alive[x] and rank[x] == r)
                if heaps:
                    queue.add(r)
                else:
                    del waiting[r]
            elif len(at) > 1:  # of pairs that overlap in a row, every other one from the left
                tied = after[at[:-1]] == at[1:]
                if tied.any():
                    starts = np.concatenate([[True], ~tied])
                    run = np.flatnonzero(starts)
                    nth = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))
                    at = at[nth % 2 == 0]
            if not len(at):
                continue
            if len(at) == 1:  # the same without arrays
                one = int(at[0])
                lost = int(after[one])
                beyond, prior = int(after[lost]), int(before[one])
                symbols[one], alive[lost], rank[lost] = r, False, none
                after[one], before[beyond] = beyond, one
                for x, y in ((one, beyond), (prior, one)):
                    if x >= 0:
                        key = int(symbols[x]) * (none + 1) + int(symbols[y])
                        k = int(self.keys.searchsorted(key))
                        rank[x] = made = int(self.made[k]) if k < len(self.keys) and self.keys[k] == key else none
                        if made < none:
                            if made not in buckets:
                                buckets[made] = []
                                queue.add(made)
                            buckets[made].append(np.array([x], np.int32))
                continue
            gone = after[at]
            symbols[at] = r
            alive[gone] = False
            rank[gone] = none
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at  # a closing slot follows every piece, so there is always one
            prior = before[at]
            merged[at] = True
            prior = prior[(prior >= 0) & ~merged[prior]]
            merged[at] = False
            rank[at] = self.pair_rank(symbols[at], symbols[beyond])
            rank[prior] = self.pair_rank(symbols[prior], symbols[after[prior]])
            put(np.concatenate([at, prior]))
        return alive

    @staticmethod
    def _first_of_each(at: np.ndarray, piece: np.ndarray, heaps: dict[int, list[int]], fresh) -> np.ndarray:
        """The first fresh position of each piece, of the sorted ``at`` and of ``heaps``, which keep the others."""
        chosen = []
        if len(at):
            cuts = np.flatnonzero(np.diff(piece[at])) + 1
            starts = np.concatenate([[0], cuts, [len(at)]]).tolist()
            listed, owners = at.tolist(), piece[at].tolist()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                heap = heaps.get(owners[a])
                if heap is not None:
                    for x in listed[a:b]:
                        heapq.heappush(heap, x)
                elif b - a > 1:
                    heaps[owners[a]] = listed[a:b]  # sorted, so a heap
                else:
                    chosen.append(listed[a])
        for owner, heap in list(heaps.items()):
            while heap:
                x = heapq.heappop(heap)
                if fresh(x):
                    chosen.append(x)
                    break
            if not heap:
                del heaps[owner]
        return np.array(sorted(chosen), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load_ranks(path: str) -> BytePairs:
    """A rank file: base64 token and rank on each line. Read where the tasks run; ``path`` may be any URI that Arrow opens."""
    if "://" in path:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        data = fs.open_input_stream(inner).read()
    else:
        with open(path, "rb") as f:
            data = f.read()
    return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})


class _Numbers(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class TextEncoder:
    """Encodes texts by the matches of a pattern; equal pre-tokens are merged once and remembered up to ``most`` of them."""

    def __init__(self, pairs: BytePairs, pattern: str, most: int = 400_000):
        self.pairs, self.split, self.most = pairs, regex.compile(pattern).findall, most
        self._forget()

    def _forget(self) -> None:
        self.number, self.known = _Numbers(), 0
        self.ids, self.begin = np.empty(0, np.int32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (with the end as last)."""
        if self.known > self.most:
            self._forget()
        number = self.number.__getitem__
        each = [np.fromiter(map(number, self.split(t)), np.int32) for t in texts]
        new = list(islice(reversed(self.number), len(self.number) - self.known))[::-1]
        if new:
            ids, begin = self.pairs.encode([p.encode("utf-8", "surrogatepass") for p in new])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.begin = np.concatenate([self.begin, begin[1:] + self.begin[-1]])
            self.known = len(self.number)
        used = np.concatenate(each) if each else np.empty(0, np.int32)
        begin = self.begin[used]
        counts = self.begin[used + 1] - begin
        ends = np.cumsum(counts)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)
        return self.ids[take], np.concatenate([[0], ends])[np.cumsum([0, *map(len, each)])]


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", same_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``, an array of the text's ids, as its last column (one of that name is replaced).

    ``same_col`` adds, after it, whether the decoded ids are the text's bytes; both are made in one pass, slice by slice.

    A null or empty text has no ids. Rows, repeated or not, are encoded one by one; an empty table gives an empty one;
    other columns pass through unread. Memory: some million characters of text at a time, or one longer text.
    """
    rest = [c for c in docs.columns if c not in (ids_col, same_col)]
    source = docs.select(*rest)
    at = rest.index(text_col)
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(same_col, T.BooleanType())] if same_col else [])]
    schema = T.StructType([*source.schema.fields, *added])

    def run(batches):
        encoder = TextEncoder(load_ranks(ranks_path), pattern)  # what it remembers goes with the task
        for batch, texts in text_slices(batches, at, 1 << 20):
            ids, begin = encoder(texts)
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))]
            if same_col:
                cuts = zip(begin[:-1].tolist(), begin[1:].tolist(), texts, strict=True)
                columns.append(pa.array([encoder.pairs.decode(ids[a:b].tolist()) == t.encode("utf-8", "surrogatepass") for a, b, t in cuts], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks_path: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col``, the bytes that the ids stand for; null ids give no bytes. Other columns pass through."""
    rest = [c for c in docs.columns if c != bytes_col]
    source = docs.select(*rest)
    at = rest.index(ids_col)

    def run(batches):
        pairs = load_ranks(ranks_path)
        for batch in batches:
            out = [pairs.decode(x.as_py() or ()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*rest, bytes_col])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding: rows ``id, n_tokens, ids_sha256, decoded_sha256``, one per input row.

    Ids and bytes of a slice of texts are made, digested and dropped inside the task. Cases as in :func:`encode`.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches):
        encoder = TextEncoder(load_ranks(ranks_path), pattern)  # what it remembers goes with the task
        pairs = encoder.pairs
        names = [str(i) for i in range(pairs.none)]
        for batch, texts in text_slices(batches, 1, 1 << 22):
            ids, begin = encoder(texts)
            listed, digested, decoded = ids.tolist(), [], []
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                own = listed[a:b]
                digested.append(hashlib.sha256(",".join(map(names.__getitem__, own)).encode()).hexdigest())
                decoded.append(hashlib.sha256(pairs.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begin), pa.int64()), pa.array(digested), pa.array(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
