"""Token ids as Arrow IPC files of fixed-size-list batches.

A shard file holds ``ids``, a fixed-size list of ``seq_len`` ids, and ``mask``, which of them are real, in record
batches of equal length: sequence i is row ``i % batch`` of batch ``i // batch``, and a memory map gives its ids and
mask without a copy. Documents follow one another in ascending id through the shards and within each; only a shard's
last sequence is padded. Beside each shard an index file has a row per document with its first id's place and length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import WORD, text_slices

_MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_sequences long"


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


#: Latin-1 in lower case, as Unicode does it; 0xD7 is no letter.
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_OTHER = re.compile(rb"[\x1c-\x1f\x80-\xbf\xd7\xf7]")
_WORDS = re.compile(WORD).findall
_RUNS = re.compile(rb"[a-z\xc0-\xff]+|[^\sa-z\xc0-\xff]+").findall
_RUNS_QUOTED = re.compile(rb"[^\s']*'\S*|[a-z\xc0-\xff]+|[^\sa-z\xc0-\xff']+").findall


def chunks(text: str) -> list[bytes | str]:
    """A text in pieces that the tokenizer surely treats apart, in its own case folding where that is sure too.

    White space always parts. Where a text has only Latin-1 letters and ASCII, and no special token can be in it, runs of
    letters part from the rest as well, except around an apostrophe.
    """
    if "<|" not in text:
        try:
            latin = text.encode("latin-1")
        except UnicodeEncodeError:
            return _WORDS(text)
        if not _OTHER.search(latin):
            low = latin.translate(_LOWER)
            return (_RUNS_QUOTED if b"'" in low else _RUNS)(low)
    return _WORDS(text)


#: What a tokenizer file must hold so that :func:`chunks` is sure.
_SURE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SURE_NORMALIZERS = {"NFC", "Lowercase", "Replace"}


def parts_surely(path: str) -> bool:
    """Whether a tokenizer file folds case, drops white space and parts letters from the rest in the form that :func:`chunks` relies on."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda part, name: (part or {}).get(name, [part] if part else [])
    normal, words = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    folds = {x["type"] for x in normal} <= _SURE_NORMALIZERS and any(x["type"] == "Lowercase" for x in normal)
    spaces = all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in normal if x["type"] == "Replace")
    splits = bool(words) and words[0]["type"] == "Split" and words[0]["pattern"] == {"Regex": _SURE_WORDS} and (words[0]["behavior"], words[0]["invert"]) == ("Removed", True)
    rest = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in words[1:])
    special = all(x["content"].startswith("<|") for x in spec["added_tokens"])
    return folds and spaces and splits and rest and special and not spec.get("truncation") and not spec.get("padding")


class WordTokenizer:
    """A tokenizers-library file applied to texts: each distinct chunk once where the file :func:`parts_surely`, else whole texts."""

    def __init__(self, path: str, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.by_chunks = Tokenizer.from_file(path), most, parts_surely(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._forget()

    def _forget(self) -> None:
        self.number, self.known = _Numbers(), 0
        self.ids, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (with the end as last)."""
        if not self.by_chunks:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        if self.known > self.most:
            self._forget()
        number = self.number.__getitem__
        each = [np.fromiter(map(number, chunks(t)), np.int32) for t in texts]
        new = list(islice(reversed(self.number), len(self.number) - self.known))[::-1]
        for i in range(0, len(new), 20_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([x if isinstance(x, str) else x.decode("latin-1") for x in new[i : i + 20_000]], add_special_tokens=False)]
            sizes = np.cumsum([len(x) for x in found])
            flat = np.fromiter((y for x in found for y in x), np.uint32, int(sizes[-1]))
            self.ids = np.concatenate([self.ids, flat])
            self.begin = np.concatenate([self.begin, sizes + self.begin[-1]])
        self.known = len(self.number)
        used = np.concatenate(each) if each else np.empty(0, np.int32)
        begin = self.begin[used]
        counts = self.begin[used + 1] - begin
        ends = np.cumsum(counts)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)
        return self.ids[take], np.concatenate([[0], ends])[np.cumsum([0, *map(len, each)])]


@lru_cache(maxsize=1)
def _loaded(path: str, changed_ns: int, size: int) -> WordTokenizer:
    return WordTokenizer(path)


def shared_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file as it is now, kept with the chunks that it knows for the next tasks of this Python worker."""
    at = os.stat(path)
    return _loaded(path, at.st_mtime_ns, at.st_size)


def _open_dir(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pyarrow.fs.LocalFileSystem(), uri)


class ShardWriter:
    """Writes one shard under a name of its own attempt; it counts only once the manifest names it."""

    def __init__(self, out_dir: str, name: str, seq_len: int, batch: int, dtype: str):
        self.fs, base = _open_dir(out_dir)
        self.fs.create_dir(base, recursive=True)
        self.seq_len, self.batch, self.dtype = seq_len, batch, np.dtype(dtype)
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(value, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.stream = self.fs.open_output_stream(f"{base}/{name}.arrow")
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = self.n_sequences = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        full = self.seq_len * self.batch
        if self.n_held >= full:
            flat = np.concatenate(self.held)
            for i in range(0, len(flat) - full + 1, full):
                self._write(flat[i : i + full], full)
            rest = len(flat) % full
            self.held, self.n_held = [flat[len(flat) - rest :].copy()], rest

    def _write(self, ids: np.ndarray, real: int) -> None:
        rows = len(ids) // self.seq_len
        mask = pa.array(np.arange(len(ids)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.seq_len) for x in (pa.array(ids), mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += rows

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            self._write(np.pad(flat, (0, -len(flat) % self.seq_len)), len(flat))
        self.file.close()
        self.stream.close()


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    seq_len: int = 2048,
    batch: int = 64,
    shards: int | None = None,
) -> DataFrame:
    """Encode the texts, an ``end_id`` after each, into shard files below ``out_dir``; returns the manifest as written.

    ``out_dir`` is a URI that all executors reach (Arrow opens file, hdfs, s3 and gs). Shards are ranges of ids of about
    equal rows. A null id comes last; repeated ids lie side by side, ordered by a hash of the text; a null or empty text
    is its end id alone; an empty table gives empty shards; other columns are not read. The ids' type is the smallest
    unsigned one that holds the vocabulary. Ids must be of an integral type, others raise an error before any work. A very long text is
    encoded in one piece of memory by one task. There are at least as many shards as shuffle partitions, and one per 512 MB of text, which a first pass sums.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} is of type {kind.simpleString()}; token files hold ids of an integral type")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), source.agg(F.ceil(F.sum(F.octet_length("text")) / (512 << 20))).first()[0] or 0)
    dealt = source.repartitionByRange(n, F.col("id").asc_nulls_last()).sortWithinPartitions(F.col("id").asc_nulls_last(), F.xxhash64("text"))

    def run(batches):
        tokenizer, task = shared_tokenizer(tokenizer_path), TaskContext.get()
        dtype = "uint16" if max(tokenizer.vocabulary, end_id + 1) <= 1 << 16 else "uint32"
        shard = task.partitionId()
        name = f"shard-{shard:06d}-{task.taskAttemptId()}"
        out, ids, sizes = ShardWriter(out_dir, name, seq_len, batch, dtype), [], []
        for part, texts in text_slices(batches, 1):
            flat, begin = tokenizer(texts)
            out.add(np.insert(flat, begin[1:], end_id))
            ids.append(part.column(0))
            sizes.append(np.diff(begin) + 1)
        out.close()
        size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        index = pa.table({"id": pa.chunked_array(ids, pa.int64()), "start": np.cumsum(size) - size, "n_tokens": size})
        with out.fs.open_output_stream(f"{_open_dir(out_dir)[1]}/{name}.index") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_docs": [len(size)], "n_tokens": [out.n_tokens], "n_sequences": [out.n_sequences]})

    dealt.mapInArrow(run, _MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifest")


class Shard:
    """Random access to one shard file; views into the map where the file system has one."""

    def __init__(self, out_dir: str, name: str):
        fs, base = _open_dir(out_dir)
        at = f"{base}/{name}"
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(f"{at}.arrow") if local else fs.open_input_file(f"{at}.arrow"))
        self.index = pa.ipc.open_file(pa.memory_map(f"{at}.index") if local else fs.open_input_file(f"{at}.index")).read_all()
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self._held: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _batch(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            self._held = k, self.file.get_batch(k).column(0).flatten().to_numpy()
        return self._held[1]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of the i-th sequence."""
        batch = self.file.get_batch(i // self.rows)
        k = i % self.rows
        ids = batch.column(0).flatten().to_numpy()[k * self.seq_len : (k + 1) * self.seq_len]
        return ids, batch.column(1).flatten().slice(k * self.seq_len, self.seq_len)

    def ids(self, start: int, n: int):
        """The ids from a place on, as views in at most one piece a batch."""
        full = self.seq_len * self.rows
        while n > 0:
            k, at = divmod(start, full)
            piece = self._batch(k)[at : at + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """Every document as the files have it: ``id, start, n_tokens, ids_crc32, shard``.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over its ids as little-endian 32-bit numbers.
    The driver sees one row a shard.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{out_dir}/manifest").orderBy("shard").collect()
    before = [0, *accumulate(r["n_tokens"] for r in manifest)]
    rows = [(r["shard"], r["file"], b) for r, b in zip(manifest, before)]
    shards = spark.createDataFrame(rows, "shard int, file string, before long").repartition(max(1, len(rows)), "shard")

    def run(batches):
        for part in batches:
            for shard, name, first in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                held = Shard(out_dir, name)
                start, size = held.index["start"].to_numpy(), held.index["n_tokens"].to_numpy()
                crcs = np.zeros(len(size), np.int64)
                for i, (a, k) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
                    crc = 0
                    for piece in held.ids(a, k):
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    crcs[i] = crc
                table = pa.table({"id": held.index["id"], "start": start + first, "n_tokens": size, "ids_crc32": crcs, "shard": pa.array(np.full(len(size), shard), pa.int32())})
                yield from table.to_batches()

    return shards.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, shard int")
