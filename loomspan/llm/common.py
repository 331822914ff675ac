"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, else the context's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; these operators write tables there")
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a cut in the lineage that survives lost executors.

    The table stays, since the result reads it; tables that only steps on the way read belong in a :class:`Scratch`.
    """
    return _written(df, fresh_dir(df.sparkSession, name))


class Scratch:
    """Tables in the shared folder that are removed at the end of the ``with`` block, or sooner by :meth:`drop`."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, fresh_dir(spark, name), {}

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{name}"
        table = _written(df, path)
        self.paths[path] = table  # also holds the table, so that its identity stays its own
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove these tables now; nothing may read them later."""
        for path, held in self.paths.items():
            if any(held is t for t in tables):
                self._remove(path)

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished steps, which it does once the driver has collected its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def __exit__(self, *_) -> None:
        self._remove(self.root)


def spare(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges: a table that grows with the input is never gathered in the driver, however small its files."""
    return df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], by: str, salts: int = 16) -> DataFrame:
    """Inner join in which the rows of one key of ``big`` are dealt by hash of ``by`` to ``salts`` tasks; ``small`` is repeated as often."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(large(right), [*on, "_salt"]).drop("_salt")


def told_apart(df: DataFrame, key: Column, asked: DataFrame, name: str, bits: int = 24) -> DataFrame:
    """``df`` with a boolean ``name``: false only where no row of ``asked`` has the same ``key``, a hash made of columns of either table.

    The keys asked for mark places of a bitmap, whose words are broadcast: at most 2 to the power of ``bits - 6`` rows (262,144), however
    large the tables. With more keys asked for than places it is true more often, so what is asked is joined with the rows of true in any case.
    """
    place = key.bitwiseAND(F.lit((1 << bits) - 1))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = asked.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = df.withColumns({"_at": word, "_mark": bit}).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return found.select(*df.columns, F.coalesce(F.col("_bits").bitwiseAND(F.col("_mark")) != 0, F.lit(False)).alias(name))


def sieve(df: DataFrame, key: Column, asked: DataFrame) -> DataFrame:
    """``df`` without the rows that :func:`told_apart` rules out, so that few others move in the join with ``asked`` that follows."""
    return told_apart(df, key, asked, "_asked").filter("_asked").drop("_asked")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; one of fewer splits than the cluster has cores is dealt out, so that all of them work."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def word_count(text: Column) -> Column:
    """Number of words of a text column; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_slices(batches: Iterator[pa.RecordBatch], text_index: int, max_chars: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows of about ``max_chars`` of text (one longer text is a run of its own); null texts become empty."""
    for batch in batches:
        texts = batch.column(text_index)
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_chars:
                yield batch.slice(start, i - start), [x or "" for x in texts.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start), [x or "" for x in texts.slice(start).to_pylist()]
