"""Exact deduplication as a stateful stream.

A Structured Streaming aggregation keyed by content digest keeps, for every digest ever seen, the stable
identifier of the best row, a locator of its content (file and row number) and the group's size. The state is in
RocksDB, on disk, and has no watermark, so it never expires. Rows are pre-aggregated before the shuffle, so a group
that holds a third of the input costs its reducer one row per map task. On hits the stored locator leads to the
kept row's content and full normalised bytes are compared; digests of which any pair differs are regrouped by text.
The bytes of all micro-batches' hits are compared in one pass at the end: the kept rows of a batch's hits lie all over the
earlier files, so a comparison in every batch would read the whole corpus once a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import SPACE, fresh_dir, stored

#: The state's settings: on disk; many small stores, so nothing is allocated ahead; rows are not counted, so puts need no reads.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per document with digest, order of preference and locator; only these leave the scan."""
    norm = normalised(F.col(text_col))
    return df.select(
        F.col(id_col).alias("id"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("length"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"),
    )


def _preference() -> Column:
    """Smallest is kept: most code points, then smallest id (null last), then first in the files."""
    return F.struct((-F.col("length")).alias("neg_length"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("locator"))


def stream_groups(source: DataFrame, out_dir: str, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> None:
    """Run the stream until the source has no more files, writing each micro-batch's changed groups.

    A batch that is retried overwrites its own folder; the checkpoint beside it lets a restarted driver go on.
    """
    spark = source.sparkSession
    groups = (
        _rows(source, id_col, text_col, digest)
        .groupBy("digest")
        .agg(F.min(_preference()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (
            groups.writeStream.outputMode("update")
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out_dir}/groups/batch={n}"))
            .option("checkpointLocation", f"{out_dir}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_dedup(
    spark: SparkSession,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    digest: Callable[[Column], Column] = sha256_hex,
    work_dir: str | None = None,
) -> DataFrame:
    """Group the Parquet rows below ``path`` by normalised text.

    Returns one row per input row: ``id, keep_id, group_size, kept, digest``. Of equal texts the row with the most
    code points in its original text stays, then the smallest id (a null id comes last), then the first in the files;
    so of repeated identical rows exactly one has ``kept``. A null text equals an empty one. An empty table gives no
    rows; other columns are not read, whatever their names. A very long text moves as one row.

    ``max_files_per_trigger`` or ``max_bytes_per_trigger`` bounds a micro-batch (of whole files; default: all there is). With a
    ``work_dir`` a later call takes up only the files that are new and gives the rows of all of them; its state is never dropped.
    ``digest`` may be weak: equality is always decided on full bytes.
    """
    work = work_dir or fresh_dir(spark, "exact-dedup")
    docs = spark.read.parquet(path)
    schema = docs.schema
    kind = docs.schema[id_col].dataType
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    elif max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    at = path.rstrip("/")  # as a pattern it may be one file or a folder; a plain path must be a folder
    stream_groups(reader.parquet(f"{at[:-1]}[{at[-1]}]"), work, id_col, text_col, digest)

    best = f"struct<neg_length:bigint,no_id:boolean,id:{kind.simpleString()},locator:struct<file:string,row:bigint>>"
    changes = spark.read.schema(f"digest string, best {best}, group_size bigint, batch bigint").parquet(f"{work}/groups")
    # A group's newest state wins; one batch has each group once.
    changes = changes.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("s")).select("digest", "s.*")
    groups = changes.select("digest", F.col("best.id").alias("keep_id"), F.col("best.locator").alias("keep_at"), "group_size")

    rows = _rows(docs, id_col, text_col, digest)
    # Content of the kept rows of groups with hits, fetched by locator.
    hit = groups.filter("group_size > 1").select(F.col("digest").alias("hit"), "keep_at")
    content = rows.select("locator", F.col("norm").alias("keep_norm")).join(hit, F.col("locator") == F.col("keep_at")).select("hit", "keep_norm", "keep_at")
    once = groups.join(content.select("hit", "keep_norm"), groups.digest == F.col("hit"), "left").drop("hit").withColumnRenamed("digest", "d")
    once = stored(once, "exact-dedup-kept")  # so that a large group's rows meet it in a join that Spark can split
    compared = rows.join(once, rows.digest == once.d, "inner").select(
        "id", "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept"), "digest", "locator",
        (F.col("keep_norm").isNull() | (F.col("norm") == F.col("keep_norm"))).alias("same"),
    )
    checked = stored(compared, "exact-dedup-checked")
    clash = checked.filter("NOT same").select("digest").distinct()
    if clash.isEmpty():
        return checked.drop("locator", "same")
    # Different texts under one digest: these few digests are grouped by their whole texts.
    torn = rows.join(clash, "digest", "left_semi")
    exact = torn.groupBy("digest", "norm").agg(F.min(_preference()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    regrouped = torn.select("id", "locator", "digest", "norm").join(exact, ["digest", "norm"]).select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("best.locator")).alias("kept"), "digest"
    )
    return checked.join(clash, "digest", "left_anti").select(regrouped.columns).unionByName(regrouped)
