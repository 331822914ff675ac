"""Outputs and reports: rows as JSON lines or CSV, telemetry records, hub storage, price lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.cost import PRICE_SCHEMA


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns."""

    def names(schema: T.StructType, prefix: str = "") -> list[str]:
        found = []
        for f in schema:
            found += names(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else [prefix + f.name]
        return found

    return df.select(*(F.col(n).alias(n) for n in names(df.schema)))


def picked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by dotted name, in the asked order; unknown names are an error."""
    flat = flattened(df)
    missing = [c for c in columns if c not in flat.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(flat.columns)}")
    return flat.select(*(F.col(f"`{c}`") for c in columns))


def write_rows(df: DataFrame, path: str, form: str = "jsonl") -> None:
    """jsonl, csv (flattened, with a header) or parquet."""
    if form == "jsonl":
        df.write.mode("overwrite").json(path)
    elif form == "csv":
        flat = flattened(df)
        flat.select(*(F.col(f"`{n}`").cast("string").alias(n) for n in flat.columns)).write.mode("overwrite").csv(path, header=True)
    elif form == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"{form!r}: jsonl, csv or parquet")


def span_rows(calls: DataFrame) -> DataFrame:
    """Tool calls as telemetry spans with ids that follow from their content, one trace per session and turn."""
    trace = F.substring(F.sha2(F.concat_ws("/", F.col("session"), F.col("turn")), 256), 1, 32)
    span = F.substring(F.sha2(F.concat_ws("/", F.col("session"), F.col("seq")), 256), 1, 16)
    return calls.select(
        trace.alias("traceId"), span.alias("spanId"), F.concat(F.lit("execute_tool "), "tool").alias("name"),
        (F.col("t_ms") * 1_000_000).alias("startTimeUnixNano"), ((F.col("t_ms") + F.coalesce("ms", F.lit(0))) * 1_000_000).alias("endTimeUnixNano"),
        F.map_filter(F.create_map(F.lit("gen_ai.operation.name"), F.lit("execute_tool"), F.lit("gen_ai.tool.name"), F.col("tool"), F.lit("error.type"), F.when(F.col("err"), "tool_error")), lambda k, v: v.isNotNull()).alias("attributes"),
    )


def otlp_batches(spans: DataFrame, per_request: int = 500) -> DataFrame:
    """Request bodies as JSON, at most ``per_request`` spans each and one trace together where it fits."""
    cell = F.pmod(F.xxhash64("traceId"), F.greatest(F.lit(1), F.ceil(F.lit(spans.count()) / F.lit(per_request))))
    n = F.floor((F.row_number().over(Window.partitionBy("_c").orderBy("traceId", "startTimeUnixNano", "spanId")) - 1) / per_request)
    dealt = spans.withColumn("_c", cell).withColumn("_n", n)
    return dealt.groupBy("_c", "_n").agg(F.to_json(F.struct(F.collect_list(F.struct(*spans.columns)).alias("spans"))).alias("body"), F.count(F.lit(1)).alias("n")).drop("_c", "_n")


def scrubbed(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Content keys dropped from the attributes."""
    return spans.withColumn("attributes", F.map_filter("attributes", lambda k, v: ~k.isin(keys)))


def decode_otlp(lines: DataFrame) -> DataFrame:
    """OTLP/JSON trace requests, one a line, to span rows."""
    value = "struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>"
    span = f"struct<traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string, attributes: array<struct<key: string, value: {value}>>>"
    schema = f"resourceSpans array<struct<resource: struct<attributes: array<struct<key: string, value: {value}>>>, scopeSpans: array<struct<spans: array<{span}>>>>>"
    rows = lines.select(F.from_json("line", schema).alias("r")).select(F.explode("r.resourceSpans").alias("rs"))
    one = lambda a: F.map_from_entries(F.transform(a, lambda x: F.struct(x["key"], F.coalesce(x["value"]["stringValue"], x["value"]["intValue"], x["value"]["boolValue"].cast("string"), x["value"]["doubleValue"].cast("string")))))
    flat = rows.select(one(F.col("rs.resource.attributes")).alias("resource"), F.explode(F.flatten("rs.scopeSpans.spans")).alias("s"))
    a = one(F.col("s.attributes"))
    t = lambda c: F.timestamp_micros(F.floor(F.col(c).cast("long") / 1000))
    return flat.withColumn("a", a).select(
        F.col("resource")["host.name"].alias("host"), F.coalesce(F.col("a")["gen_ai.conversation.id"], F.col("resource")["session.id"]).alias("session"), F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"),
        F.nullif("s.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("a")["gen_ai.operation.name"].alias("operation"), F.col("a")["error.type"].alias("error_type"),
        F.col("a")["gen_ai.usage.input_tokens"].cast("long").alias("input_tokens"), F.col("a")["gen_ai.usage.output_tokens"].cast("long").alias("output_tokens"), t("s.startTimeUnixNano").alias("start_time"), t("s.endTimeUnixNano").alias("end_time"),
    )


def write_by_day(df: DataFrame, path: str, day: str = "day") -> None:
    """Hub storage: a folder a day; retention drops folders, a rewrite replaces only the days it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def price_rows(spark: SparkSession, text: str, layer: str = "user") -> DataFrame:
    """A price file (JSON; // comments allowed) as price rows: prefix to rates per million, or to an alias."""
    bare = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("//"))
    rows = []
    for prefix, p in json.loads(bare).items():
        if "alias" in p:
            rows.append(("alias", None, prefix.lower(), None, None, None, None, None, p["alias"]))
        elif "input" in p:
            rate = lambda k, p=p: float(p[k]) if k in p else None
            rows.append((layer, None, prefix.lower(), rate("input"), rate("output"), rate("cacheRead"), rate("cacheWrite"), rate("cacheWrite1h"), None))
    return spark.createDataFrame(rows, PRICE_SCHEMA)
