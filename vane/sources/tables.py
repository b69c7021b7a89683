"""Typed scans: the driver's tables as metrics, logs, spans and probes; readers and writers of our own layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "name string, value double, timestamp timestamp, labels map<string,string>, seq bigint"
SPAN = "trace_id string, span_id string, parent_id string, name string, service string, start timestamp, duration_ns bigint, status string, attributes map<string,string>, seq bigint"
LOG = "timestamp timestamp, severity string, source string, message string, labels map<string,string>, severity_inferred boolean, seq bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(value):
    """NaN and infinities are refused at the door."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(finite(F.col("value"))).select(F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("timestamp"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), F.col("event_id").alias("seq"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    message = F.concat("event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), F.format_string("%.2f", "value"), F.lit(" "), "props")
    return e.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
        F.concat(F.lit("user"), (F.col("user_id") % 20).cast("string")).alias("source"),
        message.alias("message"),
        F.create_map(F.lit("type"), F.col("event_type")).alias("labels"),
        F.lit(False).alias("severity_inferred"),
        F.col("event_id").alias("seq"),
    )


def text_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines, named by doc_id and line; severity is declared where the document has a label."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lines = d.join(lab, "doc_id", "left").select("doc_id", "source", "toxic", "quality", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "message"))
    severity = F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warn").when(F.col("quality") == 1, "info")
    return lines.select("doc_id", "line", "source", "message", severity.alias("severity"), severity.isNull().alias("severity_inferred"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("span_id"), F.col("l_returnflag").alias("name"), F.col("o_orderpriority").alias("service"), F.col("l_extendedprice").alias("duration_ms"), F.col("l_shipdate").cast("timestamp").alias("start"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"))


def span_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), F.col("role").alias("name"), F.length("text").cast("long").alias("duration_ms"), F.lit("ok").alias("status"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 10).alias("target"), F.col("ts").cast("timestamp").alias("timestamp"), (F.col("event_type") != "error").cast("int").alias("up"))


def write_records(df: DataFrame, path: str, time_column: str = "timestamp") -> None:
    """Append a batch, partitioned by date so that windows and retention touch whole folders."""
    df.withColumn("date", F.to_date(time_column)).write.mode("append").partitionBy("date").parquet(path)


def read_records(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(f"{schema}, date date").parquet(path)
