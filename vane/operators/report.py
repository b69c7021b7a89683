"""What a dashboard and its exports show: tables, status, ranges, bounded summaries, CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The ranges on offer and their seconds.
RANGES = [("15m", 900), ("1h", 3_600), ("6h", 21_600), ("24h", 86_400), ("7d", 604_800)]


def container_table(metrics: DataFrame, cpu: str, memory: str) -> DataFrame:
    """id, name, image, cpu, memory: the last values of every container_id label."""
    order = F.struct("timestamp", "seq")
    label = lambda k: F.min_by(F.col("labels")[k], F.when(F.col("labels")[k].isNotNull(), order))
    last = lambda n: F.max_by("value", F.when(F.col("name") == n, order))
    rows = metrics.withColumn("id", F.col("labels")["container_id"]).where("id <> ''").groupBy("id")
    found = rows.agg(label("container_name").alias("_n"), label("image").alias("_i"), last(cpu).alias("cpu"), last(memory).alias("memory"))
    return found.select("id", F.coalesce("_n", "id").alias("name"), F.coalesce("_i", F.lit("")).alias("image"), "cpu", "memory")


def top_templates(clusters: DataFrame, n: int = 8) -> DataFrame:
    """template, value of the n largest clusters (template, lines, score): by score if each has one, otherwise by lines."""
    known = F.broadcast(clusters.agg(F.bool_and(F.col("score").isNotNull()).alias("scored")))  # one row
    value = F.when(F.col("scored"), F.col("score")).otherwise(F.col("lines").cast("double"))
    return clusters.join(known).select("template", value.alias("value"), "lines").orderBy(F.desc("value"), F.desc("lines"), "template").limit(n).select("template", "value")


def offered_ranges(df: DataFrame, *keys: str, time: str = "timestamp") -> DataFrame:
    """keys, range: the ranges shorter than a key's covered span, and the first that covers all of it."""
    span = df.groupBy(*keys).agg((F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))).alias("_span"))
    shorter = [0, *(s * 1_000_000 for _, s in RANGES)]
    offers = F.array(*[F.struct(F.lit(r).alias("range"), F.lit(b).alias("below")) for (r, _), b in zip(RANGES, shorter)])
    fits = F.filter(offers, lambda o: (o["below"] == 0) | (o["below"] < F.col("_span")))
    return span.select(*keys, F.explode(F.transform(fits, lambda o: o["range"])).alias("range"))


def dataset_status(registry: DataFrame) -> DataFrame:
    """registry plus state, from its flags exported, dataset_known, model_known, has_champion and active_job; null is false."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    with_model = F.when(yes("has_champion"), "ready").when(yes("active_job"), "training").otherwise("no-champion")
    without = F.when(yes("dataset_known") | yes("exported"), "missing").otherwise("waiting-for-data")
    return registry.withColumn("state", F.when(yes("model_known"), with_model).otherwise(without))


def bounded_text(text: Column, most: int) -> Column:
    """Control characters as spaces, trimmed, at most so many characters and then an ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most), F.lit("…"))).otherwise(clean)


CARD = ["name", "ready", "trained", "graded", "accuracy", "fallback_accuracy", "detail"]


def model_card(measured: DataFrame, name: str, detail: Column | None = None) -> DataFrame:
    """One card: measured is one row with ready, trained, and graded, accuracy, rule_accuracy where the model has labels (else -1)."""
    has = set(measured.columns)
    number = lambda c, kind, none: (F.coalesce(F.col(c), F.lit(none)) if c in has else F.lit(none)).cast(kind)
    return measured.select(F.lit(name).alias("name"), F.coalesce("ready", F.lit(False)).alias("ready"), number("trained", "bigint", 0).alias("trained"), number("graded", "bigint", 0).alias("graded"), number("accuracy", "double", -1.0).alias("accuracy"), number("rule_accuracy", "double", -1.0).alias("fallback_accuracy"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def model_cards(*cards: DataFrame) -> DataFrame:
    out = cards[0]
    for card in cards[1:]:
        out = out.unionByName(card)
    return out


def insight_payload(insights: DataFrame, *keys: str, n: int = 10, most: int = 200) -> DataFrame:
    """keys, payload: a JSON array of each key's n first findings (critical first, then newest), every text bounded."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    top = insights.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.desc("time"), "id"))).where(F.col("rank") <= n)
    row = F.struct("rank", "kind", "severity", bounded_text(F.col("title"), most).alias("title"), bounded_text(F.col("description"), most).alias("description"))
    return top.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("payload"))


def summary_payload(clusters: DataFrame, *keys: str, n: int = 10, most: int = 200) -> DataFrame:
    """keys, payload: a JSON array of each key's n largest clusters (template, lines, errors), every text bounded."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("lines"), "template"))
    top = clusters.withColumn("rank", rank).where(F.col("rank") <= n)
    row = F.struct("rank", F.col("lines").alias("count"), F.col("errors").alias("errorCount"), bounded_text(F.col("template"), most).alias("template"))
    return top.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("payload"))


def summary_document(insights: DataFrame, clusters: DataFrame, n_insights: int = 20, n_clusters: int = 20, most: int = 200) -> DataFrame:
    """One row, payload: a JSON document with the first findings (critical first, then newest) and the largest clusters (template, source, lines, errors), every text bounded."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    text = lambda c: bounded_text(F.col(c), most).alias(c)
    i = insights.orderBy(rank, F.desc("time"), "id").limit(n_insights).withColumn("rank", F.row_number().over(Window.orderBy(rank, F.desc("time"), "id")))  # n rows
    i = i.agg(F.array_sort(F.collect_list(F.struct("rank", text("kind"), text("severity"), text("title"), text("metric"), "value", text("description")))).alias("insights"))
    c = clusters.orderBy(F.desc("lines"), "template", "source").limit(n_clusters).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("lines"), "template", "source")))  # n rows
    c = c.agg(F.array_sort(F.collect_list(F.struct("rank", F.col("lines").alias("count"), F.col("errors").alias("errorCount"), text("source"), text("template")))).alias("clusters"))
    return i.join(F.broadcast(c)).select(F.to_json(F.struct("insights", "clusters")).alias("payload"))  # one row each


#: How exports are written: quotes are doubled, line breaks stay inside quotes and blanks at the ends of a text are kept.
CSV = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, every text as it is."""
    df.write.options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that export_csv wrote."""
    return spark.read.schema(schema).options(**CSV).option("multiLine", True).csv(path)


def export_if_changed(df: DataFrame, path: str, manifest: DataFrame | None, name: str, newest: str | None = None) -> tuple[bool, DataFrame]:
    """Export df under path unless the manifest (name, rows, newest) says that it has: as many rows and, if asked, the same newest time.

    Returns whether it wrote, and the dataset's manifest row.
    """
    latest = F.max(newest).cast("string") if newest else F.lit(None).cast("string")
    row = df.agg(F.count(F.lit(1)).alias("rows"), latest.alias("newest")).withColumn("name", F.lit(name)).select("name", "rows", "newest")
    now = row.first()
    before = manifest.where(F.col("name") == name).first() if manifest is not None else None
    changed = before is None or (before["rows"], before["newest"]) != (now["rows"], now["newest"])
    if changed:
        df.write.mode("overwrite").options(**CSV).csv(path)
    return changed, row


def findings_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))
