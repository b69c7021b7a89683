"""Dashboard roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vane.functions.text import clamp, log_template, nice_step, tls_tone


def log_templates(logs: DataFrame, *keys: str) -> DataFrame:
    errors = F.col("severity").isin("error", "fatal")
    return logs.withColumn("template", log_template(F.col("message"))).where("template <> ''").groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("lines"), F.count_if(errors).alias("errors"), F.max("timestamp").alias("last_seen"), F.max_by("message", "seq").alias("sample"))


def error_budget(logs: DataFrame, *scope: str, slo: float = 0.01) -> DataFrame:
    """Share of the error budget that is spent; a slo of 0 or less means 1 %."""
    slo = slo if slo > 0 else 0.01
    agg = logs.groupBy(*scope).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count(F.lit(1)).alias("total"))
    consumed = F.when(F.col("total") == 0, 0.0).otherwise(F.least(F.lit(100.0), F.col("errors") / F.col("total") / slo * 100))
    return agg.withColumn("consumed", consumed).withColumn("status", F.when(consumed >= 90, "critical").when(consumed >= 70, "at-risk").otherwise("healthy"))


def minute_means(metrics: DataFrame, now: Column | None = None, keep: int | None = None, grain: str = "minute") -> DataFrame:
    """Mean by name and UTC minute; the minute of `now` is still open and left out; keep: only so many newest minutes a name."""
    df = metrics.withColumn("at", F.date_trunc(grain, "timestamp"))
    if now is not None:
        df = df.where(F.col("at") < F.date_trunc(grain, now))
    means = df.groupBy("name", "at").agg(F.avg("value").alias("value"))
    if keep is None:
        return means
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("at")))
    return means.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")


def latest_values(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.max_by("value", F.struct("timestamp", "seq")).alias("value"))


def pivot_latest(metrics: DataFrame, key: Column, alias: str, wanted: dict[str, str]) -> DataFrame:
    """One row a key, one column a metric name with its last value (process and container tables)."""
    order = F.struct("timestamp", "seq")
    aggs = [F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, order)).alias(c) for n, c in wanted.items()]
    return metrics.groupBy(key.alias(alias)).agg(*aggs)


def probe_uptime(probes: DataFrame, since: str, until: str, buckets: int = 60) -> DataFrame:
    """A row for each target and bucket: unknown, operational, degraded or outage."""
    lo, hi = (F.unix_micros(F.to_timestamp(F.lit(t))) for t in (since, until))
    width = (hi - lo) / buckets
    inside = probes.where((F.unix_micros("timestamp") >= lo) & (F.unix_micros("timestamp") <= hi))
    at = F.least(F.floor((F.unix_micros("timestamp") - lo) / width), F.lit(buckets - 1)).cast("int")
    counted = inside.groupBy("target", at.alias("bucket")).agg(F.count(F.lit(1)).alias("checks"), F.sum("up").cast("bigint").alias("up"))
    grid = probes.select("target").distinct().select("target", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    j = grid.join(counted, ["target", "bucket"], "left")
    status = F.when(F.col("checks").isNull(), "unknown").when(F.col("up") == F.col("checks"), "operational").when(F.col("up") == 0, "outage").otherwise("degraded")
    failed = F.format_string("%d of %d checks failed", F.col("checks") - F.col("up"), F.col("checks"))
    return j.select("target", "bucket", F.coalesce("checks", F.lit(0)).alias("checks"), status.alias("status"), F.when(status == "degraded", failed).alias("detail"))


def certificates(probes: DataFrame, since: str, until: str) -> DataFrame:
    """Every target's newest TLS values (days_remaining, valid) in the window, null without any, and their tone. probes: target, timestamp, seq, days_remaining, valid."""
    lo, hi = (F.to_timestamp(F.lit(t)) for t in (since, until))
    inside = F.col("timestamp").between(lo, hi)
    last = lambda c: F.max_by(c, F.when(inside & F.col(c).isNotNull(), F.struct("timestamp", "seq"))).alias(c)
    found = probes.groupBy("target").agg(last("days_remaining"), last("valid"))
    return found.withColumn("tone", tls_tone(F.col("valid"), F.col("days_remaining")))


def uptime_percent(segments: DataFrame) -> DataFrame:
    known, good = F.count_if(F.col("status") != "unknown"), F.count_if(F.col("status") == "operational")
    return segments.groupBy("target").agg(F.when(known == 0, 0.0).otherwise(F.round(good / known * 100, 4)).alias("uptime"), F.count_if(F.col("status").isin("degraded", "outage")).alias("incidents"))


def error_heatmap(logs: DataFrame) -> DataFrame:
    """Errors by source and hour of day; null where there is none."""
    errors = logs.where(F.col("severity") == "error").withColumn("source", F.when(F.trim("source") == "", "unknown").otherwise(F.col("source")))
    grid = errors.groupBy("source").pivot("hour", list(range(24))).count() if "hour" in errors.columns else errors.withColumn("hour", F.hour("timestamp")).groupBy("source").pivot("hour", list(range(24))).count()
    return grid.select("source", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def heatmap_scale(grid: DataFrame, *cells: str) -> DataFrame:
    """grid plus ceiling: its largest cell, at least 0."""
    top = grid.agg(F.max(F.greatest(*[F.coalesce(c, F.lit(0)) for c in cells], F.lit(0))).alias("ceiling"))  # one row
    return grid.join(F.broadcast(top))


def calendar_heatmap(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Counts by week (its Sunday) and weekday over the whole span; days without rows are null."""
    days = df.groupBy(F.to_date(time).alias("day")).count()
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    j = span.join(days, "day", "left")
    return j.select("day", F.date_sub("day", F.dayofweek("day") - 1).alias("week"), (F.dayofweek("day") - 1).alias("weekday"), F.col("count").alias("rows"))


def five_number(df: DataFrame, value: str, *keys: str, exact: bool = True) -> DataFrame:
    """Least, quartiles and largest by key. Exact ones hold the counts of a group's distinct values together; at scale use exact=False, mergeable sketches."""
    qs = F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])
    found = F.percentile(value, qs) if exact else F.percentile_approx(value, qs)
    out = df.groupBy(*keys).agg(found.alias("_q"))
    return out.select(*keys, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


def histogram_buckets(df: DataFrame, value: str, ticks: int = 10) -> DataFrame:
    """Counts by bucket of a nice width; the two extremes come first, as one row."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select(nice_step(F.col("hi") - F.col("lo"), ticks).alias("step"))
    step = F.broadcast(edges)  # one row
    return df.join(step).groupBy((F.floor(F.col(value) / F.col("step")) * F.col("step")).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    sums = df.groupBy(key).agg(F.sum(value).alias("total"))
    every = F.broadcast(df.agg(F.sum(value).alias("_every")))  # one row
    return sums.join(every).withColumn("share", F.col("total") / F.col("_every") * 100).drop("_every")


def top_n_with_other(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Counts of the n largest keys, the rest as Other. Only one row a key reaches the ranking."""
    counts = df.groupBy(F.col(key).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    top = counts.orderBy(F.desc("rows"), "label").limit(n)
    rest = counts.join(top.select("label"), "label", "left_anti").agg(F.sum("rows").alias("rows")).where("rows IS NOT NULL").select(F.lit("Other").alias("label"), "rows")
    return top.union(rest)


def funnel(df: DataFrame, stage: str, order: list[str]) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, order)), F.col(stage)).cast("int")
    counts = df.where(at > 0).groupBy(at.alias("position"), F.col(stage).alias("stage")).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(F.lit(1)).orderBy("position")  # one row a stage
    first, before = F.first("rows").over(w), F.lag("rows").over(w)
    ratio = lambda a, b: F.when(b > 0, clamp(a / b * 100, 0.0, 100.0))
    return counts.select("position", "stage", "rows", ratio(F.col("rows"), first).alias("of_first"), ratio(F.col("rows"), before).alias("of_previous"))


def trend_summary(metrics: DataFrame, *keys: str) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.count("value").alias("samples"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("timestamp", "seq")).alias("latest"))


def period_delta(totals: DataFrame, period: str, value: str, *keys: str, good: str = "up") -> DataFrame:
    change = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(period))
    way = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return totals.withColumn("change", change).withColumn("direction", F.when(F.col("change").isNotNull(), way)).withColumn("tone", F.when(F.col("direction").isNull() | (F.col("direction") == "flat"), "neutral").when(F.col("direction") == good, "good").otherwise("bad"))


def service_status(findings: DataFrame, key: str, services: DataFrame | None = None, now: Column | None = None, interval_seconds: int = 10) -> DataFrame:
    """Worst state by key: any critical finding outage, any warning degraded, else operational.

    services (key, last_seen) adds those without findings: unknown if never seen, stale after three intervals of silence before now.
    """
    rank = F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0))
    worst = findings.groupBy(key).agg(rank.alias("_r"))
    state = F.when(F.col("_r") == 2, "outage").when(F.col("_r") == 1, "degraded").otherwise("operational")
    if services is None:
        return worst.select(key, state.alias("status"))
    silent = F.unix_micros(F.current_timestamp() if now is None else now) - F.unix_micros("last_seen") > 3 * interval_seconds * 1_000_000
    return services.join(worst, key, "left").select(key, F.when(F.col("last_seen").isNull(), "unknown").when(silent, "stale").otherwise(state).alias("status"))


def log_counters(logs: DataFrame, *keys: str) -> DataFrame:
    level = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), *[level(s) for s in ("debug", "info", "warn", "error")])


def facet_options(logs: DataFrame) -> DataFrame:
    sources = logs.select(F.lit("source").alias("key"), F.col("source").alias("value")).distinct()
    levels = logs.sparkSession.createDataFrame([("status", s) for s in ("debug", "info", "warn", "error")], "key string, value string")
    return sources.unionByName(levels)


def series_cardinality(metrics: DataFrame, key: Column, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return metrics.groupBy("name").agg(count.alias("series"))


def outer_minutes(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """Every minute of either side, null where a side has none."""
    return observed.withColumnRenamed("value", "observed").join(forecast.withColumnRenamed("value", "forecast"), ["name", "at"], "full")


def connection_states(snapshot: DataFrame, *keys: str) -> DataFrame:
    """Connections by state, of a landed snapshot."""
    return snapshot.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("connections"))


def enough(df: DataFrame, label: str | None = None, rows: int = 30, classes: int = 2) -> DataFrame:
    """One row: rows, distinct labels, and whether they are enough to train on."""
    kinds = F.lit(None).cast("bigint") if label is None else F.count_distinct(F.col(label))
    got = df.agg(F.count(F.lit(1)).alias("rows"), kinds.alias("labels"))
    return got.withColumn("enough", (F.col("rows") >= rows) & (F.lit(label is None) | (F.col("labels") >= classes)))


def disagreement(predictions: DataFrame, *keys: str) -> DataFrame:
    """Graded answers (declared, answer) and how many differ, by model or other keys; undeclared ones are not graded."""
    graded = predictions.where("declared IS NOT NULL AND answer IS NOT NULL")
    return graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("graded"), F.count_if(F.col("declared") != F.col("answer")).alias("differ"))


def predictions_against_declared(lines: DataFrame, answers: DataFrame, *ids: str, classes: tuple[str, ...], newest: int | None = None, order: str = "timestamp") -> DataFrame:
    """Answers joined to the declared labels of their lines; labels outside the known classes are left out."""
    known = lines.where(F.col("severity").isin(*classes))
    if newest is not None:
        known = known.orderBy(F.desc(order), *ids).limit(newest)
    return known.withColumnRenamed("severity", "declared").join(answers.select(*ids, "answer"), list(ids))


def settled_forecasts(forecasts: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """forecasts (keys, at, value) that an actual value has settled, with error and squared error; the others are still open."""
    j = forecasts.withColumnRenamed("value", "forecast").join(actual.select(*keys, "at", F.col("value").alias("actual")), [*keys, "at"])
    return j.withColumn("error", F.col("forecast") - F.col("actual")).withColumn("squared", F.col("error") * F.col("error"))
