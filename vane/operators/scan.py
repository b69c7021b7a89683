"""Windowed reads, limits, facets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vane.functions.text import label_equals

MAX_LIMIT = 200_000


def checked_limit(limit: int | None) -> int | None:
    """A limit that a reader may ask for; None reads everything."""
    if limit is not None and not 0 < limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def in_window(df: DataFrame, since: datetime | None = None, before: datetime | None = None, time: str = "timestamp") -> DataFrame:
    """since <= time < before; None leaves an end open."""
    if since is not None:
        df = df.where(F.col(time) >= F.lit(since))
    return df if before is None else df.where(F.col(time) < F.lit(before))


def newest(df: DataFrame, n: int | None, *by: str, time: str = "timestamp", seq: str = "seq") -> DataFrame:
    """The newest n rows (None: all), overall or of each group."""
    if n is None:
        return df
    if not by:
        return df.orderBy(F.desc(time), F.desc(seq)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time), F.desc(seq)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def query_metrics(metrics: DataFrame, name: str | None = None, labels: dict[str, str] | None = None, since=None, before=None, limit: int | None = None, per_name: int | None = None) -> DataFrame:
    df = in_window(metrics, since, before)
    if name is not None:
        df = df.where(F.col("name") == name)
    for k, v in (labels or {}).items():
        df = df.where(label_equals(F.col("labels"), k, v))
    limit = checked_limit(limit)
    if per_name and name is not None:
        limit = min(limit or per_name, per_name)
    elif per_name:
        df = newest(df, per_name, "name")
    return newest(df, limit).orderBy("timestamp", "seq")


def query_logs(logs: DataFrame, severity: str | None = None, source: str | None = None, since=None, before=None, limit: int | None = None) -> DataFrame:
    df = in_window(logs, since, before)
    for column, value in (("severity", severity), ("source", source)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return newest(df, checked_limit(limit)).orderBy("timestamp", "seq")


def query_spans(spans: DataFrame, service: str | None = None, trace_id=None, since=None, before=None, limit: int | None = None) -> DataFrame:
    df = in_window(spans, since, before, "start")
    for column, value in (("service", service), ("trace_id", trace_id)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if checked_limit(limit) is not None:
        df = df.orderBy(F.desc("start"), F.desc("trace_id"), F.desc("span_id")).limit(limit)
    return df.orderBy("start", "trace_id", "span_id")


def retained(df: DataFrame, now: datetime, seconds: int, time: str = "timestamp") -> DataFrame:
    return df.where(F.col(time) > F.lit(now) - F.make_interval(secs=F.lit(seconds)))


def declared_levels(logs: DataFrame) -> DataFrame:
    return logs.where(~F.col("severity_inferred") & (F.trim("message") != "") & (F.trim("severity") != ""))


def cut_bytes(message, n: int = 4096):
    """At most n bytes, cut on a character boundary."""
    raw = F.encode(F.trim(message), "UTF-8")
    return F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, n - k).cast("string")) for k in range(4)])


def saved_search(phrases: DataFrame) -> DataFrame:
    """phrase to status and source facets."""
    words = F.filter(F.split(F.lower("phrase"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    has = lambda *ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    status = F.when(has("error", "fail", "fatal", "critical", "severe"), "error").when(has("warn", "warning"), "warn").when(has("debug"), "debug")
    source = F.regexp_extract("phrase", r"(?i)from \s*(\S+)", 1)
    source = F.btrim(source, F.lit("\"'.,"))
    return phrases.select("phrase", status.alias("status"), F.when(source != "", source).alias("source"))


def search_counts(phrases: DataFrame, logs: DataFrame) -> DataFrame:
    """Matching log lines of each phrase: status equal, source contains.

    Logs are counted by source and severity first, and phrases are reduced to their distinct facets. Facets with a status meet
    the counts by an equality; the others meet the sources' sums. Only names, never lines, are compared by containment.
    """
    counts = logs.groupBy("severity", "source").count()
    facets = saved_search(phrases).withColumnRenamed("source", "f_source")
    kinds = facets.select("status", "f_source").distinct()
    inside = F.col("f_source").isNull() | F.lower("source").contains(F.lower("f_source"))
    by_status = kinds.where("status IS NOT NULL").join(counts.withColumnRenamed("severity", "status"), "status").where(inside)
    totals = counts.groupBy("source").agg(F.sum("count").alias("count"))
    free = kinds.where("status IS NULL").withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one").where(inside)
    found = by_status.select("status", "f_source", "count").unionByName(free.select("status", "f_source", "count")).groupBy(F.col("status").alias("_status"), F.col("f_source").alias("_source")).agg(F.sum("count").alias("lines"))
    same = F.col("status").eqNullSafe(F.col("_status")) & F.col("f_source").eqNullSafe(F.col("_source"))
    return facets.join(found, same, "left").select("phrase", "status", "f_source", F.coalesce("lines", F.lit(0)).alias("lines"))


def facet_filter(logs: DataFrame, facets: dict[str, str]) -> DataFrame:
    """Lines that fit all facets: status equal, source contained in any case; unknown keys pass."""
    for key, value in facets.items():
        if key == "status":
            logs = logs.where(F.col("severity") == value)
        elif key == "source":
            logs = logs.where(F.lower("source").contains(value.lower()))
    return logs


def merged_facets(kept: DataFrame, new: DataFrame, *by: str) -> DataFrame:
    """kept with the rows of new in place of those with an equal key (replace by key)."""
    by = by or ("key",)
    return kept.join(new.select(*by).distinct(), list(by), "left_anti").unionByName(new)


def since_or_undated(df: DataFrame, since: datetime, time: str = "time") -> DataFrame:
    """Rows from since on, and those whose time (text) cannot be read."""
    at = F.try_to_timestamp(F.col(time))
    return df.where(at.isNull() | (at >= F.lit(since)))


def ordered_processes(states: DataFrame, *tick: str, top: int = 40, pinned: int | None = None) -> DataFrame:
    """The top processes (pid, cpu, rss) of every tick by cpu, then rss; a pinned pid is always kept."""
    rank = F.row_number().over(Window.partitionBy(*tick).orderBy(F.desc("cpu"), F.desc("rss"), "pid"))
    keep = F.col("_rank") <= top
    return states.withColumn("_rank", rank).where(keep if pinned is None else keep | (F.col("pid") == pinned)).drop("_rank")


def recent(df: DataFrame, n: int, *order: str, managed: DataFrame | None = None, by: str = "model") -> DataFrame:
    """The newest n rows (recent predictions, recent jobs), of managed models only if these are given."""
    df = df if managed is None else df.join(managed.select(by).distinct(), by, "left_semi")
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
