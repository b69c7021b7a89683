"""Structured Streaming forms: score on write, closed minutes, flush windows, keyed state, delayed labels, retention.

The operators that are ordered recursions (changepoints, learned_thresholds, p2_quantiles, slow_spans, burn_forecast) run over
streams as they are: with scan=stream_scan the state of a key stays for ever, with scan=silent_after(seconds) it goes when the key has been silent
for that long. Whatever ends by a timer needs use_timers(spark) before it starts. Rows behind the watermark count nowhere.

Sinks are written once: a micro-batch has a folder of its own, which a second try replaces.
"""

from __future__ import annotations

import bisect
import math
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vane.functions.text import log_template
from vane.operators.baseline import CRITICAL_D2, MIN_VECTORS, WARN_D2, severity_of
from vane.operators.bursts import FEATURES
from vane.operators.sequential import kinds_of
from vane.plans import files
from vane.plans.expiring import expiring_scan
from vane.plans.ordered import stream_scan
from vane.sources.wire import GAUGE_TTL, QUANTILES, statsd_points


def minute_means_stream(metrics: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Means of closed minutes only: append mode emits a window when the watermark has passed it."""
    return metrics.withWatermark("timestamp", late).groupBy("name", F.window("timestamp", "1 minute")).agg(F.avg("value").alias("value")).select("name", F.col("window.start").alias("at"), "value")


def episodes_stream(findings: DataFrame, *keys: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    return findings.withWatermark("timestamp", late).groupBy(*keys, F.session_window("timestamp", gap)).agg(F.count(F.lit(1)).alias("findings")).select(*keys, F.col("session_window.start").alias("opened"), "findings")


def zscore_stream(metrics: DataFrame, min_samples: int = 12) -> DataFrame:
    """Running z by name with state (n, mean, squared deviations): each point against the points before it, as in the batch form."""

    def score(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        pdf = pd.concat(list(batches)).sort_values(["timestamp", "seq"], kind="stable")
        zs = []
        for x in pdf.value:
            old_n, old_mean, old_m2 = n, mean, m2
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
            flat = old_n < 2 or old_m2 <= 0
            centre, var = (mean, m2 / (n - 1) if n > 1 else 0.0) if flat else (old_mean, old_m2 / (old_n - 1))
            zs.append((x - centre) / math.sqrt(var) if n >= min_samples and var > 0 else None)
        state.update((n, mean, m2))
        yield pdf.assign(name=key[0], z=pd.array(zs, dtype="Float64"))[["name", "timestamp", "seq", "value", "z"]]

    return metrics.select("name", "timestamp", "seq", "value").groupBy("name").applyInPandasWithState(score, "name string, timestamp timestamp, seq bigint, value double, z double", "n long, mean double, m2 double", "append", "NoTimeout")


def write_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch in its own folder, path/batch=id: when the batch is tried again, the folder is replaced, so no row is stored twice."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def score_on_write(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch is scored against the state and written once, findings beside the points."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_once(batch.withColumn("severity", severity_of(F.col("z"))), path, batch_id)

    return zscore_stream(metrics).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


class Finding:
    """An open finding: when it was opened and last seen, and how often."""

    def __init__(self) -> None:
        self.opened, self.last, self.count = None, None, 0


def live_findings(scored: DataFrame, *keys: str, silent_seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """keys, opened, last_seen (micros), findings, ended of every finding that has ended: by a point without a severity (`recovered`), or by silence (`silent`).

    scored: keys, timestamp, seq, severity (null for a good point). A key without an open finding has no state.
    """
    k = len(keys)

    def row(key: tuple, f: Finding, why: str) -> tuple:
        return (*key, f.opened, f.last, f.count, why)

    def step(f: Finding, r: tuple) -> list[tuple]:
        key, us, bad = r[:k], r[k], r[k + 2] is not None
        out = []
        if f.count and us - f.last > silent_seconds * 1_000_000:
            out.append(row(key, f, "silent"))
            f.opened, f.count = None, 0
        if bad:
            f.opened, f.last, f.count = us if f.opened is None else f.opened, us, f.count + 1
        elif f.count:
            out.append(row(key, f, "recovered"))
            f.opened, f.count = None, 0
        return out

    rows = scored.select(*keys, F.unix_micros("timestamp").alias("us"), "seq", "severity")
    due = lambda f, latest: f.last + silent_seconds * 1_000_000 + 1 if f.count else None
    return expiring_scan(rows, list(keys), ["us", "seq"], Finding, step, f"{kinds_of(rows, *keys)}, opened bigint, last_seen bigint, findings bigint, ended string", late, due, lambda f, key, now: ([row(key, f, "silent")], False))


class Gauge:
    """A gauge's value and the time of its last line, and the lines of windows that are still open, by their end."""

    def __init__(self) -> None:
        self.value, self.seen, self.open = 0.0, None, {}


def gauge_flushes(points: DataFrame, flush_seconds: int, late: str, ttl_seconds: int = GAUGE_TTL) -> DataFrame:
    """name, tags, flush, value of gauge lines by closed window: the value is carried from window to window, +/- lines change it,
    and a gauge that has been silent for longer than the ttl starts anew, its state dropped."""
    width, ttl = flush_seconds * 1_000_000, ttl_seconds * 1_000_000

    def step(g: Gauge, row: tuple) -> None:
        _, _, us, seq, relative, number = row
        g.open.setdefault(str(us // width * width + width), []).append([us, seq, relative, number])

    def closed(g: Gauge, key: tuple, now: int) -> tuple[list[tuple], bool]:
        out = []
        for end in sorted((int(e) for e in g.open if int(e) <= now)):
            for us, _, relative, number in sorted(g.open.pop(str(end))):
                base = g.value if relative and g.seen is not None and us - g.seen <= ttl else 0.0
                g.value, g.seen = base + number, us
            out.append((*key, end, g.value))
        return out, bool(g.open) or now <= g.seen + ttl

    def due(g: Gauge, latest: int) -> int:
        return min(map(int, g.open)) if g.open else g.seen + ttl + 1

    rows = points.select("name", "tags", F.unix_micros("timestamp").alias("us"), "seq", F.col("text").rlike(r"^[+-]").alias("relative"), "number")
    found = expiring_scan(rows, ["name", "tags"], ["us", "seq"], Gauge, step, "name string, tags string, flush bigint, value double", late, due, closed)
    return found.withColumn("flush", F.timestamp_micros("flush"))


def statsd_flush_stream(lines: DataFrame, flush_seconds: int = 10, late: str = "10 seconds") -> DataFrame:
    """name, tags, quantile, flush, value of closed flush windows, the rows of statsd_rollup: counters by rate, gauges with relative
    changes, timers' count, sum and quantiles. Equal samples of a timer are counted, not listed. Its branches are parts of one source: call use_source_watermark(spark) first."""
    p = statsd_points(lines)
    marked = p.withWatermark("timestamp", late)
    window = F.window("timestamp", f"{flush_seconds} seconds")
    none = F.lit(None).cast("string").alias("quantile")
    columns = ["name", "tags", "quantile", "flush", "value"]
    counters = marked.where("type = 'c'").groupBy("name", "tags", window).agg(F.sum(F.col("number") / F.col("rate")).alias("value"))
    counters = counters.select("name", "tags", none, F.col("window.end").alias("flush"), "value")
    gauges = gauge_flushes(p.where("type = 'g'"), flush_seconds, late).withColumn("quantile", none)
    counted = marked.where("type IN ('ms', 'h', 'd')").groupBy("name", "tags", window, "number").agg(F.count(F.lit(1)).alias("n"))
    again = F.window(F.window_time("window"), f"{flush_seconds} seconds")
    t = counted.groupBy("name", "tags", again).agg(F.sum("n").alias("_count"), F.sum(F.col("n") * F.col("number")).alias("_sum"), F.array_sort(F.collect_list(F.struct("number", "n"))).alias("_all"))
    t = t.withColumn("_upto", F.transform("_all", lambda x, i: F.aggregate(F.slice("_all", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"])))
    at = lambda q: F.get("_all", F.array_position(F.transform("_upto", lambda u: u > F.floor(F.lit(q) * (F.col("_count") - 1))), True).cast("int") - 1)["number"]
    row = lambda suffix, quantile, value: F.struct(F.concat("name", F.lit(suffix)).alias("name"), F.lit(quantile).cast("string").alias("quantile"), value.cast("double").alias("value"))
    rows = F.array(row("_count", None, F.col("_count")), row("_sum", None, F.col("_sum")), *[row("", str(q), at(q)) for q in QUANTILES])
    timers = t.select("tags", F.col("window.end").alias("flush"), F.explode(rows).alias("r")).select("r.name", "tags", "r.quantile", "flush", "r.value")
    return counters.select(*columns).unionByName(gauges.select(*columns)).unionByName(timers.select(*columns))


class Template:
    """Times of a template's lines in the last window and in the one before, and its counts."""

    def __init__(self) -> None:
        self.recent: deque[int] = deque()
        self.previous: deque[int] = deque()
        self.lines, self.errors, self.latest = 0, 0, -(2**62)

    def add(self, us: int, w: int) -> None:
        """A line more: each time enters and leaves a window once, so the work grows with the lines."""
        if us >= self.latest:
            self.latest = us
            self.recent.append(us)
        elif us >= self.latest - 2 * w:  # late: it keeps its time and does not turn the windows back
            bisect.insort(self.recent if us >= self.latest - w else self.previous, us)
        while self.recent and self.recent[0] < self.latest - w:
            self.previous.append(self.recent.popleft())
        while self.previous and self.previous[0] < self.latest - 2 * w:
            self.previous.popleft()


def log_bursts_stream(logs: DataFrame, *keys: str, seconds: int = 60, at_least: int = 8, ratio: float = 3.0, scan: Callable[..., DataFrame] = stream_scan) -> DataFrame:
    """keys, template, us, seq, recent, previous, lines, errors, burst_severity: log_bursts over a stream. A late line keeps its time and does not turn the windows back.

    scan=silent_after(seconds) forgets a template, its counts too, when it has been silent for that long.
    """
    w, k = seconds * 1_000_000, len(keys) + 1

    def step(t: Template, row: tuple) -> list[tuple] | None:
        us, seq, bad = row[k], row[k + 1], row[k + 2]
        t.lines, t.errors = t.lines + 1, t.errors + bad
        t.add(us, w)
        recent, previous = len(t.recent), len(t.previous)
        if recent < at_least or (previous and recent < ratio * previous):
            return None
        return [(*row[:k], us, seq, recent, previous, t.lines, t.errors, "critical" if t.errors or recent >= 2 * at_least else "warning")]

    rows = logs.select(*keys, log_template(F.col("message")).alias("template"), F.unix_micros("timestamp").alias("us"), "seq", F.coalesce(F.col("severity").isin("error", "fatal"), F.lit(False)).cast("int").alias("bad"))
    schema = f"{kinds_of(rows, *keys, 'template', 'us', 'seq')}, recent bigint, previous bigint, lines bigint, errors bigint, burst_severity string"
    return scan(rows, [*keys, "template"], ["us", "seq"], Template, step, schema)


class Host:
    """Running mean and squared deviations of a host's vectors."""

    def __init__(self, k: int):
        self.n, self.mean, self.m2 = 0, [0.0] * k, [[0.0] * k for _ in range(k)]


def host_outliers_stream(vectors: DataFrame, features: list[str], floors: list[float], key: str = "host", min_vectors: int = MIN_VECTORS, scan: Callable[..., DataFrame] = stream_scan) -> DataFrame:
    """host, us, seq, n, d2, severity: host_outliers over a stream. scan=silent_after(seconds) forgets hosts that are gone."""
    k = len(features)

    def step(h: Host, row: tuple) -> list[tuple]:
        x, mean, m2 = np.array(row[3 : 3 + k], float), np.array(h.mean), np.array(h.m2)
        h.n += 1
        before = x - mean
        mean = mean + before / h.n
        m2 = m2 + np.outer(before, x - mean)
        h.mean, h.m2 = mean.tolist(), m2.tolist()
        if h.n < min_vectors:
            return [(*row[:3], h.n, None, None)]
        cov = m2 / (h.n - 1)
        np.fill_diagonal(cov, np.maximum(np.diag(cov), floors))
        d2 = float((x - mean) @ np.linalg.pinv(cov, hermitian=True) @ (x - mean))
        return [(*row[:3], h.n, d2, "critical" if d2 >= CRITICAL_D2 else "warning" if d2 >= WARN_D2 else None)]

    rows = vectors.select(key, F.unix_micros("timestamp").alias("us"), "seq", *features)
    return scan(rows, [key], ["us", "seq"], lambda: Host(k), step, f"{kinds_of(rows, key, 'us', 'seq')}, n bigint, d2 double, severity string")


class Pending:
    """The examples of a scope whose label is not known yet: by key, the time after which there is none, and the row so far."""

    def __init__(self) -> None:
        self.open = {}


def delayed_labels(bursts: DataFrame, criticals: DataFrame, *keys: str, scope: str, within_seconds: int = 300, late: str = "1 minute") -> DataFrame:
    """The rows of paging_examples over streams: one example an episode of a key, opened by its first burst, with the features and the
    rule's verdict of its last. The first critical of the scope in (opened, opened + within] labels and ends it; else a timer does.

    bursts: keys (scope among them), timestamp, seq, the features, burst_severity; criticals: scope, timestamp. A scope's state holds its open examples only.
    """
    window = within_seconds * 1_000_000
    others = [c for c in keys if c != scope]
    n = len(others)

    def shut(p: Pending, scope_key: tuple, key: str, followed: bool, resolved: int) -> tuple:
        names, opened, seq, last = p.open.pop(key)
        return (*scope_key, *names, opened, seq, followed, resolved, *last)

    def overdue(p: Pending, scope_key: tuple, now: int) -> list[tuple]:
        return [shut(p, scope_key, k, False, x[1] + window) for k, x in list(p.open.items()) if x[1] + window < now]

    def step(p: Pending, row: tuple) -> list[tuple]:
        scope_key, us, is_critical, seq, key = row[:1], row[1], row[2], row[3], row[4]
        out = overdue(p, scope_key, us)
        if is_critical:
            out += [shut(p, scope_key, k, True, us) for k, x in list(p.open.items()) if x[1] < us]
        else:
            first = p.open.get(key, [list(row[5 : 5 + n]), us, seq])
            p.open[key] = [*first[:3], list(row[5 + n :])]
        return out

    def end(p: Pending, scope_key: tuple, now: int) -> tuple[list[tuple], bool]:
        out = overdue(p, scope_key, now)
        return out, bool(p.open)

    us = F.unix_micros("timestamp").alias("us")
    b = bursts.select(scope, us, F.lit(0).alias("is_critical"), F.col("seq").cast("long").alias("seq"), F.to_json(F.struct(*others)).alias("key"), *others, *FEATURES, (F.col("burst_severity") == "critical").alias("rule"))
    c = criticals.select(scope, us, F.lit(1).alias("is_critical"))
    rows = b.unionByName(c, allowMissingColumns=True)
    schema = f"{kinds_of(bursts, scope, *others)}, opened bigint, seq bigint, followed boolean, resolved bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", rule boolean"
    due = lambda p, latest: min(x[1] for x in p.open.values()) + window + 1 if p.open else None
    return expiring_scan(rows, [scope], ["us", "is_critical", "seq"], Pending, step, schema, late, due, end)


def write_retained(stream: DataFrame, path: str, checkpoint: str, retention_seconds: int | None = None) -> StreamingQuery:
    """Every micro-batch once, with the clock of writing, which no claimed time can change, as ingest_ts, in folders of the batch and of its date.

    retention_seconds: after each batch, folders whose dates lie wholly before that are dropped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("ingest_ts", F.current_timestamp()).withColumn("ingest_date", F.to_date("ingest_ts"))
        stamped.write.mode("overwrite").partitionBy("ingest_date").parquet(f"{path}/batch={batch_id}")
        if retention_seconds is not None:
            expire_retained(batch.sparkSession, path, datetime.now(timezone.utc), retention_seconds)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def expire_retained(spark: SparkSession, path: str, now: datetime, seconds: int) -> list[str]:
    """Drops the folders in which every row was written so many seconds before now, and returns their names."""
    oldest = (now.astimezone(timezone.utc) - timedelta(seconds=seconds)).date().isoformat()
    gone = []
    for batch in (b for b in files.children(spark, path) if b.startswith("batch=")):
        days = [x for x in files.children(spark, f"{path}/{batch}") if x.startswith("ingest_date=")]
        old = [x for x in days if x.removeprefix("ingest_date=") < oldest]
        whole = bool(days) and old == days
        for name in [batch] if whole else [f"{batch}/{x}" for x in old]:
            files.drop(spark, f"{path}/{name}")
            gone.append(name)
    return gone


def read_retained(spark: SparkSession, path: str, schema: str, now, seconds: int) -> DataFrame:
    """Rows written less than so many seconds before now; whole folders of older dates are not read."""
    since = F.lit(now) - F.make_interval(secs=F.lit(seconds))
    rows = spark.read.schema(f"{schema}, ingest_ts timestamp, batch bigint, ingest_date date").parquet(path)
    return rows.where((F.col("ingest_date") >= F.to_date(since)) & (F.col("ingest_ts") > since)).drop("batch")
