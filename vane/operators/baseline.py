"""Per-series baselines: z-scores against the past, changepoints, counters, host outliers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vane.plans.ordered import chunked_scan

MIN_SAMPLES, WARN, CRITICAL = 12, 3.0, 5.0
DRIFT, DECISION = 0.5, 5.0
MIN_VECTORS, WARN_D2, CRITICAL_D2 = 50, 18.21, 37.09


def metric_zscore(metrics: DataFrame, *keys: str, min_samples: int = MIN_SAMPLES, inclusive: bool = False) -> DataFrame:
    """metrics with n and z: each point against those before it in its series; with too few or flat ones before (or if inclusive), against all up to it.

    A series is dealt by day: windows run inside a series' day, and the counts, means and squared deviations of its earlier
    days, one row a day, are added to them. So no task holds a whole series. Flatness is decided by least and largest values.
    """
    day = F.to_date("timestamp")
    same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys]
    days = metrics.groupBy(*[F.col(k).alias(f"_d{k}") for k in keys], day.alias("_dday")).agg(F.count("value").alias("_n0"), F.avg("value").alias("_m0"), F.var_pop("value").alias("_v0"), F.min("value").alias("_lo0"), F.max("value").alias("_hi0"))
    before = Window.partitionBy(*[f"_d{k}" for k in keys]).orderBy("_dday").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*[f"_d{k}" for k in keys])
    days = days.withColumn("_shift", F.avg("_m0").over(whole))  # means are near it, so squares lose no digits
    shifted = F.col("_m0") - F.col("_shift")
    past = {"_n1": F.sum("_n0").over(before), "_s1": F.sum(F.col("_n0") * shifted).over(before), "_q1": F.sum(F.col("_n0") * (F.col("_v0") + shifted * shifted)).over(before), "_lo1": F.min("_lo0").over(before), "_hi1": F.max("_hi0").over(before)}
    days = days.withColumns(past).select(*[f"_d{k}" for k in keys], "_dday", "_shift", "_n1", "_s1", "_q1", "_lo1", "_hi1")
    joined = metrics.withColumn("_day", day).join(days, [*same("", "_d"), F.col("_day") == F.col("_dday")])
    order = Window.partitionBy(*keys, "_day").orderBy("timestamp", "seq")
    frames = {"p": order.rowsBetween(Window.unboundedPreceding, -1), "h": order.rowsBetween(Window.unboundedPreceding, 0)}
    x = F.col("value") - F.col("_shift")
    df = joined
    for f, frame in frames.items():
        df = df.withColumns({f"_n{f}": F.count("value").over(frame) + F.coalesce("_n1", F.lit(0)), f"_s{f}": F.coalesce(F.sum(x).over(frame), F.lit(0.0)) + F.coalesce("_s1", F.lit(0.0)), f"_q{f}": F.coalesce(F.sum(x * x).over(frame), F.lit(0.0)) + F.coalesce("_q1", F.lit(0.0)), f"_lo{f}": F.least(F.min("value").over(frame), "_lo1"), f"_hi{f}": F.greatest(F.max("value").over(frame), "_hi1")})
    mean = lambda f: F.col("_shift") + F.col(f"_s{f}") / F.col(f"_n{f}")
    sd = lambda f: F.when((F.col(f"_n{f}") > 1) & (F.col(f"_hi{f}") > F.col(f"_lo{f}")), F.sqrt(F.greatest(F.col(f"_q{f}") - F.col(f"_s{f}") * F.col(f"_s{f}") / F.col(f"_n{f}"), F.lit(0.0)) / (F.col(f"_n{f}") - 1)))
    own = F.lit(False) if inclusive else (F.col("_nh") >= 3) & sd("p").isNotNull()
    z = F.when(own, (F.col("value") - mean("p")) / sd("p")).otherwise((F.col("value") - mean("h")) / sd("h"))
    return df.select(*metrics.columns, F.col("_nh").alias("n"), F.when((F.col("_nh") >= min_samples) & ~F.isnan(z), z).alias("z"))


def severity_of(z: Column, warn: Column | float = WARN, critical: Column | float = CRITICAL) -> Column:
    return F.when(F.abs(z) >= critical, "critical").when(F.abs(z) >= warn, "warning")


def metric_anomalies(metrics: DataFrame, *keys: str, warn: Column | float = WARN, critical: Column | float = CRITICAL) -> DataFrame:
    """Points far off their baseline; the limits may be columns, such as learned ones."""
    scored = metric_zscore(metrics, *keys)
    return scored.withColumn("severity", severity_of(F.col("z"), warn, critical)).where(F.col("severity").isNotNull())


def changepoints(scored: DataFrame, *keys: str, drift: float = DRIFT, decision: float = DECISION, scan: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Rows where a two-armed cumulative sum of z crosses; both arms start anew there, and where a point has no score.

    In a batch a series is dealt by day, and days are run again from the sums in which the day before ended (see chunked_scan), so a
    hot series is no single task. scan=stream_scan: one pass in time order over a stream.
    """
    rows = scored.select(*keys, "timestamp", "seq", "z")
    at = len(keys) + 2

    def step(arms: list[float], row: tuple) -> list[tuple] | None:
        z = row[at]
        if z is None:
            arms[:] = 0.0, 0.0
            return None
        hi, lo = max(0.0, arms[0] + z - drift), max(0.0, arms[1] - z - drift)
        arms[:] = hi, lo
        if max(hi, lo) < decision:
            return None
        arms[:] = 0.0, 0.0
        return [(*row, max(hi, lo), "up" if hi >= lo else "down")]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", arm double, direction string"
    if scan is None:
        return chunked_scan(rows.withColumn("day", F.to_date("timestamp").cast("string")), list(keys), "day", ["timestamp", "seq"], lambda: [0.0, 0.0], step, schema)
    return scan(rows, list(keys), ["timestamp", "seq"], lambda: [0.0, 0.0], step, schema)


def first_crossing(scored: DataFrame, *keys: str, drift: float = DRIFT, decision: float = DECISION) -> DataFrame:
    """The first upward crossing of each series, as windows only: the sum less its lowest value so far.

    Sums and lowest values are taken inside a series' day; what the days before it add is one row a day.
    """
    same, day = [F.col(k) for k in keys], F.to_date("timestamp")
    inside = Window.partitionBy(*keys, "_day").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    df = scored.where("z IS NOT NULL").withColumn("_day", day).withColumn("_p", F.sum(F.col("z") - drift).over(inside)).withColumn("_low", F.min("_p").over(inside))
    last = F.struct("timestamp", "seq")
    days = df.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(same)], F.col("_day").alias("_d")).agg(F.max_by("_p", last).alias("_sum"), F.min("_p").alias("_least"))
    order = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_sum").over(order), F.lit(0.0)))
    days = days.withColumn("_floor", F.least(F.coalesce(F.min(F.col("_before") + F.col("_least")).over(order), F.lit(0.0)), F.lit(0.0)))
    j = df.join(days, [*[c.eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(same)], F.col("_day") == F.col("_d")])
    p = F.col("_p") + F.col("_before")
    hit = j.withColumn("arm", p - F.least(F.col("_low") + F.col("_before"), F.col("_floor"))).where(F.col("arm") >= decision)
    rest = [c for c in (*scored.columns, "arm") if c not in keys]
    first = hit.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("timestamp", "seq")).alias("_first"))
    return first.select(*keys, "_first.*").select(*scored.columns, "arm")


def counter_delta(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Increase since the point before; a fall is a reset: no delta, but the new baseline."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("timestamp", "seq"))
    return df.withColumn("delta", F.when(d >= 0, d))


def container_cpu(df: DataFrame) -> DataFrame:
    """cpu_total, system_total, cpus by container to percent."""
    order = Window.partitionBy("container").orderBy("timestamp", "seq")
    cpu, system = (F.col(c) - F.lag(c).over(order) for c in ("cpu_total", "system_total"))
    cpus = F.when(F.col("cpus") == 0, 1).otherwise(F.col("cpus"))
    return df.withColumn("cpu_percent", F.when(cpu.isNull(), None).when((system <= 0) | (cpu < 0), 0.0).otherwise(cpu / system * cpus * 100))


def batch_vectors(metrics: DataFrame, names: list[str], key: str, tick: Column, first: tuple[str, ...] = ()) -> DataFrame:
    """key, tick, one column a name, timestamp, seq: the last value of each measure in a tick (of those in `first` the first one), where a tick has all of them."""
    order = F.struct("timestamp", "seq")
    own = lambda n: F.when(F.col("name") == n, order)
    value = lambda n: (F.min_by if n in first else F.max_by)("value", own(n)).alias(n)
    rows = metrics.withColumn("tick", tick).where(F.col("name").isin(*names)).groupBy(key, "tick")
    found = rows.agg(*[value(n) for n in names], F.max("timestamp").alias("timestamp"), F.max("seq").alias("seq"), F.count_distinct("name").alias("_n"))
    return found.where(F.col("_n") == len(names)).drop("_n")


def host_outliers(vectors: DataFrame, features: list[str], floors: list[float], key: str = "host", min_vectors: int = MIN_VECTORS) -> DataFrame:
    """Squared Mahalanobis distance of each vector to its host's running mean and covariance, itself included."""
    order = Window.partitionBy(key).orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, 0)
    k = len(features)
    stats = {"n": F.count(F.lit(1)).over(order)} | {f"_m{i}": F.avg(f).over(order) for i, f in enumerate(features)}
    stats |= {f"_c{i}_{j}": F.covar_samp(features[i], features[j]).over(order) for i in range(k) for j in range(i, k)}
    df = vectors.withColumns(stats)
    names = [f"_m{i}" for i in range(k)] + [f"_c{i}_{j}" for i in range(k) for j in range(i, k)]

    @F.pandas_udf("d2 double, top int")
    def distance(*columns: pd.Series) -> pd.DataFrame:
        v = np.stack([c.to_numpy(float) for c in columns], 1)
        n, v = v[:, 0], v[:, 1:]
        x, mean, tri = v[:, :k], v[:, k : 2 * k], v[:, 2 * k :]
        cov = np.zeros((len(v), k, k))
        at = 0
        for i in range(k):
            for j in range(i, k):
                cov[:, i, j] = cov[:, j, i] = tri[:, at]
                at += 1
        for i, floor in enumerate(floors):
            cov[:, i, i] = np.maximum(cov[:, i, i], floor)
        delta = x - mean
        cov[n < min_vectors] = np.eye(k)  # not scored yet
        solved = (np.linalg.pinv(cov, hermitian=True) @ delta[..., None])[..., 0]
        part = delta * solved
        return pd.DataFrame({"d2": part.sum(1), "top": np.abs(part).argmax(1).astype(np.int32)})

    out = df.withColumn("_d", distance(F.col("n").cast("double"), *features, *names))
    top = F.get(F.array(*map(F.lit, features)), F.col("_d.top"))
    scored = out.select(*vectors.columns, "n", F.when(F.col("n") >= min_vectors, F.col("_d.d2")).alias("d2"), top.alias("top_feature"))
    return scored.withColumn("severity", F.when(F.col("d2") >= CRITICAL_D2, "critical").when(F.col("d2") >= WARN_D2, "warning"))


def episodes(findings: DataFrame, *keys: str, gap_seconds: int = 600) -> DataFrame:
    """Findings of a key in one episode while no more than gap_seconds lie between them."""
    order = Window.partitionBy(*keys).orderBy("timestamp", "seq")
    gap = F.unix_micros("timestamp") - F.lag(F.unix_micros("timestamp")).over(order)
    df = findings.withColumn("episode", F.sum(F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "episode").agg(F.min("timestamp").alias("opened"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("findings"))


def memory_percent(used: Column, limit: Column) -> Column:
    return F.when(limit == 0, 0.0).otherwise(used / limit * 100)


def seen_before(points: DataFrame, *keys: str, tick: str = "tick") -> DataFrame:
    """points of keys that were also there one tick earlier: a rate needs two sightings. tick: whole numbers."""
    before = F.lag(tick).over(Window.partitionBy(*keys).orderBy(tick))
    return points.withColumn("_before", before).where(F.col("_before") == F.col(tick) - 1).drop("_before")
