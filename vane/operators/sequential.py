"""Order-dependent estimators: streaming quantile markers, learned thresholds, Holt's trend and the budget's exhaustion."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vane.plans.ordered import ordered_scan


class P2:
    """Jain and Chlamtac's quantile from five markers (Communications of the ACM, 1985)."""

    def __init__(self, p: float):
        self.p, self.n = p, 0
        self.q: list[float] = []
        self.at = [1, 2, 3, 4, 5]
        self.step = (0.0, p / 2, p, (1 + p) / 2, 1.0)

    def observe(self, x: float) -> None:
        self.n += 1
        if self.n <= 5:
            self.q = sorted([*self.q, x])
            return
        q, at = self.q, self.at
        cell = next((i for i in range(3) if x < q[i + 1]), 3)
        q[0], q[4] = min(q[0], x), max(q[4], x)
        for i in range(cell + 1, 5):
            at[i] += 1
        for i in (1, 2, 3):
            want = 1 + (self.n - 1) * self.step[i]
            gap = want - at[i]
            if (gap >= 1 and at[i + 1] > at[i] + 1) or (gap <= -1 and at[i] > at[i - 1] + 1):
                s = 1 if gap > 0 else -1
                up, down = (q[i + 1] - q[i]) / (at[i + 1] - at[i]), (q[i] - q[i - 1]) / (at[i] - at[i - 1])
                moved = q[i] + s / (at[i + 1] - at[i - 1]) * ((at[i] - at[i - 1] + s) * up + (at[i + 1] - at[i] - s) * down)
                if not q[i - 1] < moved < q[i + 1]:
                    moved = q[i] + (up if s > 0 else -down)
                q[i] = moved
                at[i] += s

    def value(self) -> float:
        if not self.q:
            return math.nan
        return self.q[2] if self.n >= 5 else self.q[min(len(self.q) - 1, int(self.p * len(self.q)))]


def kinds_of(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def p2_quantiles(df: DataFrame, value: str, *keys: str, p: float = 0.99, scan=ordered_scan) -> DataFrame:
    """The marker estimate of each key, in (timestamp, seq) order."""
    at = len(keys) + 2
    rows = df.select(*keys, "timestamp", "seq", value)
    return scan(rows, list(keys), ["timestamp", "seq"], lambda: P2(p), lambda e, row: e.observe(row[at]), f"{kinds_of(df, *keys)}, n bigint, quantile double", lambda e, key: [(*key, e.n, e.value())])


WARN_P, PAGE_P, FLOOR, CEILING = 0.999, 0.9999, 2.0, 12.0


class Thresholds:
    """A key's limits on |z|, learned from its past."""

    def __init__(self, warn_from: int, page_from: int):
        self.warn, self.page, self.n = P2(WARN_P), P2(PAGE_P), 0
        self.warn_from, self.page_from = warn_from, page_from

    def limits(self) -> tuple[float, float]:
        bound = lambda v: min(CEILING, max(FLOOR, v))
        warn = bound(self.warn.value()) if self.n >= self.warn_from else 3.0
        page = bound(self.page.value()) if self.n >= self.page_from else 5.0
        return warn, max(warn, page)

    def observe(self, z: float) -> tuple[float, float]:
        """The limits in force for this point, which then moves them."""
        now = self.limits()
        self.n += 1
        self.warn.observe(z)
        self.page.observe(z)
        return now


def learned_thresholds(scored: DataFrame, *keys: str, warn_from: int = 2_000, page_from: int = 20_000, scan=ordered_scan) -> DataFrame:
    """keys, timestamp, seq, z, warn, critical, severity: each scored point with the limits in force when it came, and its verdict by them.

    Limits are five-marker estimates of the 0.999 and 0.9999 quantiles of the key's earlier |z|, fixed values until there are
    enough points, within [2, 12].
    """
    at = len(keys)

    def step(limits: Thresholds, row: tuple) -> list[tuple]:
        warn, page = limits.observe(abs(row[at + 2]))
        z = abs(row[at + 2])
        return [(*row, warn, page, "critical" if z >= page else "warning" if z >= warn else None)]

    rows = scored.where("z IS NOT NULL").select(*keys, "timestamp", "seq", "z")
    return scan(rows, list(keys), ["timestamp", "seq"], lambda: Thresholds(warn_from, page_from), step, f"{kinds_of(rows, *rows.columns)}, warn double, critical double, severity string")


#: Bins of |z| for each unit, up to CEILING.
FINE = 100


def daily_thresholds(scored: DataFrame, *keys: str, warn_from: int = 2_000, page_from: int = 20_000) -> DataFrame:
    """learned_thresholds for hot keys: each day's limits are the quantiles of the key's |z| on all days before it.

    |z| is counted in bins of 0.01, which add up over days, so no task holds a key; a limit is the upper edge of its bin, exact to
    the bin. A day's limits do not move within the day. Before there are enough points, and within [2, 12], as there.
    """
    day = F.to_date("timestamp")
    rows = scored.where("z IS NOT NULL").select(*keys, "timestamp", "seq", "z").withColumn("_day", day)
    bins = F.floor(F.least(F.abs("z"), F.lit(CEILING)) * FINE).cast("int")
    named = [F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]
    ids = [f"_{i}" for i in range(len(keys))]
    counts = rows.select(*named, "_day", bins.alias("_bin")).groupBy(*ids, "_day", "_bin").agg(F.count(F.lit(1)).alias("_c"))
    # a row for each day and each bin that the key ever has: at most 1,201 a day
    tagged = lambda df, c: df.select(F.struct(*ids, F.lit(0)).alias("_key"), *c)
    counts = tagged(counts, ["_day", "_bin", "_c"])
    grid = counts.select("_key", "_day").distinct().join(counts.select("_key", "_bin").distinct(), "_key").join(counts, ["_key", "_day", "_bin"], "left")
    past = Window.partitionBy("_key", "_bin").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("_h", F.coalesce(F.sum("_c").over(past), F.lit(0)))
    upto = Window.partitionBy("_key", "_day").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumns({"_cum": F.sum("_h").over(upto), "_n": F.sum("_h").over(Window.partitionBy("_key", "_day"))})
    edge = lambda p: F.min(F.when(F.col("_cum") >= p * F.col("_n"), (F.col("_bin") + 1) / FINE))
    bound = lambda c: F.least(F.greatest(c, F.lit(FLOOR)), F.lit(CEILING))
    limits = grid.groupBy("_key", "_day").agg(F.max("_n").alias("_n"), edge(WARN_P).alias("_w"), edge(PAGE_P).alias("_p"))
    warn = F.when(F.col("_n") >= warn_from, bound(F.col("_w"))).otherwise(3.0)
    page = F.when(F.col("_n") >= page_from, bound(F.col("_p"))).otherwise(5.0)
    limits = limits.select(*[F.col(f"_key.{i}").alias(i) for i in ids], F.col("_day").alias("_on"), warn.alias("warn"), F.greatest(warn, page).alias("critical"))
    j = rows.join(limits, [*[F.col(k).eqNullSafe(F.col(i)) for k, i in zip(keys, ids)], F.col("_day") == F.col("_on")])
    verdict = F.when(F.abs("z") >= F.col("critical"), "critical").when(F.abs("z") >= F.col("warn"), "warning")
    return j.select(*keys, "timestamp", "seq", "z", "warn", "critical", verdict.alias("severity"))


def threshold_rates(graded: DataFrame, *keys: str) -> DataFrame:
    """Points, share of warnings and of pages by key, and the last limits: what a calibration does, which has no labels."""
    last = F.struct("timestamp", "seq")
    share = lambda c: F.avg((F.abs("z") >= F.col(c)).cast("double"))
    return graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), share("warn").alias("warn_rate"), share("critical").alias("page_rate"), F.max_by("warn", last).alias("warn"), F.max_by("critical", last).alias("critical"))


LEVEL, TREND = 0.3, 0.1


def variance_ratio(h: float, a: float = LEVEL, b: float = TREND) -> float:
    """Variance of the h-step error against the one-step error of Holt's method, in closed form."""
    m = max(h - 1, 0.0)
    s1, s2 = m * (m + 1) / 2, m * (m + 1) * (2 * m + 1) / 6
    return 1 + a * a * (m + 2 * b * s1 + b * b * s2)


class Burn:
    """Level and trend of the spent budget, the errors of their one-step forecasts and the cadence of the readings."""

    def __init__(self) -> None:
        self.n, self.level, self.trend, self.last, self.at = 0, 0.0, 0.0, 0.0, None
        self.mse = self.cadence = 0.0
        self.wins: list[bool] = []

    def decayed(self, old: float, new: float) -> float:
        """A mean whose newest value weighs 1 / n, but never under 0.05."""
        w = max(0.05, 1 / max(self.n, 1))
        return old + w * (new - old)

    def observe(self, at: float, spent: float) -> None:
        if not math.isfinite(spent):
            return
        if self.n:
            error = spent - self.level - self.trend
            self.wins = [*self.wins[-199:], abs(error) < abs(spent - self.last)]
            self.mse = self.decayed(self.mse, error * error)
            if at > self.at:
                self.cadence = self.decayed(self.cadence, at - self.at)
        if self.n < 2:
            self.trend, self.level = (spent - self.level if self.n else 0.0), spent
        else:
            before = self.level
            self.level = LEVEL * spent + (1 - LEVEL) * (before + self.trend)
            self.trend = TREND * (self.level - before) + (1 - TREND) * self.trend
        self.n, self.last, self.at = self.n + 1, spent, at

    def exhausted(self, min_readings: int, horizon: float) -> tuple[float | None, float | None]:
        """Seconds until all is spent, soonest and latest (0: beyond the horizon); two nulls where nothing can be said."""
        none = (None, None)
        if self.n < min_readings:
            return none
        if self.last >= 100:
            return 0.0, 0.0
        if self.cadence <= 0:
            return none
        left = 100 - self.level
        if left <= 0:
            return 0.0, 0.0
        if self.trend <= 0 or left / self.trend * self.cadence > 2 * horizon:
            return none
        steps = left / self.trend
        band = 2 * math.sqrt(self.mse * variance_ratio(steps)) / steps
        if band >= self.trend:  # the trend does not stand out of the errors
            return none
        soon, late = (left / (self.trend + b) * self.cadence for b in (band, -band))
        return none if soon > horizon else (soon, late if late <= horizon else 0.0)


def burn_forecast(readings: DataFrame, *keys: str, min_readings: int = 20, horizon_hours: float = 48.0, seconds: str = "seconds", value: str = "consumed", scan=ordered_scan) -> DataFrame:
    """Level and trend of the spent budget, when it is used up (soonest and latest in seconds, see Burn), and skill: the share of the last 200 steps where the trend was nearer than persistence."""
    k = len(keys)

    def end(b: Burn, key: tuple) -> list[tuple]:
        return [(*key, b.n, b.level, b.trend, *b.exhausted(min_readings, horizon_hours * 3600), sum(b.wins) / len(b.wins) if b.wins else None)]

    schema = f"{kinds_of(readings, *keys)}, readings bigint, level double, trend double, soonest double, latest double, skill double"
    return scan(readings.select(*keys, seconds, value), list(keys), [seconds], Burn, lambda b, row: b.observe(row[k], row[k + 1]), schema, end)


class Holt:
    """Level and trend of a series, and its last time."""

    def __init__(self) -> None:
        self.level, self.trend, self.at = None, 0.0, None

    def observe(self, at, y: float) -> None:
        before = self.level
        self.level = y if before is None else LEVEL * y + (1 - LEVEL) * (before + self.trend)
        if before is not None:
            self.trend = TREND * (self.level - before) + (1 - TREND) * self.trend
        self.at = at


def metric_forecast(minutes: DataFrame, horizons: tuple[int, ...] = (5, 15, 30, 60), scan=ordered_scan) -> DataFrame:
    """Holt's forecast of every series (name, at, value) some minutes ahead. A task streams series and holds the level and trend of one."""
    def end(h: Holt, key: tuple) -> list[tuple]:
        return [(*key, h.at + timedelta(minutes=m), h.level + m * h.trend) for m in horizons]

    return scan(minutes.select("name", "at", "value"), ["name"], ["at"], Holt, lambda h, row: h.observe(row[1], row[2]), "name string, at timestamp, value double", end)
