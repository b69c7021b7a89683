"""Severity of log lines: naive Bayes over hashed tokens, with the word rule as fallback."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vane.functions.text import FNV_OFFSET, FNV_PRIME, LEVELS, TOKEN_BUCKETS, fallback_severity
from vane.operators.bursts import recent_accuracy
from vane.plans.ranges import range_of
from vane.plans.shared import stored

TOKEN = re.compile(r"[A-Za-z0-9]{2,}")
SMOOTH = 0.5
MIN_LINES, MIN_CLASS, LEAD, GRADED, CONFIDENT = 200, 20, 0.01, 500, 0.6


class Buckets(dict):
    """Token to FNV-1a bucket; emptied when large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = FNV_OFFSET
        for b in token.encode():
            h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFF
        self[token] = h % TOKEN_BUCKETS
        return self[token]


def buckets_of(message: Column, limit: int | None, max_bytes: int | None) -> Column:
    """The buckets of severity_tokens, as an Arrow function: several times faster than the same hash as nested array expressions."""

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        known = hashed.__dict__.setdefault("known", Buckets())
        out = []
        for text in texts:
            text = text or ""
            if max_bytes is not None:
                text = text.encode("utf-8", "surrogatepass")[:max_bytes].decode("latin-1")
            found = [known[t.lower()] for t in TOKEN.findall(text) if not t.isdigit()]
            out.append(found if limit is None else found[:limit])
        return pd.Series(out)

    return hashed(message)


def severity_fit(declared: DataFrame, *keys: str, limit: int | None = None, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, severity, bucket, hits) and (keys, severity, lines, tokens): counts of the declared lines. Only the four known levels count, so both are small."""
    lines = declared.where(F.col("severity").isin(*LEVELS) & (F.trim("message") != ""))
    tokens = lines.select(*keys, "severity", F.explode(buckets_of(F.col("message"), limit, max_bytes)).alias("bucket"))
    hits = tokens.groupBy(*keys, "severity", "bucket").agg(F.count(F.lit(1)).alias("hits"))
    classes = lines.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("lines")).join(hits.groupBy(*keys, "severity").agg(F.sum("hits").alias("tokens")), [*keys, "severity"], "left").fillna(0, ["tokens"])
    return hits, classes


NAMES = sorted(LEVELS)  # ties go by name


def best_of(scores: dict[str, Column], usable: Column) -> list[Column]:
    """predicted and confidence (the winner's share) from a score a level, null where the level was never seen."""
    top = F.greatest(*scores.values())
    name = F.coalesce(*[F.when(s == top, level) for level, s in scores.items()])
    share = F.try_divide(F.lit(1.0), sum((F.coalesce(F.exp(s - top), F.lit(0.0)) for s in scores.values()), F.lit(0.0)))
    return [F.when(usable, name).alias("predicted"), F.when(usable, share).alias("confidence")]


def summed(bag: Column, prior: float, logs: Column) -> Column:
    return F.aggregate(bag, F.lit(prior), lambda a, b: a + F.get(logs, b))


def severity_score(lines: DataFrame, hits: DataFrame, classes: DataFrame, min_confidence: float = CONFIDENT, limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """lines plus predicted, confidence and answer (the model's, or the rule's where the model is unsure). A line without tokens has no prediction.

    The model is four levels times 4,096 buckets, so it goes into the plan as constants: one expression a line, no shuffle.
    """
    sizes = {r["severity"]: r for r in classes.collect()}  # four rows at most
    seen: dict[str, dict[int, int]] = {}
    for r in hits.collect():  # 4 x 4,096 rows at most
        seen.setdefault(r["severity"], {})[r["bucket"]] = r["hits"]
    every = sum(r["lines"] for r in sizes.values())
    bag = F.col("_bag")
    scores = {}
    for level in NAMES:
        if level not in sizes:
            continue
        total = sizes[level]["tokens"] + SMOOTH * TOKEN_BUCKETS
        logs = F.split(F.lit(",".join(repr(math.log((seen.get(level, {}).get(b, 0) + SMOOTH) / total)) for b in range(TOKEN_BUCKETS))), ",").cast("array<double>")  # folded once
        scores[level] = summed(bag, math.log(sizes[level]["lines"] / every), logs)
    out = lines.withColumn("_bag", buckets_of(F.col("message"), limit, max_bytes))
    if not scores:
        out = out.withColumns({"predicted": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    else:
        out = out.withColumns({f"_s{level}": s for level, s in scores.items()}).select("*", *best_of({level: F.col(f"_s{level}") for level in scores}, F.size(bag) > 0))
    answer = F.coalesce(F.when(F.col("confidence") >= min_confidence, F.col("predicted")), fallback_severity(F.col("message")))
    return out.select(*lines.columns, "predicted", "confidence", answer.alias("answer"))


def counted_buckets(message: Column, limit: int | None, max_bytes: int | None) -> Column:
    """The distinct buckets of a message's tokens with their counts k, as bucket + TOKEN_BUCKETS * k."""

    @F.pandas_udf("array<bigint>")
    def counted(texts: pd.Series) -> pd.Series:
        known = counted.__dict__.setdefault("known", Buckets())
        out = []
        for text in texts:
            text = text or ""
            if max_bytes is not None:
                text = text.encode("utf-8", "surrogatepass")[:max_bytes].decode("latin-1")
            found = [known[t.lower()] for t in TOKEN.findall(text) if not t.isdigit()]
            out.append([b + TOKEN_BUCKETS * k for b, k in Counter(found if limit is None else found[:limit]).items()])
        return pd.Series(out)

    return counted(message)


def severity_prequential(lines: DataFrame, *ids: str, limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """ids, severity, predicted, confidence, hit and rule_hit of the declared lines: each line judged by what all lines before it
    (in order of ids, the first a whole number) taught, and nothing else.

    Counts before a line are sums in two levels: over earlier ranges of the order, and over the rows before it in its own range.
    So the windows are a range, or a bucket's rows in a range. A line before which no level was seen, or without tokens, has no prediction.
    """
    declared = lines.where(F.col("severity").isin(*LEVELS) & (F.trim("message") != ""))
    bag = counted_buckets(F.col("message"), limit, max_bytes)
    own = stored(declared.select(*ids, "severity", (fallback_severity(F.col("message")) == F.col("severity")).alias("rule_hit"), bag.alias("_bag")), "declared-lines")
    own = own.withColumns({"_range": range_of(own, ids[0]), "_n": F.aggregate("_bag", F.lit(0).cast("long"), lambda a, x: a + F.floor(x / TOKEN_BUCKETS))})
    only = lambda level, c: F.sum(F.when(F.col("severity") == level, c).otherwise(0))
    sums = {f"{p}{n}": only(n, c) for n in NAMES for p, c in (("_l", F.lit(1)), ("_t", F.col("_n")))}

    def before(rows: DataFrame, found: dict[str, Column], *keys: str) -> DataFrame:
        """rows plus the sums over all rows of their keys before them."""
        parts = rows.groupBy(*keys, "_range").agg(*[c.alias(f"{k}p") for k, c in found.items()])
        earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(*keys, "_range", *[F.coalesce(F.sum(f"{k}p").over(earlier), F.lit(0)).alias(f"{k}p") for k in found])
        inside = Window.partitionBy(*keys, "_range").orderBy(*ids).rowsBetween(Window.unboundedPreceding, -1)
        within = rows.withColumns({k: F.coalesce(c.over(inside), F.lit(0)) for k, c in found.items()})
        return within.join(parts, [*keys, "_range"]).withColumns({k: F.col(k) + F.col(f"{k}p") for k in found}).drop(*[f"{k}p" for k in found])

    cells = own.select(*ids, "severity", "_range", F.explode("_bag").alias("_x")).select(*ids, "severity", "_range", (F.col("_x") % TOKEN_BUCKETS).alias("_bucket"), F.floor(F.col("_x") / TOKEN_BUCKETS).alias("_k"))
    cells = before(cells, {f"_c{n}": only(n, F.col("_k")) for n in NAMES}, "_bucket")
    gains = cells.groupBy(*ids).agg(*[F.sum(F.col("_k") * F.log(F.col(f"_c{n}") + SMOOTH)).alias(f"_g{n}") for n in NAMES])
    j = before(own.drop("_bag"), sums).join(gains, list(ids), "left")
    every = sum((F.col(f"_l{n}") for n in NAMES), F.lit(0))
    score = lambda n: F.when(F.col(f"_l{n}") > 0, F.log(F.col(f"_l{n}") / every) + F.col(f"_g{n}") - F.col("_n") * F.log(F.col(f"_t{n}") + SMOOTH * TOKEN_BUCKETS))
    j = j.withColumns({f"_s{n}": score(n) for n in NAMES})
    scored = j.select(*ids, "severity", "rule_hit", *best_of({n: F.col(f"_s{n}") for n in NAMES}, F.col("_n") > 0))
    return scored.select(*ids, "severity", "predicted", "confidence", (F.col("predicted") == F.col("severity")).alias("hit"), "rule_hit")


def readiness(graded: DataFrame, classes: DataFrame, *order: str, last: int = GRADED) -> DataFrame:
    """One row: trained lines, accuracy of the model and of the rule over the newest graded lines, and whether the model may answer."""
    acc = recent_accuracy(graded.where("predicted IS NOT NULL"), order=order, last=last)
    size = classes.agg(F.sum("lines").alias("trained"), F.count_if(F.col("lines") >= MIN_CLASS).alias("_large"))
    ready = (F.col("trained") >= MIN_LINES) & (F.col("_large") >= 2) & (F.col("accuracy") >= F.col("rule_accuracy") + LEAD)
    return acc.join(size).withColumn("ready", F.coalesce(ready, F.lit(False))).drop("_large")


def classify(scored: DataFrame, ready: DataFrame, min_confidence: float = CONFIDENT) -> DataFrame:
    """scored plus severity_answer and answered_by: the model's answer while it is ready (one row with ready) and sure, else the rule's."""
    kept = scored.columns
    scored = scored.join(F.broadcast(ready.select(F.col("ready").alias("_ready"))))  # one row
    model = F.when(F.col("_ready") & (F.col("confidence") >= min_confidence), F.col("predicted"))
    return scored.select(*kept, F.coalesce(model, fallback_severity(F.col("message"))).alias("severity_answer"), F.when(model.isNotNull(), "model").otherwise("rule").alias("answered_by"))
