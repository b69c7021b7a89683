"""URL filter: host and path rules, and for the rest a logistic regression on hashed character n-grams (built-in SQL functions only).

The model is trained from a small labelled URL table (url, label; 1 allow, 0 block): `url_labels.LABELLED` unless another is
given, of which at most `max_urls` rows with the smallest hash are used. N-grams of host and path are hashed by Spark, both for
training and for judging; the gradient steps on those few rows run on the driver in plain Python. Scoring is one SQL expression
over a literal weight array. The rules take no part in the training.

A null url or one without :// has empty host and path: no rule fits and the model's bias decides. Without labelled rows of
both kinds the model answers with the kind that exists, allow if there is none. Of rules of equal length the one that sorts
first wins; a probability of just 0.5 allows. Rows are judged one by one, so repeated rows get equal answers, and a very long
url costs its length. An empty table gives an empty result. Other columns pass through; those named like the operator's own
(host, path, rule, verdict, allow_probability) are replaced.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.functions.text import let
from vane.llm.text_batches import free_name
from vane.llm.url_labels import LABELLED

BUCKETS = 1 << 15
#: (verdict, rule)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule), or null. Ties go to the rule that sorts first."""
    fits = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, tail = rule.partition("/")
        fit = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{tail}"))
        answer = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits = F.when(fit, answer) if fits is None else fits.when(fit, answer)
    return fits if fits is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the distinct 4- to 6-grams of ^host$ and ^path$, where a run of digits counts as 0."""

    def of(kind: str, text: Column, n: int) -> Column:
        hashed = lambda cs: F.transform(F.sequence(F.lit(1), F.size(cs) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(kind), F.slice(cs, i, n)), F.lit(buckets)).cast("int"))
        chars = F.split(F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$")), "")
        return let(chars, lambda cs: F.when(F.size(cs) >= n, hashed(cs)).otherwise(F.array().cast("array<int>")))

    return F.array_distinct(F.concat(*[of(kind, text, n) for kind, text in (("host", host), ("path", path)) for n in (4, 5, 6)]))


def fit_urls(labelled: DataFrame, max_urls: int = 2000, epochs: int = 40, rate: float = 2.0, buckets: int = BUCKETS) -> tuple[float, list[float]]:
    """Bias and weights. labelled: (url, label); null labels are ignored, repeated urls count once."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("label IS NOT NULL AND url IS NOT NULL").groupBy("url").agg(F.min("label").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(max_urls).select("label", host.alias("host"), path.alias("path")).select("label", grams(F.col("host"), F.col("path"), buckets).alias("grams")).collect()
    weights, bias = [0.0] * buckets, 0.0
    kinds = {int(r["label"]) for r in rows}
    if len(kinds) < 2:
        return (-4.0 if kinds == {0} else 4.0), weights
    order, rng = list(range(len(rows))), random.Random(7)
    for epoch in range(epochs):
        rng.shuffle(order)
        step = rate / (1 + epoch / 10)
        for k in order:
            active = rows[k]["grams"]
            scale = 1 / math.sqrt(len(active) or 1)
            z = bias + scale * sum(weights[g] for g in active)
            error = int(rows[k]["label"]) - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += step * error * 0.1
            for g in active:
                weights[g] += step * error * scale
    return bias, weights


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, max_urls: int = 2000, allowed_share: float = 0.7) -> DataFrame:
    """pages plus host, path, rule, allow_probability and verdict. labelled: (url, label), url_labels.LABELLED if none is given.

    The table holds as many urls of either kind, the web does not: allowed_share, the share of urls that one expects to allow, shifts the odds.
    """
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "allow_probability")]
    parsed = pages.select(*own, host.alias("host"), path.alias("path"))
    found, bag = free_name(own, "found"), free_name(own, "bag")
    if labelled is None:
        labelled = pages.sparkSession.createDataFrame(LABELLED, "url string, label int")
    bias, weights = fit_urls(labelled, max_urls)
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")  # a constant, folded once
    scored = parsed.select("*", rule_of(F.col("host"), F.col("path"), rules).alias(found), grams(F.col("host"), F.col("path")).alias(bag))
    total = F.aggregate(bag, F.lit(0.0), lambda a, g: a + F.get(table, g))
    prior = math.log(allowed_share / (1 - allowed_share))
    p = 1 / (1 + F.exp(-(F.lit(bias + prior) + total / F.sqrt(F.greatest(F.size(bag), F.lit(1))))))
    scored = scored.withColumn("allow_probability", p)
    return scored.select(*own, "host", "path", F.col(f"{found}.rule").alias("rule"), "allow_probability", F.coalesce(F.col(f"{found}.verdict"), F.when(F.col("allow_probability") >= 0.5, "allow").otherwise("block")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "allow_probability")
