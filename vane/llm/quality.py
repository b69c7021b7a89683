"""Quality rules as weak supervision (built-in SQL functions only).

Each rule votes good (1), bad (-1) or abstains (0). Documents are counted by vote pattern (at most 3^rules rows, whatever
the corpus), expectation-maximisation on those counts estimates each rule's accuracy and the share of good documents, and a
document is kept if its posterior probability of being good reaches `min_posterior`. No rule can fail a document alone,
except the two base rules of `base_failed`.

A null or empty text has no words, fails the base rules and is dropped. Ties at the posterior threshold are kept. Rows are
judged one by one, so repeated rows get equal results. A very long text is read whole, in time of its length but for sorting
its windows. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.functions.text import let
from vane.plans.shared import stored

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur twice or more in the row, the first occurrence included."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))

    def cover(h: Column) -> Column:
        def covered(s: Column) -> Column:  # s: (hash, position), sorted, so equal windows are neighbours
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return let(F.array_sort(F.transform(twice, lambda x: x["p"])), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))), F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered))

    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(let(hashes, cover))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers that the rules read, of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    without = lambda chars: F.length(F.regexp_replace(text, f"[{chars}]+", ""))
    base = docs.select("doc_id", text.alias("text"), words.alias("words"), lines.alias("lines"))
    text = F.col("text")
    n_chars = F.length(text)
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        without(r"\x20\x09-\x0D").cast("long").alias("word_chars"),
        (n_chars - without(r"#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_word_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        (n_chars - without("A-Z")).cast("long").alias("n_upper"),
        (n_chars - without("!?#*$%&|<>")).cast("long").alias("n_noise"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Rule name to vote; thresholds are those of common public web-text filters."""
    n, chars = F.col("n_words"), F.col("word_chars")
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    mean = chars / F.greatest(n, F.lit(1))
    return {
        "length": vote(n.between(50, 100_000), n < 20),
        "word_length": vote(mean.between(3, 10), (mean < 2) | (mean > 15)),
        "symbols": vote(F.col("n_symbols") == 0, F.col("n_symbols") > 0.1 * n),
        "noise": vote(F.col("n_noise") <= 0.02 * n, F.col("n_noise") > 0.3 * n),
        "dup_lines": vote((F.col("n_dup_lines") == 0) & (F.col("n_word_lines") >= 3), F.col("n_dup_lines") > 0.3 * F.col("n_word_lines")),
        "repeats": vote((F.col("n_repeat_words") == 0) & (n >= 50), F.col("n_repeat_words") > 0.2 * n),
        "variety": vote(F.col("n_distinct") >= 0.3 * n, F.col("n_distinct") < 0.15 * n),
        "case": vote(F.col("n_upper") <= 0.1 * chars, F.col("n_upper") > 0.3 * chars),
    }


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[float]]:
    """Share of good documents and each rule's accuracy by expectation-maximisation on pattern counts.

    Accuracies stay in [0.55, 0.98] and the share in [0.05, 0.95]: a rule may be weak but not turn into its opposite.
    """
    rules = len(patterns[0][0]) if patterns else 0
    share, accuracy = 0.8, [0.75] * rules
    for _ in range(rounds):
        total = good = 0.0
        right, cast = [1.5] * rules, [2.0] * rules  # a little prior weight, so an unused rule keeps 0.75
        for pattern, count in patterns:
            p = posterior(pattern, share, accuracy)
            total, good = total + count, good + count * p
            for j, v in enumerate(pattern):
                if v:
                    cast[j] += count
                    right[j] += count * (p if v > 0 else 1 - p)
        new = [min(0.98, max(0.55, r / c)) for r, c in zip(right, cast)]
        new_share = min(0.95, max(0.05, good / total)) if total else share
        done = abs(new_share - share) + sum(abs(a - b) for a, b in zip(new, accuracy)) < 1e-9
        share, accuracy = new_share, new
        if done:
            break
    return share, accuracy


def posterior(pattern: tuple[int, ...], share: float, accuracy: list[float]) -> float:
    odds = math.log(share / (1 - share)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge_quality(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, one vote column a rule, posterior and kept."""
    rules = votes()
    seen = stored(measures(docs).select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in rules.items()]), "quality")
    names = [f"vote_{k}" for k in rules]
    counted = seen.groupBy(*names).count().collect()  # at most 3^rules rows
    share, accuracy = fit_votes(sorted((tuple(r[n] for n in names), r["count"]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for name, a in zip(names, accuracy):
        odds = odds + F.col(name) * F.lit(math.log(a / (1 - a)))
    judged = seen.select("*", base_failed().alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
