"""Document fingerprints by winnowing (built-in SQL functions only).

A text is read as pieces: runs of at most `PIECE` code points other than white space, so that text without spaces has pieces too. Every
run of `k` pieces has a rolling hash (polynomial, modulo 2^31 - 1, powers of two joined to k), every window of `w` following
hashes gives its smallest, the rightmost of equal ones. A fingerprint is the list of what was chosen, each hash once for each place, with
its position (number of its first piece). So texts that share k + w - 1 pieces in a row share a hash, with the positions in both.

Pieces become numbers at once, which are worked off in stretches that overlap. An entry is one long: the hash above, the position
below and counted down, so that the least long is the rightmost of the smallest hashes.

The query compares each document with the next one (descending doc_id, after the last the first) and with its own edited text: its
first half, then the beginning of the next text. The order is dealt by ranges of (doc_id, text): range ends from approximate
quantiles, each range a window of its own that also holds a copy of the row after it. Texts are shuffled once, with their fingerprints.

Definitions. A null text is read as empty. A text without pieces has an empty fingerprint; one of fewer than k pieces is one run; one
of fewer than w runs is one window. White space is [\\x20\\x09-\\x0D]; case counts. Likeness is the share of hashes in common (Jaccard, of distinct
hashes), 1 for two empty fingerprints. Rows of one doc_id are ordered by a hash of their text, and rows without one come last;
repeated rows follow each other. A single row is followed by itself. doc_id is a whole number. A very long text costs its length, and its
pieces are held by one task. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vane.functions.text import let

#: Pieces of a run, runs of a window, code points of a piece, and runs that are worked off at once.
K, W, PIECE, STRETCH = 3, 6, 8, 4_096
MODULUS, BASE, SHIFT = 2**31 - 1, 1_234_567_891, 2**32
END = 2**30  # as a length: to the end
#: Ranges of the document order for each shuffle partition.
RANGES = 8


def long(v: int) -> Column:
    return F.lit(v).cast("long")


def behind(a: Column, n: int) -> Column:
    return F.slice(a, n + 1, END)


def piece_numbers(text: Column) -> Column:
    """A number below 2^30 for each piece of a text."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))
    return F.transform(pieces, lambda p: F.xxhash64(p).bitwiseAND(long(2**30 - 1)))


def run_hashes(numbers: Column, k: int, then) -> Column:
    """then(hashes of all runs of k numbers); the last k - 1 values are null."""
    joined = lambda a, b, n, m: F.zip_with(a, behind(b, n), lambda x, y: (x * long(pow(BASE, m, MODULUS)) + y) % long(MODULUS))  # noqa: E731  runs of n, then of m

    def grown(done: Column | None, done_n: int, part: Column, n: int) -> Column:
        """part: hashes of runs of n, a power of two; done: hashes of runs of done_n, the bits of k below n."""
        if n > k:
            return done
        doubled = lambda d, m: d if 2 * n > k else let(joined(part, part, n, n), lambda p: grown(d, m, p, 2 * n))
        if not k & n:
            return doubled(done, done_n)
        return doubled(part, n) if done is None else let(joined(part, done, n, done_n), lambda d: doubled(d, done_n + n))

    return let(numbers, lambda a: let(grown(None, 0, a, 1), then))


def window_minima(values: Column, w: int, then) -> Column:
    """then(the least of every w following values); the last w - 1 are of shorter windows."""
    def grown(part: Column, n: int) -> Column:
        if n == w:
            return then(part)
        step = min(n, w - n)
        return let(F.zip_with(part, behind(part, step), lambda x, y: F.when(y < x, y).otherwise(x)), lambda p: grown(p, n + step))

    return grown(values, 1)


def stretch_entries(numbers: Column, first: Column, k: int, w: int) -> Column:
    """Entries of at least k numbers that begin at position first."""
    def entries(hashes: Column) -> Column:
        runs = F.slice(hashes, 1, F.size(hashes) - (k - 1))
        last = long(SHIFT - 1) - first
        packed = lambda r: F.zip_with(r, F.sequence(last, last - F.size(r) + 1, long(-1)), lambda h, at: h * long(SHIFT) + at)
        # a window's choice lies behind the one before or is the same, so distinct entries stay in order
        return let(let(runs, packed), lambda p: window_minima(p, w, lambda m: F.array_distinct(F.slice(m, 1, F.greatest(F.lit(1), F.size(p) - (w - 1))))))

    return run_hashes(numbers, k, entries)


def winnowed(text: Column, k: int = K, w: int = W, stretch: int = STRETCH) -> Column:
    """The text's entries, in order of position."""
    t = k + w - 1

    def of(numbers: Column) -> Column:
        n = F.size(numbers)
        starts = F.sequence(F.lit(0), F.floor(F.greatest(n - t, F.lit(0)) / stretch).cast("int"))
        each = F.transform(starts, lambda i: stretch_entries(F.slice(numbers, i * stretch + 1, F.lit(stretch + t - 1)), (i * stretch).cast("long"), k, w))
        short = F.array(F.xxhash64(numbers).bitwiseAND(long(2**30 - 1)) * long(SHIFT) + long(SHIFT - 1))
        return F.when(n >= k, F.array_distinct(F.flatten(each))).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(piece_numbers(text), of)


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry, 32)


def position_of(entry: Column) -> Column:
    return long(SHIFT - 1) - entry.bitwiseAND(long(SHIFT - 1))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    hashes = lambda e: F.array_distinct(F.transform(e, hash_of))

    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(n / (F.size(x) + F.size(y) - n)))

    return let(hashes(a), lambda x: let(hashes(b), lambda y: of(x, y)))


def fingerprint_text(entries: Column) -> Column:
    """hash:position of every entry, comma-joined."""
    return F.array_join(F.transform(entries, lambda x: F.concat(F.lower(F.hex(hash_of(x))), F.lit(":"), position_of(x).cast("string"))), ",")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """docs plus fingerprint: a list of (hash, position)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("fingerprint", F.transform(winnowed(text, k, w), lambda x: F.struct(hash_of(x).alias("hash"), position_of(x).alias("position"))))


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """rows plus next_<column>s: those of the row that follows by (key, tie) descending, after the last those of the first.

    key and tie: longs without nulls. Many rows of one key are dealt by their tie.
    """
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0]  # n numbers
    if ends is None:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = F.split(F.lit(",".join(map(str, ends))), ",").cast("array<bigint>")  # folded once
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(ends).bit_length()))])
    below = lambda holds: F.aggregate(steps, F.lit(0), lambda at, s: F.when(holds(F.get(bounds, at + s - 1)), at + s).otherwise(at))
    lo, hi = below(lambda b: b < F.col(key)), below(lambda b: b <= F.col(key))
    spread = F.floor((F.col(tie).cast("double") / 2.0**64 + 0.5) * (hi - lo + 1)).cast("int")
    rows = rows.withColumn("slot", F.least(lo + spread, hi))
    tops = sorted(rows.groupBy("slot").agg(F.max(F.struct(key, tie)).alias("top")).select("slot", f"top.{key}", f"top.{tie}").collect())  # a row a range
    guests = [(k, t, tops[(i + 1) % len(tops)][0]) for i, (_, k, t) in enumerate(tops)]
    joined = rows.join(F.broadcast(spark.createDataFrame(guests, f"{key} long, {tie} long, guest int")), [key, tie], "left")
    own, copy = F.struct(F.col("slot").alias("at"), F.lit(False).alias("is_copy")), F.struct(F.col("guest").alias("at"), F.lit(True).alias("is_copy"))
    dealt = joined.withColumn("_p", F.explode(F.when(F.col("guest").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    dealt = dealt.select(*[c for c in rows.columns if c != "slot"], "_p.at", "_p.is_copy")
    order = Window.partitionBy("at").orderBy("is_copy", F.desc(key), F.desc(tie))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("is_copy")).drop("at", "is_copy")


def edited_fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited (text), entries, edited_entries, next_entries of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), long(-(2**63))).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = with_next(rows.withColumn("entries", winnowed(F.col("text"), k, w)), "key", "tie", ["text", "entries"])
    n = F.length("text")
    rows = rows.withColumns({"n_chars": n.cast("long"), "keep": n - F.floor(n / 2).cast("int"), "taken": F.least(F.floor(n / 2).cast("int"), F.length("next_text"))})
    c = F.col
    edited = F.concat(F.substring(c("text"), F.lit(1), c("keep")), F.substring(c("next_text"), F.lit(1), c("taken")))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), "entries", "next_entries")
    return rows.withColumn("edited_entries", winnowed(F.col("edited"), k, w))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), fingerprint_text(F.col("entries")).alias("fingerprint"), fingerprint_text(F.col("edited_entries")).alias("edited_fingerprint"),
        likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
