"""How far the sources of a language differ in their terms, over duplicate-free texts.

1. Identical texts of a language are one class, named by 128 bits of hash, with its rows counted by source. Texts are
   deduplicated before and after the shuffle, so a large group of copies travels once a task. The counts join the classes.
2. Each class is tokenized once. A task counts its terms by (lang, source), each weighted by the class's rows of that source: occurrences
   and document frequencies. The partial counts are dealt by (lang, term), added up, and the terms of at least `min_docs` documents of a language kept.
3. Pairs of sources are evaluated sparsely. A sum over all V terms of a language is what the one source's terms give against the other's
   value for absent terms, the same turned round, a constant for all other terms, and a correction for the terms that both have. The first two need only how many
   terms of a source have each count; only the last looks at terms, whose lists of sources tasks pair with partial sums by pair of sources.

Definitions. Null text, lang and source are read as ''. Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z
lower-cased. With V kept terms, a group's N occurrences of them, and count of one of them: p = 1 + floor(10^9 (count + 1) / (N + V));
f(p, q) = floor((p - q)^2 / q). All numbers are exact (decimals of 38 digits where a product can pass 64 bits). Empty and
null texts make their group occur and have no terms. Repeated rows count each for itself. A very long text costs its length.
Ties of value go by item in UTF-8 order. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vane.llm.text_batches import ascii_terms, sliced
from vane.plans.shared import stored

UNIT = 1_000_000_000
#: Entries of a task's partial counts, and pairs evaluated at once; beyond them a task emits what it has.
TASK_ENTRIES, TASK_PAIRS = 1_500_000, 400_000
#: Sources of a batch up to which sums by pair are a square array.
DENSE = 500
#: Groups up to this many are sent to all executors; more are joined by shuffle.
MAX_BROADCAST_GROUPS = 100_000
TABLE = ascii_terms(digits=False)


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, h1, h2, text, sources) a distinct text of a language, sources a list of (source, n); and (lang, source) of every group."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    key = ["lang", "h1", "h2"]
    mult = stored(rows.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n")), "source-counts")
    lists = mult.groupBy(*key).agg(F.collect_list(F.struct("source", "n")).alias("sources"))  # as long as there are sources
    texts = rows.where(F.col("text") != "").select(*key, "text").dropDuplicates(key)
    return texts.join(lists.hint("merge"), key), mult.select("lang", "source").distinct()


class Words(dict):
    """Word to number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def term_lists(keys: list[np.ndarray], occurrences: list[np.ndarray], documents: list[np.ndarray], words: pa.Array, sources: pa.Array, lang: str) -> pa.RecordBatch:
    """lang, term, df, entries (source, n) of a language's counts; a key is word number * 2^31 + source number."""
    key, n, df = map(np.concatenate, (keys, occurrences, documents))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n, df, key = np.add.reduceat(n[order], first), np.add.reduceat(df[order], first), key[first]
    word = key >> 31
    term = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    entries = pa.StructArray.from_arrays([sources.take(pa.array(key & (2**31 - 1))), pa.array(n)], ["source", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(term, len(key)), pa.int32()), entries)
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(term), np.int32)))
    return pa.RecordBatch.from_arrays([langs, words.take(pa.array(word[term])), pa.array(np.add.reduceat(df, term)), lists], ["lang", "term", "df", "entries"])


def weighted_counts(classes: DataFrame) -> DataFrame:
    """lang, term, df (documents), entries (source, n occurrences): partial sums, several rows a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sources, held, size = Words(), Words(), {}, 0

        def emptied() -> Iterator[pa.RecordBatch]:
            names = [pa.array(list(x), pa.binary()).cast(pa.string()) for x in (words, sources)]
            for lang, parts in held.items():
                yield term_lists(*parts, *names, lang)
            for x in (words, sources, held):
                x.clear()

        for batch in (x for b in batches for x in sliced([b], "text")):
            for lang, text, groups in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("sources").to_pylist()):
                found = text.translate(TABLE).split()
                if not found:
                    continue
                word, times = np.unique(np.array(list(map(words.__getitem__, found)), np.int64), return_counts=True)
                parts = held.setdefault(lang, ([], [], []))
                for g in groups:
                    parts[0].append((word << 31) + sources[g["source"].encode("utf-8", "surrogatepass")])
                    parts[1].append(times * g["n"])
                    parts[2].append(np.full(len(word), g["n"], np.int64))
                size += len(word) * len(groups)
                if size > TASK_ENTRIES:
                    yield from emptied()
                    size = 0
        yield from emptied()
        pa.default_memory_pool().release_unused()

    return classes.select("lang", "text", "sources").mapInArrow(run, "lang string, term string, df bigint, entries array<struct<source: string, n: bigint>>")


def kept_terms(classes: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, total, entries (source, n) of the terms in at least min_docs documents of their language."""
    parts = weighted_counts(classes).repartition("lang", "term")  # summed by task already; what follows uses this dealing
    df = F.sum("df").over(Window.partitionBy("lang", "term"))
    enough = parts.withColumn("all_df", df).where(F.col("all_df") >= min_docs)  # most terms are rare and go here
    cells = enough.select("lang", "term", F.explode("entries").alias("e")).groupBy("lang", "term", "e.source").agg(F.sum("e.n").alias("n"))
    return cells.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count among N occurrences of V kept terms."""
    top = F.lit(UNIT).cast("decimal(12,0)") * (count + 1).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", top.cast("decimal(38,0)"), (n + v).cast("decimal(38,0)"))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """f(p, q): both are at most 10^9 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def sized(small: DataFrame, rows: int) -> DataFrame:
    """small as a broadcast side if its counted rows are few, else by shuffle."""
    return F.broadcast(small) if rows <= MAX_BROADCAST_GROUPS else small.hint("merge")


def shared_terms(cells: DataFrame) -> DataFrame:
    """lang, source, item, both, fix: for each pair of sources the terms that both have and the sum of f(p,q) - f(p,q0) - f(p0,q) + f(p0,q0) over them.

    cells: lang, term, list of (source, p, p0). Partial sums, several rows a pair. Sums run in 64 bits and are exact, because
    they are used modulo 2^64 only where the whole fits.
    """
    schema = "lang string, source string, item string, both bigint, fix bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[tuple[str, str], list[int]]] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, pairs in sums.items():
                if pairs:
                    a, b = zip(*pairs)
                    both, fix = zip(*pairs.values())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(both, pa.int64()), pa.array(fix, pa.int64())], names)
            sums.clear()

        def evaluate(lang: str, size: np.ndarray, who: np.ndarray, p: np.ndarray, p0: np.ndarray, sources: list[str]) -> None:
            """size: entries of each term. Each entry meets every entry of its term's list."""
            start, reach = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)
            left = np.repeat(np.arange(len(who)), reach)
            right = np.arange(len(left)) - np.repeat(np.cumsum(reach) - reach - start, reach)
            apart = who[left] != who[right]
            left, right = left[apart], right[apart]
            a, a0, b, b0 = p[left], p0[left], p[right], p0[right]
            f = lambda x, y: (x - y) * (x - y) // y  # noqa: E731  unsigned: the square is right modulo 2^64
            value = (f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)).view(np.int64)
            code, at = np.unique(who[left] * len(sources) + who[right], return_inverse=True) if len(sources) > DENSE else (np.arange(len(sources) ** 2), who[left] * len(sources) + who[right])
            sums_, both = np.zeros(len(code), np.int64), np.bincount(at, minlength=len(code))
            np.add.at(sums_, at, value)
            kept = sums.setdefault(lang, {})
            for k in np.flatnonzero(both).tolist():
                i, j = divmod(int(code[k]), len(sources))
                cell = kept.setdefault((sources[i], sources[j]), [0, 0])
                cell[0] += int(both[k])
                cell[1] = (cell[1] + int(sums_[k]) + 2**63) % 2**64 - 2**63

        for batch in batches:
            langs, lists = batch.column("lang").dictionary_encode(), batch.column("entries")
            of_lang, size = langs.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            named = flat.field("source").dictionary_encode()
            who, names_ = named.indices.to_numpy().astype(np.int64), named.dictionary.to_pylist()
            p, p0 = (flat.field(c).to_numpy().astype(np.uint64) for c in ("p", "p0"))
            ends = np.append(0, np.cumsum(size))
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                mine = np.flatnonzero(of_lang == k)
                for some in np.split(mine, np.flatnonzero(np.diff(np.cumsum(size[mine] ** 2) // TASK_PAIRS)) + 1):
                    rows = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in some])
                    evaluate(lang, size[some], who[rows], p[rows], p0[rows], names_)
            if sum(map(len, sums.values())) > TASK_ENTRIES:
                yield from emptied()
        yield from emptied()

    return cells.mapInArrow(run, schema)


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows of each source against the others of its lang, and `term` rows of what stands out in it."""
    classes, groups = text_classes(docs)
    kept = stored(kept_terms(classes, min_docs), "kept-terms")
    each = kept.select("lang", "term", "total", F.explode("entries").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("held"))
    groups = groups.join(own, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["n_group", "held", "v", "n_lang"])
    p0 = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("n_group"), F.col("v")))
    groups = stored(groups.withColumn("p0", p0), "source-groups")
    n_groups = groups.count()
    cells = each.join(sized(groups.select("lang", "source", "n_group", "n_lang", "v", "p0"), n_groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("n_group"), F.col("v")))

    q = share(F.col("total"), F.col("n_lang"), F.col("v"))
    stands_out = cells.withColumn("q", q).where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = stands_out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    hist = stored(cells.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms")), "count-histogram")
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    wide = lambda c: c.cast("decimal(38,0)")
    against = hist.join(sized(others, n_groups), "lang").where(F.col("source") != F.col("item"))
    both_ways = against.groupBy("lang", "source", "item").agg(F.sum(wide(F.col("terms") * wide(gap(F.col("p"), F.col("q0"))))).alias("ahead"), F.sum(wide(F.col("terms") * wide(gap(F.col("q0"), F.col("p"))))).alias("behind"))
    ahead = both_ways.select("lang", "source", "item", "ahead")
    behind = both_ways.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "behind")
    lists = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries"))
    fix = shared_terms(lists.where(F.size("entries") > 1).select("lang", "entries")).groupBy("lang", "source", "item").agg(F.sum("both").alias("both"), F.sum(wide(F.col("fix"))).alias("fix"))
    side = lambda *c: groups.select("lang", *c)
    pairs = side("source", "v", "held", "p0").join(sized(side(F.col("source").alias("item"), F.col("held").alias("held_item"), F.col("p0").alias("q0")), n_groups), "lang").where(F.col("source") != F.col("item"))
    for part in (ahead, behind, fix):
        pairs = pairs.join(part, ["lang", "source", "item"], "left")
    neither = wide(F.col("v") - F.col("held") - F.col("held_item")) * wide(gap(F.col("p0"), F.col("q0")))
    whole = sum((F.coalesce(wide(F.col(c)), wide(F.lit(0))) for c in ("ahead", "behind", "fix")), F.coalesce(neither, wide(F.lit(0))))
    pairs = pairs.select("lang", "source", "item", whole.alias("whole")).withColumn("value", F.col("whole").cast("long")).drop("whole")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(terms, "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v) AS p, 1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
 FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE cnt > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
"""
