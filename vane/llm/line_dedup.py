"""Line deduplication over levelled sorted runs of line hashes (built-in SQL functions only).

A run is a table (h, g, n_docs) of distinct line keys, dealt into buckets and sorted by hash in each, so that runs merge bucket
by bucket without an exchange or a sort. A key at `min_docs` documents is settled. Every new batch is anti-joined by sorted merge
with the settled keys of the runs, and what remains becomes a run of level 0. When a level holds `fanout` runs they are
compacted into one run of the next level, where counts of equal keys add up. Batches are read and counted one by one, each
against the runs alone. An index in a folder outlives the call: its list of runs is a small file that changes all at once after
each batch, so a later call (or one begun anew after a failure) goes on from it, and a batch that is named again is not added twice.

Definitions. A line's key is the line without [\\x20\\x09-\\x0D] at either end, A-Z lower-cased. A document counts once for
a key, rows that share a doc_id (null included) are one document. A null or empty text is one empty line. A key shorter than
`min_chars` code points is never dropped. Keys are compared by two xxhash64 values, 128 bits. A very long text costs its
number of lines. Repeated rows get equal results. An empty table gives an empty result; other columns pass through, but the
operator's own columns replace theirs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.functions.text import let
from vane.llm.text_batches import free_name
from vane.plans.files import read_text, write_text
from vane.plans.shared import bucket_count, new_path, opened_run, stored, stored_run

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """lower() equals A-Z folding on ASCII lines and is much cheaper; other lines are folded letter by letter."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(lines: Column, min_chars: int) -> Column:
    """For each line (h, g), or null for a key that is too short to count."""
    keyed = F.transform(lines, key_of)
    return F.transform(keyed, lambda k: F.when(F.length(k) >= max(1, min_chars), F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))


class LineRuns:
    """The index: levels of runs (table, path, buckets). Counts of a key add up over runs; a key at `min_docs` or above is settled.

    With a folder the runs lie there, and the index goes on from what the folder holds (its min_docs and fanout then count).
    Runs that were compacted stay in it until its owner deletes them. One job at a time may add to it.
    """

    def __init__(self, min_docs: int, fanout: int = 2, folder: str | None = None, spark: SparkSession | None = None):
        self.min_docs, self.fanout, self.levels, self.folder, self.names = min_docs, fanout, [[]], folder, []
        saved = read_text(spark or SparkSession.active(), f"{folder}/runs.json") if folder else None
        if saved:
            held = json.loads(saved)
            self.min_docs, self.fanout, self.names = held["min_docs"], held["fanout"], held["batches"]
            self.levels = [[(opened_run(spark or SparkSession.active(), path, n, "h BIGINT, g BIGINT, n_docs BIGINT", "h", "g"), path, n) for path, n in level] for level in held["levels"]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _, _ in level]

    def settled(self) -> DataFrame | None:
        """h, g of the keys that have min_docs documents over all runs."""
        runs = self.runs()
        return merged(runs).where(F.col("n_docs") >= self.min_docs).select("h", "g") if runs else None

    def add(self, batch: DataFrame, name: str | None = None) -> None:
        """batch: (h, g, n_docs), one row a key, of documents that no earlier batch held. A name that was added before adds nothing."""
        if name is not None and name in self.names:
            return
        for run in self.runs():
            batch = batch.join(run.where(F.col("n_docs") >= self.min_docs).select("h", "g").hint("merge"), ["h", "g"], "left_anti")
        self._put(0, batch)
        if name is not None:
            self.names.append(name)
        if self.folder:
            levels = [[(path, n) for _, path, n in level] for level in self.levels]
            write_text(batch.sparkSession, f"{self.folder}/runs.json", json.dumps({"min_docs": self.min_docs, "fanout": self.fanout, "batches": self.names, "levels": levels}))

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        spark, name = rows.sparkSession, f"line-run-{level}"
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}" if self.folder else new_path(spark, name)
        self.levels[level].append((stored_run(rows.select("h", "g", F.col("n_docs").cast("long").alias("n_docs")), name, "h", "g", path=path), path, bucket_count(spark)))
        if len(self.levels[level]) >= self.fanout:
            rows, self.levels[level] = merged([run for run, _, _ in self.levels[level]]), []
            self._put(level + 1, rows)


def merged(runs: list[DataFrame]) -> DataFrame:
    """The counts of all runs added up, two runs at a time: a full outer merge join of sorted buckets.

    (A union of bucketed tables will not do: Spark 4.1.2 takes it for dealt by key and then aggregates without an exchange, wrongly.)
    """
    both = runs[0]
    for k, run in enumerate(runs[1:]):
        both = both if k == 0 else stored_run(both, "line-merge", "h", "g")
        sides = [r.select("h", "g", F.col("n_docs").alias(n)) for r, n in ((both, "n_a"), (run, "n_b"))]
        both = sides[0].join(sides[1].hint("merge"), ["h", "g"], "full").select("h", "g", (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n_docs"))
    return both


def distinct_keys(hashes: Column) -> Column:
    """The distinct (h, g) of an array, by sorting: array_distinct compares structs pair by pair."""
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (x["h"] != F.get(s, i - 1)["h"]) | (x["g"] != F.get(s, i - 1)["g"]))
    by_h = F.transform(hashes, lambda x: x["h"])
    return F.when(F.size(F.array_distinct(by_h)) == F.size(hashes), hashes).otherwise(let(F.array_sort(hashes), firsts))


def frequent_lines(hashed: DataFrame, index: LineRuns, batches: int, name: str) -> DataFrame:
    """h, g of the keys that are settled once the index has taken in all batches. hashed: (doc_id, hashes of a row's lines, batch)."""
    pairs = hashed.select("doc_id", "batch", F.explode(let(F.array_compact("hashes"), distinct_keys)).alias("key")).select("doc_id", "batch", "key.h", "key.g")
    if hashed.groupBy("doc_id").count().where("count > 1").limit(1).count():  # several rows are one document: count it once
        pairs = pairs.distinct()
    for b in range(batches):
        index.add(pairs.where(F.col("batch") == b).groupBy("h", "g").agg(F.count("*").alias("n_docs")), f"{name}-{b}")
    return stored(index.settled(), "line-settled")


def flags_at(positions: Column) -> Column:
    """Booleans up to the last position, true at the positions (sorted)."""
    gap = lambda ps: F.transform(ps, lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(ps, i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    return F.flatten(let(positions, gap))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2, index: LineRuns | None = None, name: str | None = None) -> DataFrame:
    """docs plus kept_text, n_lines and n_dropped: lines whose key min_docs documents hold are gone from every document.

    The documents are dealt into batches by doc_id. With an index, the documents it has seen in earlier calls count too (docs are
    then new documents, and name is theirs: a call repeated under a name adds nothing anew). Rows of one doc_id and text lose the
    same lines, so these two name a row in the table of hits.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    index, name = index or LineRuns(min_docs, fanout), name or uuid.uuid4().hex
    lines, text_key = lines_of(F.col("text")), F.xxhash64("text")
    batch = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(batches)).cast("int")
    hashed = stored(docs.select("doc_id", text_key.alias("text_key"), line_hashes(lines, min_chars).alias("hashes"), batch.alias("batch")), "line-hashes", "batch")
    frequent = frequent_lines(hashed, index, batches, name)
    at = hashed.select("doc_id", "text_key", F.posexplode("hashes").alias("at", "key")).select("doc_id", "text_key", "at", "key.h", "key.g")
    hits = at.where("h IS NOT NULL").join(frequent, ["h", "g"], "left_semi").groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("at"))
    own = {c: free_name(docs.columns, c) for c in ("hit_doc", "hit_key", "dropped", "lines", "kept")}
    hits = stored(hits.select(F.col("doc_id").alias(own["hit_doc"]), F.col("text_key").alias(own["hit_key"]), flags_at(F.col("at")).alias(own["dropped"])), "line-hits")
    # always dealt by doc_id: most documents have hits, so their list grows with the corpus
    joined = docs.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col(own["hit_doc"])) & (text_key == F.col(own["hit_key"])), "left")
    dropped = F.col(own["dropped"])
    kept = F.filter(F.col(own["lines"]), lambda line, i: ~F.coalesce(F.get(dropped, i), F.lit(False)))
    out = joined.withColumn(own["lines"], lines)
    out = out.withColumn(own["kept"], F.when(dropped.isNull(), F.col(own["lines"])).otherwise(kept))
    n_lines = F.size(own["lines"]).cast("long")
    return out.select(*[docs[c] for c in docs.columns], F.array_join(own["kept"], "\n").alias("kept_text"), n_lines.alias("n_lines"), (n_lines - F.size(own["kept"])).alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""
