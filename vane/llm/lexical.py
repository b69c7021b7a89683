"""Ranked lexical search: impact vectors in buckets by length, pruned by Cauchy-Schwarz and by coordinates, survivors rescored in integers.

A document's impact of a term is (10^9 tf) div (1000 tf + 12 m), its m a function of its number of terms; an item's weight of a
term is w times its repeats. With each side scaled by sqrt(w), a score is the inner product of two vectors. Items come in blocks
whose text is bounded; of every document only the block's terms are kept.

1. One pass over the whole texts gives each document's number of terms and its counts of the block's terms; sums give N, L and df.
2. Impacts and the vector's length follow; vectors are dealt by range of length and sorted by it, longest first.
3. The longest vectors are searched first. Each item's twentieth score among them is a floor that holds for all others.
4. The rest comes in buckets of `bucket` vectors of like length. A bucket whose greatest length times the item's length stays
   under the floor is skipped, and so are the vectors of a bucket behind the first that is too short (Cauchy-Schwarz). Inside,
   only as many of the item's heaviest coordinates are read as are needed for what remains to stay under the floor; a
   vector passes if what these give, and Cauchy-Schwarz on the other coordinates, reaches the floor. Bounds are widened by 1e-9 for rounding.
5. Survivors are scored exactly in 64-bit integers; a task keeps the best `top` of each item, whose last raises its floor, and a
   window over those of all tasks ranks them. Pruning never drops a score that equals the floor, so ties are whole.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. A null or empty text has none, and such
documents and items give no rows; neither do scores of 0. Every row of the documents is a document and every row of the items an
item: rows that share an id are ranked each for itself, equal scores by ascending doc_id (null last). A very long text costs its
length. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vane.llm.text_batches import ascii_terms, map_texts
from vane.plans.shared import stored

#: Bytes of item text in a block, vectors in a bucket, and the share of the longest vectors that are searched first.
BLOCK_BYTES, BUCKET, HEAD_SHARE = 32_000_000, 1024, 0.02
TABLE = ascii_terms(digits=True)
SLACK = 1e-9


class Items:
    """A block's items: coordinates by falling weight, their exact and scaled weights, and the length of what follows each."""

    def __init__(self, ids: list, bags: list[Counter], weight: dict[int, int]):
        self.ids = ids
        self.terms, self.exact, self.scaled, self.rest = [], [], [], []
        for bag in bags:
            order = sorted((t for t in bag if weight.get(t, 0) > 0), key=lambda t: (-bag[t] * math.sqrt(weight[t]), t))
            scaled = np.array([bag[t] * math.sqrt(weight[t]) for t in order])
            self.terms.append(np.array(order, np.int64))
            self.exact.append([bag[t] * weight[t] for t in order])
            self.scaled.append(scaled)
            # rest[j]: length of the coordinates from the j-th on
            self.rest.append(np.sqrt(np.append(np.cumsum((scaled * scaled)[::-1])[::-1], 0.0)) * (1 + SLACK))


class Best:
    """The best documents of each item so far, and the score that a better one must reach."""

    def __init__(self, floors: np.ndarray, top: int):
        self.top, self.floor, self.found = top, floors.copy(), [[] for _ in floors]

    def add(self, item: int, scores: np.ndarray, rows: np.ndarray, ids: list) -> None:
        fresh = ((-int(s), ids[r] is None, ids[r]) for s, r in zip(scores, rows))
        self.found[item] = heapq.nsmallest(self.top, [*self.found[item], *fresh], key=lambda x: x if not x[1] else (x[0], True, 0))
        if len(self.found[item]) == self.top:
            self.floor[item] = max(self.floor[item], -self.found[item][-1][0])


def search(items: Items, best: Best, ids: list, lengths: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, root_w: np.ndarray) -> None:
    """One bucket (longest first): each item's survivors go to best."""
    n = len(lengths)
    order = np.argsort(terms, kind="stable")
    by_term, rows, x = terms[order], np.repeat(np.arange(n), np.diff(offsets))[order], impacts[order]
    scaled = x * root_w[by_term]
    squares = lengths * lengths
    for i, wanted in enumerate(items.terms):
        floor, rest = best.floor[i], items.rest[i]
        if not len(wanted):
            continue
        reach = int(np.searchsorted(-lengths * rest[0], -floor, "right"))  # vectors long enough for this item
        if not reach:
            continue
        at, end = np.searchsorted(by_term, wanted), np.searchsorted(by_term, wanted, "right")
        # coordinates to read: without any of them even the longest vector stays under the floor
        focus = len(wanted) if floor <= 0 else int(np.searchsorted(-rest * lengths[0], -floor, "right"))
        lists = [(slice(a, b), y) for a, b, y in zip(at[:focus], end[:focus], items.scaled[i]) if b > a]
        if not lists:
            continue
        r = np.concatenate([rows[s] for s, _ in lists])
        v = np.concatenate([scaled[s] for s, _ in lists])
        y = np.repeat([y for _, y in lists], [s.stop - s.start for s, _ in lists])
        dot, used = np.bincount(r, v * y, n), np.bincount(r, v * v, n)
        bound = dot * (1 + SLACK) + np.sqrt(np.maximum(squares - used, 0.0) + squares * SLACK) * rest[focus]
        live = (dot > 0) & (bound >= floor)
        live[reach:] = False
        if not live.any():
            continue
        score = np.zeros(n, np.int64)
        for a, b, w in zip(at, end, items.exact[i]):
            if b > a:
                hit = live[rows[a:b]]
                score[rows[a:b][hit]] += w * x[a:b][hit]
        hits = np.flatnonzero(live & (score >= max(floor, 1)))
        if len(hits):
            best.add(i, score[hits], hits, ids)


def searched(vectors: DataFrame, items, floors: np.ndarray, root_w: np.ndarray, top: int, bucket: int, item_field, doc_field) -> DataFrame:
    """item, item_id, doc_id, score: the best of each item in each task. items: a broadcast."""
    kinds = [pa.int32(), to_arrow_type(item_field.dataType), to_arrow_type(doc_field.dataType), pa.int64()]
    names = ["item", "item_id", "doc_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(floors, top)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            batch = batch.take(pa.array(order))
            lengths, ids = lengths[order], batch.column("doc_id").to_pylist()
            terms, impacts = batch.column("terms"), batch.column("impacts")
            offsets = terms.offsets.to_numpy()
            flat, values = terms.values.to_numpy().astype(np.int64), impacts.values.to_numpy().astype(np.int64)
            first = impacts.offsets.to_numpy() - offsets  # both lists start where they start
            values = values[int(first[0]) :] if first[0] else values
            for at in range(0, len(ids), bucket):
                o = offsets[at : at + bucket + 1]
                search(items.value, best, ids[at : at + bucket], lengths[at : at + bucket], o - o[0], flat[o[0] : o[-1]], values[o[0] : o[-1]], root_w)
        rows = [(i, items.value.ids[i], d, -s) for i, found in enumerate(best.found) for s, _, d in found]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000]), kinds)], names)

    item_kind, doc_kind = item_field.dataType.simpleString(), doc_field.dataType.simpleString()
    return vectors.mapInArrow(run, f"item int, item_id {item_kind}, doc_id {doc_kind}, score bigint")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (its terms), terms and counts (of the vocabulary, a broadcast) of the documents that have a term."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary.value.get
        rows, sizes, ends, terms, counts = [], [], [0], [], []
        for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            words = (text or b"").translate(TABLE).split()
            if not words:
                continue
            bag = Counter(map(known, words))
            bag.pop(None, None)
            rows.append(row)
            sizes.append(len(words))
            terms += bag.keys()
            counts += bag.values()
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, counts)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", work, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def impact_vectors(counts: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray) -> DataFrame:
    """doc_id, length, terms, impacts of the documents with a term of weight, dealt by range of length and sorted by it, longest first.

    Equal lengths are dealt by a row number, so many copies of one text are no single task's.
    """
    kept_w = weights > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            t, tf = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
            size = np.diff(terms.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), size)
            m = 75 + np.array([25 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
            x = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
            live = kept_w[t] & (x > 0)
            t, x, row = t[live], x[live], row[live]
            size = np.bincount(row, minlength=batch.num_rows)
            length = np.sqrt(np.bincount(row, weights[t] * (x.astype(float) * x), batch.num_rows)) * (1 + SLACK)
            some = np.flatnonzero(size)
            ends = pa.array(np.append(0, np.cumsum(size[some])), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (t, x)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(length[some]), *lists], ["doc_id", "length", "terms", "impacts"])

    kind = counts.schema["doc_id"].dataType.simpleString()
    vectors = counts.mapInArrow(run, f"doc_id {kind}, length double, terms array<int>, impacts array<int>").withColumn("row", F.monotonically_increasing_id())
    return vectors.repartitionByRange(F.desc("length"), "row").sortWithinPartitions(F.desc("length")).drop("row")


def search_block(docs: DataFrame, items: list[tuple], item_field, top: int, bucket: int, head_share: float) -> DataFrame | None:
    """item_id, doc_id, score, rank of a block of items (id, text), or None where nothing can match."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    bags = [Counter(vocabulary.setdefault(w, len(vocabulary)) for w in (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()) for _, text in items]
    counts = stored(counted(docs, spark.sparkContext.broadcast(vocabulary)), "term-counts")
    total = counts.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not vocabulary or not total["docs"]:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row a term of the block
        weights[r["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["count"] + 1)))
    vectors = stored(impact_vectors(counts, total["docs"], total["terms"], weights), "impact-vectors")
    known = Items([i for i, _ in items], bags, {t: int(w) for t, w in enumerate(weights)})
    sent = spark.sparkContext.broadcast(known)
    doc_field, root_w = docs.schema["doc_id"], np.sqrt(weights.astype(float))
    find = lambda v, floors: searched(v, sent, floors, root_w, top, bucket, item_field, doc_field)
    cut = vectors.agg(F.percentile_approx("length", 1 - head_share)).first()[0]
    if cut is None:
        return None
    head = stored(ranked(find(vectors.where(F.col("length") >= cut), np.zeros(len(items))), top), "head-hits")
    floors = np.zeros(len(items))
    for r in head.where(F.col("rank") == top).select("item", "score").collect():  # a row an item at most
        floors[r["item"]] = r["score"]
    norms = np.array([rest[0] for rest in known.rest])
    shortest = float(np.min(floors[norms > 0] / norms[norms > 0])) if (norms > 0).any() else 0.0
    rest = find(vectors.where((F.col("length") < cut) & (F.col("length") >= shortest * (1 - SLACK))), floors)
    return ranked(head.drop("rank").unionByName(rest), top).drop("item")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20, bucket: int = BUCKET, head_share: float = HEAD_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item. items: item_id, text."""
    item_field, found = items.schema["item_id"], None
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text")
        part = search_block(docs, [tuple(r) for r in own.collect()], item_field, top, bucket, head_share)  # a block's text is bounded
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        kinds = item_field.dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], "item_id {}, doc_id {}, score bigint, rank int".format(*kinds))
    return found.select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return ranked_search(read("documents"), read("benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), s AS (SELECT count(*) AS docs, sum(n)::HUGEINT AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
x AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // terms))) AS x FROM tf JOIN n USING (doc_id), s),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * x)::BIGINT AS score FROM q JOIN w USING (term) JOIN x USING (term) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r QUALIFY rank <= 20
"""
