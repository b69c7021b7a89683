"""Near-duplicate groups from bottom-k sketches of one hash function.

1. A document's set is its distinct `width`-word shingles, as 64-bit hashes. Equal sets form one class; only classes go on.
2. A class's sketch is the `k` smallest hashes. Two classes of Jaccard similarity >= `similarity` share at least `need`
   retained values: for sets that fit into the sketch this is exact; for larger ones `need` lies so far below k * similarity
   that a binomial tail bounds the chance of missing a link (k 64, need 26: 1e-12 for a pair at the threshold, less above it).
3. A class whose own shingles, held by no other class, are too many for the threshold has no partner (exact, on full sets).
   Of the rest, a class must share one of its `k - need + 1` rarest retained values with any partner. Values that one class holds are
   rarest and have no partner; a class with enough of them is out. The others' rarest values make the inverted lists.
4. Each list links its members to the one that shares the largest part of its shingles (a star, linear in the list). Candidates pass if the sketch of the union
   estimates enough similarity, and are then verified by exact Jaccard on the full sets. Links merge into components.
5. Lists whose members are still in several components are compared exhaustively, block against block. Pairs
   from small lists go through the same estimate and exact check; tasks of large lists hold the full sets and verify there, so
   that only links leave them, a spanning forest a block. No list is capped.

Step 5 compares only members of different components, so a large group of copies costs its size, not its square.

Definitions. Words are lower-cased (A-Z only) runs of [^\\x20\\x09-\\x0D]; with fewer than `width` words the whole sequence is
the one shingle. A text without words, or null, has an empty set: linked with nothing, its own component. Rows of equal set
form one group, so repeated rows do too; rows that share a doc_id but differ in text stay separate rows. A null doc_id never
names a component unless no other member has one. Of equal ranks the smaller class hash heads a star. Shingles and classes are
compared by 64-bit hashes. A very long text is one set of its length, held by one task at a time. An empty table gives an empty
result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.llm.text_batches import map_texts
from vane.plans.components import connected_components
from vane.plans.shared import stored

K, NEED = 64, 26
#: Members of a block of a list and their shingles, and rows and shingles of a task, in the exhaustive comparison.
BLOCK, BLOCK_SHINGLES, TASK_ROWS, TASK_SHINGLES = 1024, 2_000_000, 20_000, 1_000_000
#: Lists up to this many members give pairs to verify; larger ones are verified where they are compared.
SMALL = 32
#: Class ids up to this many are sent to all executors (8 bytes each); beyond it they are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


class WordHashes(dict):
    """Word to 64-bit hash; emptied when large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


def shingle_hashes(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out ^ (out >> np.uint64(31)))


def class_of(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n_shingles, class_id (null for an empty set), sketch: of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = work.__dict__.setdefault("known", WordHashes())
        counts, classes, kept = [], [], []
        for text in batch.column("text").to_pylist():
            h = shingle_hashes(text, width, known)
            counts.append(len(h))
            classes.append(class_of(h) if len(h) else None)
            kept.append(h[:k].view(np.int64))
        offsets = np.cumsum([0, *map(len, kept)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(classes, pa.int64()), lists], ["doc_id", "n_shingles", "class_id", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", work, f"doc_id {kind}, n_shingles bigint, class_id bigint, sketch array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class_id, shingles (sorted) of the wanted classes: (class_id, set_doc), read again from one text each."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = work.__dict__.setdefault("known", WordHashes())
        ids, sets = [], []
        for text, want in zip(batch.column("text").to_pylist(), batch.column("class_id").to_pylist()):
            h = shingle_hashes(text, width, known)
            if len(h) and class_of(h) == want:
                ids.append(want)
                sets.append(h.view(np.int64))
        offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["class_id", "shingles"])

    small = wanted.count() <= MAX_BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("set_doc")))
    sets = map_texts(texts.select("class_id", "text"), "text", work, "class_id bigint, shingles array<bigint>")
    return sets.groupBy("class_id").agg(F.first("shingles").alias("shingles"))


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Exact: 100 * intersection >= 100 * similarity * union, in integers."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return 100 * both >= round(100 * similarity) * (F.size(a) + F.size(b) - both)


def may_be_similar(a: Column, b: Column, k: int, need: int) -> Column:
    """The sketch of the union: of its k smallest values, those in both sketches; large sets need `need` of them."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) >= F.least(F.lit(need), F.ceil(F.size(union) * (need / k)))


def inverted_lists(classes: DataFrame, similarity: float, k: int, need: int, rounds: int = 2) -> DataFrame:
    """value, class_id: the rarest retained values of every class that can have a partner. classes: (class_id, n, sketch)."""
    small = F.col("n") <= int(k * similarity)
    overlap = F.when(small, F.ceil(F.col("n") * similarity)).otherwise(F.lit(need))
    prefix = F.least(F.col("n"), F.lit(k)) - overlap + 1
    held = classes.select("class_id", prefix.cast("int").alias("prefix"), F.least(F.col("n"), F.lit(k)).cast("int").alias("size"), F.explode("sketch").alias("value"))
    for _ in range(rounds):  # a class that drops out makes its values rarer
        counts = stored(held.groupBy("value").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "holders")
        shared = held.join(counts, "value").groupBy("class_id", "prefix", "size").agg(F.collect_list(F.struct("holders", "value")).alias("shared"))
        # values of one holder come first in the order of rarity and fill the prefix
        open_slots = F.col("prefix") - (F.col("size") - F.size("shared"))
        lists = stored(shared.withColumn("open", open_slots).where("open > 0"), "lists")
        held = lists.select("class_id", "prefix", "size", F.explode("shared.value").alias("value"))
    ranked = lists.select("class_id", F.slice(F.array_sort("shared"), 1, F.col("open")).alias("rare"))
    return ranked.select("class_id", F.explode("rare.value").alias("value"))


def with_shared(classes: DataFrame, docs: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """The classes that can still have a partner, with shared: how many of their shingles another class holds; and their full sets.

    Two sets share at most what each of them shares with anyone, so a class with too many shingles of its own is out.
    """
    sets = stored(full_sets(docs, classes.select("class_id", "set_doc"), width), "full-sets")
    alone = sets.select("class_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("class_id").alias("class_id")).where("holders = 1")
    alone = alone.groupBy("class_id").agg(F.count(F.lit(1)).alias("own"))
    shared = classes.join(alone, "class_id", "left").select("class_id", "n", "sketch", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
    return stored(shared.where(100 * F.col("shared") >= round(100 * similarity) * F.col("n")), "partners"), sets


def star_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b with a < b: every member of a list and the list's head, once. The head shares the largest part of its shingles: the text that copies were made from comes before the copies."""
    ranked = lists.join(classes.select("class_id", F.struct((-F.col("shared") / F.col("n")).alias("r"), F.col("class_id").alias("head")).alias("rank")), "class_id")
    ranked = stored(ranked.select("value", "class_id", "rank"), "ranked")
    heads = stored(ranked.groupBy("value").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("members")).where("members > 1").select("value", "rank.head"), "heads")
    both = ranked.join(heads, "value").where("head <> class_id")
    return both.select(F.least("head", "class_id").alias("a"), F.greatest("head", "class_id").alias("b")).distinct()


def can_be_similar(similarity: float) -> Column:
    """On n_a, n_b and shared_a, shared_b: an intersection as large as the threshold needs is possible."""
    return (100 + round(100 * similarity)) * F.least("shared_a", "shared_b") >= round(100 * similarity) * (F.col("n_a") + F.col("n_b"))


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float, k: int, need: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    sizes = lambda side: classes.select(F.col("class_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("shared").alias(f"shared_{side}"), F.col("sketch").alias(f"s_{side}"))
    near = pairs.join(sizes("a"), "a").join(sizes("b"), "b")
    near = near.where(can_be_similar(similarity)).where(may_be_similar(F.col("s_a"), F.col("s_b"), k, need))
    near = stored(near.select("a", "b"), "near-pairs")
    side = lambda name: sets.select(F.col("class_id").alias(name), F.col("shingles").alias(f"set_{name}"))
    return near.join(side("a"), "a").join(side("b"), "b").where(similar(F.col("set_a"), F.col("set_b"), similarity)).select("a", "b")


def open_lists(lists: DataFrame, labels: DataFrame, partners: DataFrame) -> DataFrame:
    """value, class_id, component, n, shared, members, volume (their shingles) of the lists whose members are in several components."""
    sized = lists.join(partners.select("class_id", "n", "shared"), "class_id")
    placed = stored(sized.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select("value", "class_id", F.coalesce("component", "class_id").alias("component"), "n", "shared"), "placed")
    mixed = placed.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume")).where("least < most")
    return stored(placed.join(stored(mixed.select("value", "members", "volume"), "mixed"), "value"), "open-lists")


def dealt_blocks(rows: DataFrame, weight: Column, per_task: int) -> DataFrame:
    """rows once for each pair of blocks (lo, hi) of their list that they take part in, with the task that compares the pair."""
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("volume") / BLOCK_SHINGLES)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    total = rows.agg(F.sum(weight * F.col("blocks"))).first()[0] or 0
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    task = F.pmod(F.xxhash64("value", lo, hi), F.lit(max(1, -(-total // per_task)))).cast("int")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*[c for c in rows.columns if c != "blocks"], lo.alias("lo"), hi.alias("hi"), task.alias("task"))


def block_pairs(pdf: pd.DataFrame):
    """Index ranges (x, y) of the rows to compare, of every pair of blocks in pdf (sorted by value, lo, hi, block)."""
    value, lo, hi, block = (pdf[c].to_numpy() for c in ("value", "lo", "hi", "block"))
    new = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    for s, e in zip(new, np.r_[new[1:], len(value)]):
        same = lo[s] == hi[s]
        cut = e if same else s + int(np.searchsorted(block[s:e], hi[s]))
        yield np.arange(s, cut), np.arange(s if same else cut, e)


def possible(pdf: pd.DataFrame, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of different components whose shared shingles allow enough similarity."""
    comp, n, shared = (pdf[c].to_numpy() for c in ("component", "n", "shared"))
    return (comp[x][:, None] != comp[y]) & ((100 + percent) * np.minimum(shared[x][:, None], shared[y]) >= percent * (n[x][:, None] + n[y]))


def pairs_frame(found: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64), columns=["a", "b"])


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b to verify, from lists of at most SMALL members: no more than SMALL a row."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "lo", "hi", "block"], kind="stable")
        ids, found = pdf.class_id.to_numpy(), []
        for x, y in block_pairs(pdf):
            i, j = np.nonzero(possible(pdf, x, y, percent))
            found.append(np.stack([np.minimum(ids[x[i]], ids[y[j]]), np.maximum(ids[x[i]], ids[y[j]])], 1))
        return pairs_frame(found)

    return dealt_blocks(rows, F.lit(1), TASK_ROWS).groupBy("task").applyInPandas(compare, "a bigint, b bigint").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, by products of their incidence matrices, some thousand shingles at a time."""
    at_left, at_right = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    all_left, all_right = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(all_left, all_right)
    out = np.zeros((len(left), len(right)), np.float32)
    for s in range(0, len(common), 4096):
        part = common[s : s + 4096]
        sides = []
        for at, values, n in ((at_left, all_left, len(left)), (at_right, all_right, len(right))):
            k = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[k] == values
            held = np.zeros((n, len(part)), np.float32)
            held[at[hit], k[hit]] = 1
            sides.append(held)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Those of the links (a[i], b[i]) that connect what the earlier ones leave apart: fewer than their ends."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, np.int64)


def links_in_large_lists(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of exact similarity, from lists of more than SMALL members. Their tasks hold the full sets, so only links come out, and of the links between two blocks only a spanning forest."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "lo", "hi", "block"], kind="stable")
        ids, n, found = pdf.class_id.to_numpy(), pdf.n.to_numpy(), []
        full = pdf.shingles.tolist()
        for x, y in block_pairs(pdf):
            good = possible(pdf, x, y, percent)
            x, y = x[good.any(1)], y[good.any(0)]
            if not len(x):
                continue
            both = overlaps([full[i] for i in x], [full[j] for j in y])
            i, j = np.nonzero(possible(pdf, x, y, percent) & (100 * both >= percent * (n[x][:, None] + n[y] - both)))
            a, b = ids[x[i]], ids[y[j]]
            tree = forest(a, b)
            found.append(np.stack([np.minimum(a, b)[tree], np.maximum(a, b)[tree]], 1))
        return pairs_frame(found)

    dealt = dealt_blocks(rows, F.col("n"), TASK_SHINGLES)
    return dealt.join(sets, "class_id").groupBy("task").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, k: int = K, need: int = NEED) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept, one row a row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    seen = stored(sketches(docs, width, k), "sketches")
    classes = seen.where("class_id IS NOT NULL").groupBy("class_id").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("set_doc"))
    classes = stored(classes, "classes")
    lists = stored(inverted_lists(classes, similarity, k, need), "inverted")
    partners, sets = with_shared(classes.join(lists.select("class_id").distinct(), "class_id", "left_semi"), docs, similarity, width)
    lists = stored(lists.join(partners.select("class_id"), "class_id", "left_semi"), "inverted-left")
    links = stored(verified(star_pairs(lists, partners), partners, sets, similarity, k, need), "links")
    labels = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = open_lists(lists, labels, partners)
    percent = round(100 * similarity)
    few = verified(open_pairs(rows.where(F.col("members") <= SMALL), percent), partners, sets, similarity, k, need)
    more = stored(few.union(links_in_large_lists(rows.where(F.col("members") > SMALL), sets, percent)), "more-links")
    if more.limit(1).count():
        links = links.union(more)
        labels = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    least = classes.select("class_id", "set_doc").join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    roots = stored(least.where("component IS NOT NULL").groupBy("component").agg(F.min("set_doc").alias("root_doc")), "roots")
    named = stored(least.join(roots, "component", "left").select("class_id", F.coalesce("root_doc", "set_doc").alias("least_doc")), "named")
    out = seen.select("doc_id", "n_shingles", "class_id").join(named, "class_id", "left")
    component = F.coalesce("least_doc", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), similarity=0.8, width=4)
