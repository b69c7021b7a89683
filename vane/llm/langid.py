"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its character 2-, 3- and 4-grams (hashed, lower case, the whole text); a linear
layer gives a score a language. Both are trained by stochastic gradient descent in numpy on at most about `max_docs` labelled
documents, chosen by a hash of doc_id. A fifth of them, whole and in pieces, is held back to fit the softmax temperature (calibration) and two
rejection thresholds: the `tolerance` quantile, over right answers, of the calibrated probability and of the share of a text's
3-grams that training saw (marked by hash in `SEEN` bits). The second finds scripts and languages that nothing was learned
from. Short texts score lower in both, so the thresholds are fitted for each length in `BANDS`, on pieces of that length cut
from the held-back texts; a text is held against the longest band that it fills. Of right held-back answers at most the share
`tolerance` is lost to each threshold, none where there are fewer than 1 / `tolerance` of them.

A null text or one without a letter is `und` with score 0 and is rejected. If no document can be learned from, everything
is; with one language only, every text with a letter is that language. Rows are judged one by one, so repeated rows get equal
answers. Null labels are not learned. A very long text is read whole, some n-grams at a time. Equal scores go to the language
that sorts first. Extra columns are ignored; those that are carried keep their names, so the three of the answer must not be
among them (`answers` renames these).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.llm.text_batches import map_texts

BUCKETS, DIM = 1 << 13, 16
CHUNK = 500_000
SEEN = 1 << 18
#: Lengths, in characters, with thresholds of their own; pieces begin at STARTS, so the first HEAD characters are enough.
BANDS, STARTS = tuple(1 << k for k in range(2, 11)), (0, 1024)
HEAD = STARTS[-1] + BANDS[-1]
ORDERS = ((2, 0x9E3779B1), (3, 0x85EBCA77), (4, 0xC2B2AE3D))
LETTER = re.compile(r"[^\W\d_]")


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """The hash of each 2-, 3- and 4-gram of code points."""
    out = []
    for n, seed in ORDERS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, seed, np.uint32)
            for i in range(n):
                h ^= codes[i : len(codes) - n + 1 + i]
                h *= np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            out.append(h)
    return out


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint32(BUCKETS)).astype(np.int64)


def seen_buckets(hashes: list[np.ndarray]) -> np.ndarray:
    """Places of the 3-grams among the SEEN marks."""
    return hashes[1] & np.uint32(SEEN - 1) if len(hashes) > 1 else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    """Whether the text has a letter (LETTER also fits numerals such as a half, which are none)."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def gram_chunks(text: str):
    """gram_hashes of the padded, lower-case text, some at a time: those that begin in each stretch of CHUNK code points."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, max(1, len(codes)), CHUNK):
        yield [h[:CHUNK] for h in gram_hashes(codes[start : start + CHUNK + 3])]


def gram_counts(text: str) -> np.ndarray:
    """Counts by bucket over the whole text."""
    counts = np.zeros(BUCKETS)
    for hashes in gram_chunks(text):
        for h in hashes:
            counts += np.bincount(buckets_of(h), minlength=BUCKETS)
    return counts


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


class TrainingRows(Sequence):
    """(lang, averaged counts, places among the SEEN marks, first HEAD characters) by index. Rows stay as small as the tasks sent them; each is spread into BUCKETS numbers when it is asked for."""

    def __init__(self, rows: pa.Table):
        self.langs, (self.at, self.counts, self.seen, self.heads) = rows["lang"].to_pylist(), (rows[c].combine_chunks() for c in ("at", "count", "seen", "head"))
        self.order = list(range(len(self.langs)))
        self.order = sorted(self.order, key=lambda i: (self.langs[i], self[i][1][:1024].tobytes()))

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> tuple[str, np.ndarray, np.ndarray, str]:
        i = self.order[i]
        at, counts, seen = (np.frombuffer(zlib.decompress(x[i].as_buffer()), kind) for x, kind in ((self.at, np.int16), (self.counts, np.uint32), (self.seen, np.int32)))
        dense = np.zeros(BUCKETS, np.float32)
        dense[at] = counts / counts.sum()
        return self.langs[i], dense, seen, self.heads[i].as_py()


def training_rows(docs: DataFrame, max_docs: int) -> TrainingRows:
    """Of about max_docs documents at most: a hash of doc_id below a bound, of those with a label."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    n = usable.select("doc_id").count()
    keep = max(1, -(-n // max_docs))
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(keep)) == 0)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, at, counted, seen, heads = [], [], [], [], []
        small = lambda x, kind: zlib.compress(x.astype(kind).tobytes(), 1)  # noqa: E731  all of it goes through the driver
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if has_letter(text):
                counts = gram_counts(text)
                used = np.flatnonzero(counts)
                langs.append(lang)
                at.append(small(used, np.int16))
                counted.append(small(counts[used], np.uint32))
                seen.append(small(np.unique(np.concatenate([seen_buckets(hashes) for hashes in gram_chunks(text)])), np.int32))
                heads.append(text[:HEAD])
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *(pa.array(x, pa.binary()) for x in (at, counted, seen)), pa.array(heads, pa.string())], ["lang", "at", "count", "seen", "head"])

    return TrainingRows(map_texts(sample.select("lang", "text"), "text", work, "lang string, at binary, count binary, seen binary, head string").toArrow())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pieces(head: str, length: int) -> list[str]:
    """Pieces of at most `length` characters, ended between words where there is one."""
    cut = [head[s : s + length] for s in STARTS if len(head) >= s + length]
    cut = [c if head[s + length : s + length + 1].strip() == "" else (c.rsplit(None, 1) or [c])[0] for s, c in zip(STARTS, cut)]
    return [c for c in cut if has_letter(c)]


def thresholds(model: dict, texts: list[tuple[str, str]], tolerance: float) -> list[tuple[int, float, float]]:
    """(length, least probability, least share of seen 3-grams) by band; a longer band is never milder than a shorter one."""
    out = []
    for length in reversed(BANDS):
        cut = [(lang, piece) for lang, head in texts for piece in pieces(head, length)]
        if not cut:
            continue
        z, share = scores([c[1] for c in cut], model)
        p = softmax(z / model["temperature"])
        right = np.array([model["languages"][k] == lang for k, (lang, _) in zip(p.argmax(1), cut)])
        if right.any():
            low = [float(np.quantile(v[right], tolerance, method="lower")) for v in (p.max(1), share)]
            out.append((length, *map(min, low, out[-1][1:])) if out else (length, *low))
    return out[::-1]


def fit(rows: Sequence[tuple[str, np.ndarray, np.ndarray, str]], epochs: int = 12, rate: float = 4.0, tolerance: float = 0.001) -> dict:
    """languages, table (bucket by language: embedding times linear layer), bias, temperature, seen, thresholds."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return {"languages": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0), "temperature": 1.0, "seen": np.zeros(SEEN, bool), "thresholds": []}
    x = lambda some: np.stack([rows[i][1] for i in some])  # noqa: E731  never all rows at once: each is BUCKETS numbers
    y = np.array([languages.index(r[0]) for r in rows])
    rng = np.random.default_rng(11)
    order = rng.permutation(len(y))
    kept_back = order[: len(y) // 5]
    train = order[len(y) // 5 :]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    lin = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs) + 0.1)
        for s in range(0, len(train), 32):
            b = train[s : s + 32]
            now = x(b)
            hidden = now @ emb
            grad = softmax(hidden @ lin + bias)
            grad[np.arange(len(b)), y[b]] -= 1
            grad /= len(b)
            back = grad @ lin.T
            lin -= step * (hidden.T @ grad)
            bias -= step * 0.1 * grad.sum(0)
            used = np.flatnonzero(now.any(0))
            emb[used] -= step * 8 * (now[:, used].T @ back)
    table = (emb @ lin).astype(np.float32)
    check = kept_back if len(kept_back) else order
    model = {"languages": languages, "table": table, "bias": bias, "seen": np.zeros(SEEN, bool)}
    for i in train:
        model["seen"][rows[i][2]] = True
    # whole texts alone may have no wrong answer, which fits no temperature
    cut = [(y[i], piece) for i in check for length in BANDS for piece in pieces(rows[i][3], length)]
    z = np.concatenate([x(check) @ table + bias, scores([c[1] for c in cut], model)[0]])
    at = np.arange(len(z)), np.r_[y[check], [c[0] for c in cut]].astype(int)
    model["temperature"] = float(min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(np.maximum(softmax(z / t)[at], 1e-12)).mean()))
    model["thresholds"] = thresholds(model, [(rows[i][0], rows[i][3]) for i in check], tolerance)
    for i in kept_back:
        model["seen"][rows[i][2]] = True
    return model


def scores(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the table over each whole text's n-grams, plus bias; and the share of its 3-grams that training saw."""
    table, out = model["table"], np.zeros((len(texts), len(model["languages"])))
    columns = [np.ascontiguousarray(table[:, c]) for c in range(table.shape[1])]
    share = np.zeros(len(texts))
    for i, text in enumerate(texts):
        total, n, known, grams = np.zeros(len(columns)), 0, 0, 0
        for hashes in gram_chunks(text):
            for h in hashes:
                buckets = buckets_of(h)
                n += len(buckets)
                total += [c[buckets].sum(dtype=np.float64) for c in columns]
            marks = seen_buckets(hashes)
            known += int(model["seen"][marks].sum())
            grams += len(marks)
        out[i] = total / max(n, 1) + model["bias"]
        share[i] = known / max(grams, 1)
    return out, share


def least_accepted(model: dict, length: int) -> tuple[float, float]:
    """Thresholds of the longest band that a text of this length fills; none below the shortest."""
    return next((t[1:] for t in reversed(model["thresholds"]) if t[0] <= length), (0.0, 0.0))


def identify(docs: DataFrame, train: DataFrame, max_docs: int = 3000, carried: list[str] | None = None, answers: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """doc_id (or the carried columns of docs, text among them), lang_pred, score, rejected: of every row of docs. train: rows to learn from (doc_id, text, lang)."""
    carried = carried or ["doc_id"]
    model = fit(training_rows(train, max_docs))
    pa.default_memory_pool().release_unused()  # the driver goes on to other stages
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        texts = batch.column("text").to_pylist()
        good = [i for i, t in enumerate(texts) if t and m["languages"] and has_letter(t)]
        pred, score, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if good:
            z, share = scores([texts[i] for i in good], m)
            p = softmax(z / m["temperature"])
            for i, best, q, known in zip(good, p.argmax(1), p.max(1), share):
                least, least_known = least_accepted(m, len(texts[i]))
                pred[i], score[i], rejected[i] = m["languages"][best], min(1.0, float(q)), bool(q < least or known < least_known)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(pred), pa.array(score), pa.array(rejected)], [*carried, *answers])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    return map_texts(docs.select(*dict.fromkeys([*carried, "text"])), "text", work, f"{kinds}, " + ", ".join(f"`{c}` {k}" for c, k in zip(answers, ("string", "double", "boolean"))))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = identify(docs, train)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
