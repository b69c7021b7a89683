"""Lexical search, source divergence and fingerprints against plain versions, and their odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vane.llm import divergence, lexical, winnowing

SF = "/root/testdata/sf0.001"
MIN = -(2**63)
ODD = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "The cat", "en", None), (3, "The cat", "en", None), (4, "É é " * 3000, None, "a"), (None, "x y z cat", "de", "a"), (5, " \t\n", "de", "b"), (6, "word cat " * 20_000, "en", "a"), (None, "x y z cat", "de", "a")]
KIND = "doc_id long, text string, lang string, source string, Rank string, entries string, n_chars int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 0) for r in ODD], KIND)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# ranked search


def plain_search(docs, items, top):
    """Item number to its (doc_id, score), best first."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    found = {}
    for i, (_, text) in enumerate(items):
        rows = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                rows.append((d, s))
        found[i] = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:top]
    return found


def by_item(df, items):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r.rank):
        got[r.item_id].append((r.doc_id, r.score))
    return got


def test_search_equals_sql(spark, duck):
    want = sorted(duck.sql(lexical.OP11_SQL).fetchall())
    got = sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.op11_lexical_search(spark, SF).collect())
    assert got == want and len(got) > 500


@pytest.mark.parametrize("bucket, share, block", [(1, 0.5, 10**9), (7, 0.01, 10**9), (64, 0.2, 200), (1024, 1.0, 10**9)])
def test_search_is_whole_for_any_bucket_floor_and_block(spark, bucket, share, block):
    rng = random.Random(bucket)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30, 200])))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = by_item(lexical.ranked_search(d, spark.createDataFrame(items, "item_id long, text string"), top=9, bucket=bucket, head_share=share, block_bytes=block), items)
    assert got == {i: v for i, v in plain_search(docs, items, 9).items() if v}


def test_search_of_odd_rows(spark, odd):
    items = [(1, "cat Word"), (2, None), (3, ""), (4, "unknown"), (5, "cat cat é"), (6, "x")]
    kind = "item_id long, text string, score string"
    df = spark.createDataFrame([(*r, "clash") for r in items], kind)
    got = by_item(lexical.ranked_search(odd, df), items)
    want = {items[i][0]: v for i, v in plain_search([r[:2] for r in ODD], items, 20).items() if v}
    assert got == want and len(want[6]) == 2
    twice = lexical.ranked_search(odd, spark.createDataFrame([(1, "cat", ""), (1, "cat", "")], kind))  # each row is an item
    assert Counter(r["rank"] for r in twice.collect()) == Counter({i: 2 for i in range(1, len(plain_search([r[:2] for r in ODD], [(1, "cat")], 20)[0]) + 1)})
    assert lexical.ranked_search(odd.limit(0), df).count() == 0 and lexical.ranked_search(odd, df.limit(0)).count() == 0
    assert lexical.ranked_search(odd, df).columns == ["item_id", "rank", "doc_id", "score"]


def test_buckets_are_pruned(spark):
    """The bounds do work: few pairs of items and documents are scored."""
    scored = [0, 0]

    class Counting(lexical.Best):
        def add(self, item, scores, rows, ids):
            scored[0] += len(rows)
            super().add(item, scores, rows, ids)

    rng = np.random.default_rng(3)
    n, terms = 4000, 60
    per = rng.integers(1, 20, n)
    offsets = np.append(0, np.cumsum(per))
    flat = np.concatenate([rng.choice(terms, k, replace=False) for k in per])
    x = rng.integers(1, 1_000_000, len(flat))
    weight = {t: int(w) for t, w in enumerate(rng.integers(1, 9000, terms))}
    root = np.sqrt(np.array([weight[t] for t in range(terms)], float))
    lengths = np.sqrt(np.add.reduceat((x * root[flat]) ** 2, offsets[:-1]))
    order = np.argsort(-lengths)
    bags = [Counter(rng.choice(terms, 4).tolist()) for _ in range(10)]
    items, best = lexical.Items(list(range(10)), bags, weight), Counting(np.zeros(10), 5)
    for at in range(0, n, 200):
        rows = order[at : at + 200]
        o = np.append(0, np.cumsum(per[rows]))
        pick = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows])
        lexical.search(items, best, rows.tolist(), lengths[rows], o, flat[pick], x[pick], root)
    dense = np.zeros((n, terms), np.int64)
    for r in range(n):
        dense[r, flat[offsets[r] : offsets[r + 1]]] = x[offsets[r] : offsets[r + 1]]
    for i, bag in enumerate(bags):
        s = sum(dense[:, t] * k * weight[t] for t, k in bag.items())
        want = sorted(((-int(v), d) for d, v in enumerate(s) if v > 0))[:5]
        assert [(s, d) for s, _, d in best.found[i]] == want
    assert scored[0] < 0.05 * 10 * n


# divergence of sources


def plain_divergence(rows, min_docs=3, top=200):
    """rows: (text, lang, source) to the query's rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    bags = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))), lang, source) for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [(b, s) for b, x, s in bags if x == lang]
        df = Counter(t for b, _ in own for t in b)
        kept = [t for t in df if df[t] >= min_docs]
        v = len(kept)
        sums = defaultdict(Counter)
        for b, s in own:
            sums[s].update({t: n for t, n in b.items() if t in set(kept)} if b else {})
        whole = Counter()
        for c in sums.values():
            whole.update(c)
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)
        f = lambda a, b: (a - b) ** 2 // b
        for s in {s for _, s in own}:
            pair = [(sum(f(p(sums[s], t), p(sums[o], t)) for t in kept), o) for o in {o for _, o in own} - {s}]
            term = [(f(p(sums[s], t), p(whole, t)), t) for t in kept if sums[s][t] and p(sums[s], t) > p(whole, t)]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def answer(df):
    return [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect()]


def test_divergence_equals_sql(spark, duck):
    got, want = answer(divergence.op12_source_divergence(spark, SF)), duck.sql(f"SELECT lang, source, part, item, value, rank FROM ({divergence.OP12_SQL})").fetchall()
    assert sorted(got) == sorted(want) and len({g[1] for g in got}) > 10


@pytest.mark.parametrize("entries, pairs, broadcast", [(300_000, 400_000, 100_000), (5, 3, 0)])
def test_divergence_of_many_copies_and_odd_rows(spark, odd, monkeypatch, entries, pairs, broadcast):
    for k, v in (("TASK_ENTRIES", entries), ("TASK_PAIRS", pairs), ("MAX_BROADCAST_GROUPS", broadcast)):
        monkeypatch.setattr(divergence, k, v)
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma7delta", "ñandú", "zeta", "x"] * 3 + ["rare1a", "eta"]
    rows = [(" ".join(rng.choices(words, k=8)), rng.choice(["en", "de"]), f"s{rng.randrange(5)}") for _ in range(60)]
    rows += [("same text beta", "en", f"s{i % 4}") for i in range(50)] + [("", "fr", "lone"), (None, "en", "empty"), ("solo solo", "es", "s1")]
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, Item string").repartition(5)
    got = answer(divergence.source_divergence(df))
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert {g[1] for g in got if g[0] == "en" and g[2] == "pair"} == {"s0", "s1", "s2", "s3", "s4", "empty"}
    assert set(answer(divergence.source_divergence(odd, min_docs=1, top=3))) == plain_divergence([r[1:] for r in ODD], 1, 3)
    assert divergence.source_divergence(df.limit(0)).count() == 0


# fingerprints


def plain_fingerprint(text, k, w):
    code = lambda s: xxhash.xxh64_intdigest(s.encode(), seed=42) & (2**30 - 1)
    ones, hashes = [code(p) for p in re.findall(r"[^\x20\x09-\x0D]{1,8}", text or "")], []
    if not ones:
        return []
    if len(ones) < k:
        h = 42
        for x in ones:  # Spark's hash of a list of longs: each seeded with the one before
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
        return [(h & (2**30 - 1), 0)]
    for i in range(len(ones) - k + 1):
        h = 0
        for x in ones[i : i + k]:
            h = (h * winnowing.BASE + x) % winnowing.MODULUS
        hashes.append(h)
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if not out or out[-1][1] != at:
            out.append((hashes[at], at))
    return out


def plain(entries):
    return [(e >> 32, 2**32 - 1 - (e & (2**32 - 1))) for e in entries]


@pytest.fixture(scope="module")
def prints(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE length(text) < 2500 ORDER BY doc_id LIMIT 60").fetchall()
    made = [(1000 + i, "ab" * i) for i in range(0, 60, 5)] + [(None, "x" * 50), (None, "none"), (2000, None), (2001, ""), (2002, "é𝄞" * 40), (2003, "aaaa" * 100), (7, "dup id text " * 9), (7, "dup id text " * 9), (7, "another"), (3000, "q" * 11), (3001, "q" * 12), (3002, "q" * 43), (3003, "q" * 42)]
    return texts + made


@pytest.mark.parametrize("k, w, stretch", [(3, 6, 4_096), (3, 6, 5), (5, 7, 11), (1, 1, 10), (7, 3, 5)])
def test_winnowing_equals_a_loop(spark, prints, k, w, stretch):
    df = spark.createDataFrame(prints, "doc_id long, text string").select("text", winnowing.winnowed(F.coalesce("text", F.lit("")), k, w, stretch).alias("e"))
    assert all(plain(r.e) == plain_fingerprint(r.text, k, w) for r in df.collect())


@pytest.mark.parametrize("k, w", [(3, 6), (5, 7)])
def test_edited_texts_and_their_fingerprints(spark, prints, k, w):
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    order = sorted(prints, key=lambda d: (-(MIN if d[0] is None else d[0]), -signed(xxhash.xxh64_intdigest((d[1] or "").encode(), seed=42))))
    want = []
    for i, (d, t) in enumerate(order):
        t, other = t or "", order[(i + 1) % len(order)][1] or ""
        want.append((d, len(t), t[: len(t) - len(t) // 2] + other[: len(t) // 2], tuple(plain_fingerprint(other, k, w))))
    rows = winnowing.edited_fingerprints(spark.createDataFrame([(*p, "clash") for p in prints], "doc_id long, text string, Entries string").repartition(5), k, w).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited, tuple(plain(r.next_entries))) for r in rows) == Counter(want)
    assert all(plain(r.edited_entries) == plain_fingerprint(r.edited, k, w) for r in rows)


def test_ranges_of_one_key_and_small_tables(spark):
    df = spark.createDataFrame([(5, f"text {i}") for i in range(400)] + [(9, "last"), (1, "first")], "doc_id long, text string").repartition(6)
    rows = df.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("key"), F.xxhash64("text").alias("tie"), "text")
    got = winnowing.with_next(rows, "key", "tie", ["text"])
    want = sorted(((r.key, r.tie, r.text) for r in rows.collect()), reverse=True)
    after = {w[2]: want[(i + 1) % len(want)][2] for i, w in enumerate(want)}
    assert {r.text: r.next_text for r in got.collect()} == after
    alone = winnowing.edited_fingerprints(spark.createDataFrame([(1, "only one")], "doc_id long, text string")).collect()
    assert [r.edited for r in alone] == ["onlyonly"] and winnowing.edited_fingerprints(df.limit(0)).count() == 0
    listed = winnowing.fingerprints(spark.createDataFrame([(1, "a" * 160, "old")], "doc_id long, text string, Fingerprint string").drop("Fingerprint")).first()
    assert [(e["hash"], e["position"]) for e in listed.fingerprint] == plain_fingerprint("a" * 160, winnowing.K, winnowing.W)


def test_fingerprint_query(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    order = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in winnowing.op13_fingerprints(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    by_text = defaultdict(set)
    shown = lambda t: ",".join(f"{h:x}:{p}" for h, p in plain_fingerprint(t, winnowing.K, winnowing.W))
    for i, d in enumerate(order):
        r, t, other = rows[d], docs[d], docs[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(r.fingerprint)
        if len(t) < 4000:
            a, b = ({h for h, _ in plain_fingerprint(x, winnowing.K, winnowing.W)} for x in (t, edited))
            assert r.fingerprint == shown(t) and r.edited_fingerprint == shown(edited) and math.isclose(r.near_edited, len(a & b) / len(a | b) if a | b else 1.0)
    assert all(len(f) == 1 for f in by_text.values())
    long = [r for r in rows.values() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) / len(long) > 0.25 > 0.15 > sum(r.near_next for r in long) / len(long)
