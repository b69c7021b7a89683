"""Personal data and secrets by base patterns and a skip-chain conditional random field.

The base finds emails, ip addresses, card and phone numbers in the whole text. The field adds mentions that the base misses.
Its nodes are the base matches (labels observed) and looser candidates: digit groups, obfuscated addresses, long mixed tokens
(keys, passwords) and repeats of the name part of a found email. Three kinds of potentials are trained together, by the
pseudo-likelihood of a bounded sample of the corpus: shape and context of a mention; the labels of neighbouring mentions
(chain); and, for each label, the agreement of mentions with equal digits or equal names anywhere in the document (skip).
Observed labels are the base matches, tokens that a key word introduces (secret), and dates, decimals, numbered things and
plain words (none). Other candidates stay unlabelled, so the field may go beyond the base. Features drop out at random, and
each base mention is also given bare (without its plus, at sign or separators) beside its full form: so the weights of the
neighbours are learned too. Loopy message passing then makes labels consistent over each document; a candidate is added if a
label reaches `min_probability`. Skip edges join a mention with the one before it of equal key, so a document, however long,
costs its number of mentions.

A null text is empty: no spans, the digest of the empty string. Positions are code points, ends exclusive. Of candidates that
overlap the earlier, then the longer one counts; of equal probabilities the label listed first. Repeated rows get equal
results; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.llm.text_batches import map_texts

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[+(]?[0-9][0-9 ()./-]{5,}[0-9]")
LONG_RUN = re.compile(r"[0-9]{14,}")
AROUND_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:@| ?[(\[] ?at ?[)\]] ?)[A-Za-z0-9-]{1,64}(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9-]{1,64}){0,5}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20,}")
NAME = re.compile(r"[A-Za-z0-9._%+-]{6,}")
MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])", re.DOTALL)
DATE = re.compile(r"(?:1[89]|20)\d\d[-/. ][01]?\d[-/. ][0-3]?\d|[0-3]?\d[-/. ][01]?\d[-/. ](?:1[89]|20)\d\d")
DECIMAL = re.compile(r"\d+\.\d+|\d{1,3}(?:[ .]\d{3})+")
#: Words that introduce mentions of a kind, or numbers that are none.
CUES = {
    "email": frozenset("mail email write contact correo courriel".split()),
    "ip": frozenset("ip host server addr address client remote".split()),
    "card": frozenset("card visa mastercard amex credit debit karte tarjeta carte iban account".split()),
    "phone": frozenset("call phone tel telephone telefon fax mobile cell ring".split()),
    "secret": frozenset("token key apikey secret password passwd pwd passphrase bearer auth credential signature".split()),
    "none": frozenset("order invoice isbn issn number no nr id version page pages table figure section chapter year since until ref timestamp sha commit".split()),
}
LABELS = ("none", *KINDS, "secret")
ALL_KINDS = LABELS[1:]
WORD = re.compile(r"[a-z]+")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the email pattern, found from each @ outwards, in linear time."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Loose mentions that touch no base span, in order, not overlapping."""
    found = []
    for m in DIGITS.finditer(text):
        runs = [r.span() for r in LONG_RUN.finditer(text, m.start(), m.end())]
        found += runs or [m.span()]
    if "@" in text or "at)" in text or "at]" in text or "at )" in text or "at ]" in text:
        found += [m.span() for m in AROUND_AT.finditer(text)]
    found += [m.span() for m in TOKEN.finditer(text) if MIXED.match(m[0])]
    names = {n for s, k, e in base if k == 0 and len(n := text[s:e].split("@")[0].lower()) >= 6 and not n.isalpha()}  # a plain word may be just that
    if names:
        for m in NAME.finditer(text):
            bare = m[0].rstrip(".-_%+")
            if bare.lower() in names:
                found.append((m.start(), m.start() + len(bare)))
    out, taken, k = [], 0, 0
    spans = [(s, e) for s, _, e in base]
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if s >= taken and not any(b < e and s < c for b, c in spans[k : k + 4]):
            out.append((s, e))
            taken = e
    return out


def features(piece: str, before: str = "", after: str = "") -> list[bool]:
    """Shape, and the words and signs around. Which base pattern matches is not a feature."""
    digits = NOT_DIGIT.sub("", piece)
    letters = any(c.isalpha() for c in piece)
    n, size = len(digits), len(piece)
    groups = piece.count(".")
    cues = WORD.findall(before.lower())[-3:]
    obfuscated = "at)" in piece or "at]" in piece or "at )" in piece or "at ]" in piece
    run = max(map(len, re.findall(r"[0-9]+", piece)), default=0)
    mixed = letters and n > 0 and size >= 20 and "@" not in piece
    return [
        True, "@" in piece, "@" in piece and "." in piece.rsplit("@", 1)[-1], obfuscated, letters, n == 0, 0 < n < 7, 7 <= n < 10, 10 <= n <= 13, 14 <= n <= 19, n > 19,
        groups == 3 and not letters, piece.startswith("+"), "(" in piece, " " in piece or "-" in piece, "/" in piece, 14 <= run <= 19, 14 <= n <= 19 and not letters and luhn(digits),
        mixed, mixed and size >= 32, mixed and all(c in "0123456789abcdefABCDEF" for c in piece), mixed and len(set(piece)) >= 12, bool(DATE.fullmatch(piece)), bool(DECIMAL.fullmatch(piece)),
        before[-1:] in tuple("\"'="), after[:1] in tuple("\"'"), *(any(c in CUES[k] for c in cues) for k in CUES),
    ]


N_FEATURES = len(features("0"))
AROUND = 24


def features_at(text: str, start: int, end: int) -> list[bool]:
    return features(text[start:end], text[max(0, start - AROUND) : start], text[end : end + 1])


def observed(text: str, start: int, end: int) -> int:
    """Label of a candidate that is known by its surroundings: secret or none; -1 for the others."""
    f = features_at(text, start, end)
    cue = dict(zip(CUES, f[-len(CUES) :]))
    if f[18] and cue["secret"]:
        return LABELS.index("secret")
    return 0 if f[22] or f[23] or (cue["none"] and not f[1]) else -1


def key_of(piece: str) -> str | None:
    """What equal mentions share: the digits, or the name before an @."""
    if "@" in piece or any(c.isalpha() for c in piece):
        name = re.split(r"@| ?[(\[] ?at ?[)\]]", piece)[0].lower()
        return f"n{name}" if len(name) >= 6 else None
    digits = NOT_DIGIT.sub("", piece)
    return f"d{digits[-10:]}" if len(digits) >= 8 else None


def bare_form(piece: str, kind: int) -> str:
    """A mention as it may be repeated: the name of an email, the last ten digits of a phone number, the digits of others."""
    if kind == 0:
        return piece.split("@")[0]
    digits = NOT_DIGIT.sub("", piece)
    return digits[-10:] if kind == 3 else digits


def mention_nodes(text: str, base: list[tuple[int, int, int]], loose: list[tuple[int, int]], known) -> list[tuple[int, int, int]]:
    """(start, end, label or -1) of all mentions in order."""
    return sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, known(text, s, e)) for s, e in loose])


NEAR = 40


def field_edges(text: str, nodes: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours at most NEAR apart, skip edges to the last mention of equal key."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR]
    skip, last = [], {}
    for i, (s, e, _) in enumerate(nodes):
        key = key_of(text[s:e])
        if key is not None:
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


def example_rows(text: str) -> list[tuple[int, int, int, bytes, bytes]]:
    """(label, label before, label after (-1: none known), labels over skip edges, features) of the observed mentions of a text."""
    base = base_spans(text)
    nodes = mention_nodes(text, base, candidates(text, base), observed)
    chain, skip = field_edges(text, nodes)
    before, after = {j: nodes[i][2] for i, j in chain}, {i: nodes[j][2] for i, j in chain}
    linked = [[0] * len(LABELS) for _ in nodes]
    for i, j in skip:
        for a, b in ((i, j), (j, i)):
            if nodes[b][2] >= 0:
                linked[a][nodes[b][2]] += 1
    row = lambda label, b, a, links, f: (label, b, a, bytes(min(x, 255) for x in links), bytes(f))
    none = [0] * len(LABELS)
    out = []
    for i, (s, e, label) in enumerate(nodes):
        if label < 0:
            continue
        out.append(row(label, before.get(i, -1), after.get(i, -1), linked[i], features_at(text, s, e)))
        if 0 < label <= len(KINDS):  # the mention once more, bare, beside its full form; a bare name alone is no mention
            bare = bare_form(text[s:e], label - 1)
            out.append(row(label, -1, -1, [int(k == label) for k in range(len(LABELS))], features(bare)))
            if label == 1:
                out.append(row(0, -1, -1, none, features(bare)))
    words = [m[0] for m in list(re.finditer(r"[^\W\d_]{3,}|[0-9]{1,6}", text))[:4]]  # plain words and short numbers are no mentions
    out += [row(0, -1, -1, none, features(w)) for w in words]
    out += [row(0, -1, -1, [1] + none[1:], features(w)) for w in words[:1]]
    return out


def fit(rows: list[tuple[int, int, int, bytes, bytes]], epochs: int = 250, rate: float = 0.05, drop: float = 0.25) -> dict:
    """Node weights, chain potentials (label before, label after) and skip agreements, by the gradient of their joint pseudo-likelihood."""
    n_labels = len(LABELS)
    parts = {"weights": np.zeros((N_FEATURES, n_labels)), "chain": np.zeros((n_labels, n_labels)), "skip": np.zeros(n_labels)}
    if not rows:
        return parts
    x = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1).astype(np.float32)
    links = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1).astype(np.float32)
    y, before, after = (np.array([r[k] for r in rows]) for k in (0, 1, 2))
    one_hot = lambda v: (v[:, None] == np.arange(n_labels)).astype(np.float32)  # noqa: E731  -1: all zero
    target, left, right = one_hot(y), one_hot(before), one_hot(after)
    weight = 1 / np.sqrt(target.sum(0)[y])  # rare kinds count more
    weight = (weight / weight.sum())[:, None]
    rng = np.random.default_rng(5)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in parts.items()}
    for step in range(1, epochs + 1):
        seen = x * (rng.random(x.shape, np.float32) >= drop)
        seen[:, 0] = 1
        z = seen @ parts["weights"] + left @ parts["chain"] + right @ parts["chain"].T + links * parts["skip"]
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - target) * weight
        grads = {"weights": seen.T @ g, "chain": left.T @ g + g.T @ right, "skip": (g * links).sum(0)}
        for k, v in parts.items():
            grad = grads[k] + 1e-4 * v
            m, s = moments[k]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return parts


def training_rows(docs: DataFrame, max_docs: int, max_rows: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """Observed mentions of about max_docs documents at most (a hash of doc_id below a bound, of those with a digit or @), max_rows of them at most: those of the least hashes."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    n = usable.select("doc_id").count()
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-n // max_docs)))) == 0)
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    names = ["label", "before", "after", "links", "features"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [row for text in batch.column("text").to_pylist() for row in example_rows(text)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    rows = map_texts(sample.select("text"), "text", work, "label int, before int, after int, links binary, features binary")
    rows = rows.orderBy(F.xxhash64(*names), *names).limit(max_rows).collect()
    return [(r["label"], r["before"], r["after"], bytes(r["links"]), bytes(r["features"])) for r in rows]


def total(x: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(x, axis=axis)


def added_spans(text: str, base: list[tuple[int, int, int]], loose: list[tuple[int, int]], model: dict, min_probability: float, rounds: int = 15, skip_edges: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the candidates that message passing labels."""
    nodes = mention_nodes(text, base, loose, lambda *_: -1)
    known = np.array([n[2] for n in nodes])
    unary = np.where(np.arange(len(LABELS)) == known[:, None], 0.0, -50.0)
    free = np.flatnonzero(known < 0)
    unary[free] = np.array([features_at(text, *nodes[i][:2]) for i in free], float) @ model["weights"]
    chain, skip = field_edges(text, nodes)
    edges = np.array([*chain, *(skip if skip_edges else [])], np.int64).reshape(-1, 2)
    belief = unary.copy()
    if len(edges):
        i, j = edges.T
        same = np.diag(model["skip"])
        potential = np.stack([model["chain"]] * len(chain) + [same] * (len(edges) - len(chain)))
        ahead, back = (np.zeros((len(edges), len(LABELS))) for _ in range(2))  # messages to the later and to the earlier node
        for _ in range(rounds):
            to_j = total((belief[i] - back)[:, :, None] + potential, 1)
            to_i = total((belief[j] - ahead)[:, None, :] + potential, 2)
            to_j, to_i = (m - m.max(1, keepdims=True) for m in (to_j, to_i))
            change = max(np.abs(to_j - ahead).max(), np.abs(to_i - back).max())
            ahead, back = (ahead + to_j) / 2, (back + to_i) / 2
            belief = unary.copy()
            np.add.at(belief, j, ahead)
            np.add.at(belief, i, back)
            if change < 1e-4:
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [(nodes[k][0], int(best[k]) - 1, nodes[k][1]) for k in free.tolist() if best[k] > 0 and p[k, best[k]] >= min_probability]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal_data(docs: DataFrame, max_docs: int = 4000, max_rows: int = 20_000, min_probability: float = 0.8, skip_edges: bool = True) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, spans, n_added, n_secret and n_spans (added secrets, all spans): of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    model = fit(training_rows(docs, max_docs, max_rows))
    secret = ALL_KINDS.index("secret")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: list[list[int]] = [[] for _ in KINDS]
        digests, spans, added, secrets, everything = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            loose = candidates(text, base)
            more = added_spans(text, base, loose, model, min_probability, skip_edges=skip_edges) if loose else []
            for k, column in enumerate(counts):
                column.append(sum(1 for b in base if b[1] == k))
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append(listed(base + more))
            added.append(len(more))
            secrets.append(sum(1 for m in more if m[1] == secret))
            everything.append(len(base) + len(more))
        arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans), *(pa.array(c, pa.int64()) for c in (added, secrets, everything))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_secret", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, "text", work, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_secret bigint, n_spans bigint")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
