"""Benchmark decontamination by literal and template windows.

Texts are read as literal words (lower case, without outer punctuation) and as templates, where numbers, names and units turn
into typed placeholders. A capital letter that begins a sentence or a line may begin a name or not, so there are two templates:
in one such words are literal, in the other they are names. The benchmark's windows of `width` words (a shorter item is one
window) are hashed in all three forms; documents are scanned whole for windows with those hashes, and the hits are hash-joined
back to the items. Per document and item, the item's windows whose words all lie in matched windows are counted, within a band
of `band` neighbouring offsets between the two texts: an inserted word costs none, a lost one the windows over it. The slots are checked: under that alignment
an item's value must always stand for the same value in the document. So a question with other numbers or names is caught as
re-parameterised, while chance matches of placeholders are not. An item is found if the share of its positions matched is
enough, of all its positions or of those where a template window counts.

Template windows with more than half placeholders, and those of items under `least` words, are not evidence; literal windows
always are, so an item of any length and wording is found where it is copied word for word, even one of a single word.

The benchmark's window hashes go to the executors in blocks of at most `block` (8 bytes each); a larger benchmark takes
several passes over the documents. The items' words stay where they are: only documents' hits are joined with them.
Null and empty texts match nothing; an empty table of either side gives an empty result; a very long text is scanned whole, in
time of its length; rows that share a doc_id are judged by themselves and give one verdict an item, the one of most matches (of equal
coverage, more matches, more slots, then fewer changes); repeated items and rows change nothing. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.llm.text_batches import map_texts
from vane.plans.shared import stored

WIDTH, LEAST, BLOCK, BAND = 8, 5, 1_000_000, 8
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
#: Unit words that a question may exchange.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hour hours day days week weeks month months year years usd eur gbp dollars euros pounds percent degrees miles meters metres kilometers kilograms grams litres liters".split())
EDGE = ".,;:!?\"'()[]{}«»“”‘’…-*#"
STOPS = (".", "!", "?", ":", "…")


def hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


NUM, NAME, UNIT = (hashed(w) for w in ("<num>", "<name>", "<unit>"))


NUMBER_BIT, UNIT_BIT, NAME_BIT, STOP_BIT, EMPTY_BIT = 1, 2, 4, 8, 16


class Words(dict):
    """Raw word to its place in the tables of bare words, hashes of their lower-case forms, and flags."""

    def __init__(self) -> None:
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.bare: list[str] = []
        self.new: list[tuple[int, int]] = []
        self.hash, self.flags = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and flags by place."""
        if self.new:
            hashes, flags = zip(*self.new)
            self.hash, self.flags, self.new = np.r_[self.hash, np.array(hashes, np.uint64)], np.r_[self.flags, np.array(flags, np.uint8)], []
        return self.hash, self.flags

    def __missing__(self, raw: str) -> int:
        bare = raw.strip(EDGE)
        low = bare.lower()
        flags = (low in UNITS) * UNIT_BIT | raw.endswith(STOPS) * STOP_BIT
        if not bare:
            flags |= EMPTY_BIT
        elif bare != low and bare[0].isupper() and bare[1:].islower():
            flags |= NAME_BIT
        elif not bare[0].isalpha() and NUMBER.fullmatch(bare):
            flags |= NUMBER_BIT
        at = len(self.bare)
        self.bare.append(bare)
        self.new.append((hashed(low), flags))
        if len(raw) < 48:
            self[raw] = at
        return at


class Forms:
    """The words of several texts: hashes as literal words and as template words, slots, and the names that begin a sentence."""

    def __init__(self, texts: list[str | None], known: Words):
        if len(known.bare) > 100_000:
            known.reset()
        places, lines, words = [], [], [0]
        for text in texts:
            for line in (text or "").split("\n"):
                places += [known[raw] for raw in line.split()]
                lines.append(len(places))
            words.append(len(places))
        at = np.array(places, np.int64)
        hashes, all_flags = known.tables()
        flags = all_flags[at]
        line = np.searchsorted(np.array(lines), np.arange(len(at)), "right")
        text = np.searchsorted(np.array(words[1:]), np.arange(len(at)), "right")
        stops = np.r_[0, np.cumsum(flags & STOP_BIT > 0)]
        idx = np.flatnonzero(flags & EMPTY_BIT == 0)  # signs alone are no words, but may end a sentence
        before = np.r_[-1, idx][: len(idx)]
        own = flags[idx]
        start = (before < 0) | (line[idx] != line[before]) | (stops[idx] > stops[np.maximum(before, 0)])  # a capital letter begins a sentence or a line, so it may mark no name
        number = own & NUMBER_BIT > 0
        after_number = (before >= 0) & (text[idx] == text[before]) & np.r_[False, number][: len(idx)]
        unit = ~number & after_number & (own & UNIT_BIT > 0)
        name = ~number & ~unit & (own & NAME_BIT > 0)
        self.at, self.known = at[idx], known
        self.ends = np.r_[0, np.cumsum(np.bincount(text[idx], minlength=len(texts)))] if len(texts) else np.zeros(1, np.int64)
        self.literal = hashes[self.at]
        inner = name & ~start
        self.filled, self.all_filled, self.unit = number | unit | inner, number | unit | name, unit
        self.template = np.where(number, np.uint64(NUM), np.where(unit, np.uint64(UNIT), np.where(inner, np.uint64(NAME), self.literal)))
        self.named = np.where(name, np.uint64(NAME), self.template)

    def slots_of(self, form: int, at: int, width: int) -> str:
        """The words in placeholders of a window ('' elsewhere), joined; nothing for literal windows."""
        if form == 0:
            return ""
        held = self.filled if form == 1 else self.all_filled
        word = lambda k: self.known.bare[self.at[k]].lower() if self.unit[k] else self.known.bare[self.at[k]]
        return SEP.join(word(k) if held[k] else "" for k in range(at, at + width))


#: Stands in no word: str.split() cuts there.
SEP = "\x1f"


def window_hashes(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    n = max(0, len(hashes) - width + 1)
    out = np.full(n, (seed + width) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def worded(filled: np.ndarray, width: int) -> np.ndarray:
    """Whether at least half of each window's words are words."""
    held = np.r_[0, np.cumsum(filled)]
    return (held[width:] - held[:-width]) * 2 <= width if len(filled) >= width else np.empty(0, bool)


def windows(forms: Forms, width: int):
    """(form, hashes, good) of all windows: literal words, names inside sentences, names at their beginnings too where that differs."""
    if len(forms.literal) < width:
        return
    text = np.searchsorted(forms.ends, np.arange(len(forms.literal)), "right")
    inside = text[: len(text) - width + 1] == text[width - 1 :]  # no window reaches into the next text
    yield 0, window_hashes(forms.literal, width, 1 << 20), inside
    one, two = (window_hashes(h, width, 0) for h in (forms.template, forms.named))
    yield 1, one, inside & worded(forms.filled, width)
    yield 2, two, inside & worded(forms.all_filled, width) & (two != one)


def item_windows(batch: pa.RecordBatch, width: int, least: int) -> pa.RecordBatch:
    """item_id, width, at, hash, slots, n_all and n_template (positions with any window, with a template window), counts (for each position that the window covers: has it a template window)."""
    rows, out = [], []
    known = Words()
    for row, text in enumerate(batch.column("text").to_pylist()):
        forms = Forms([text], known)
        n = len(forms.literal)
        own = min(n, width)
        if not own:
            continue
        mine = [(form, h, good & (form == 0 or n >= least)) for form, h, good in windows(forms, own)]
        usable = mine[1][2]
        marks = "".join("01"[u] for u in usable.tolist())
        for form, h, good in mine:
            for at in np.flatnonzero(good).tolist():
                rows.append(row)
                out.append((own, at, int(h[at].view(np.int64)), forms.slots_of(form, at, own), n - own + 1, int(usable.sum()), marks[at : at + own]))
    ids = batch.column("item_id").take(pa.array(rows, pa.int64()))
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["item_id", "width", "at", "hash", "slots", "n_all", "n_template", "counts"])


def document_windows(batch: pa.RecordBatch, widths: list[int], wanted: np.ndarray, marks: np.ndarray, known: Words) -> pa.RecordBatch:
    """doc_id, text_id, doc_at, hash, doc_slots of each window with a wanted hash."""
    texts = batch.column("text").to_pylist()
    forms = Forms(texts, known)
    rows, at_, hash_, slot_ = [], [], [], []
    for width in widths:
        for form, h, good in windows(forms, width):
            k = np.flatnonzero(good & marks[h & np.uint64(len(marks) - 1)])
            k = k[wanted[np.minimum(np.searchsorted(wanted, h[k]), len(wanted) - 1)] == h[k]]
            row = np.searchsorted(forms.ends, k, "right") - 1
            rows += row.tolist()
            at_ += (k - forms.ends[row]).tolist()
            hash_.append(h[k])
            slot_ += [forms.slots_of(form, at, width) for at in k.tolist()]
    ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
    text_id = {r: xxhash.xxh3_64_intdigest(texts[r].encode("utf-8", "surrogatepass")) for r in set(rows)}
    hashes = np.concatenate([np.empty(0, np.uint64), *hash_]).view(np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.array([text_id[r] for r in rows], np.uint64).view(np.int64)), pa.array(at_, pa.int32()), pa.array(hashes), pa.array(slot_, pa.string())], ["doc_id", "text_id", "doc_at", "hash", "doc_slots"])


def slot_values(matches: list[dict]) -> tuple[int, int] | None:
    """(slots, changed slots), or None if one item value stands for two document values."""
    value: dict[str, str] = {}
    for m in matches:
        for was, now in zip(m["slots"].split(SEP), m["doc_slots"].split(SEP)):
            if was and value.setdefault(was, now) != now:
                return None
    return len(value), sum(a != b for a, b in value.items())


def covered(seen: dict[int, str], width: int) -> tuple[int, int]:
    """How many windows, and template windows, of the item have all their words in matched windows (position to counts)."""
    held = {k for at in seen for k in range(at, at + width)}
    counts = {at + k: c for at, marks in seen.items() for k, c in enumerate(marks)}
    whole = [at for at in counts if held.issuperset(range(at, at + width))]
    return len(whole), sum(counts[at] == "1" for at in whole)


def aligned(matches: list[dict], n_all: int, n_template: int, width: int, share: float, band: int) -> tuple[int, int, int, int] | None:
    """(n_matched, n_windows, n_slots, n_changed) of the best band of offsets that has enough matches and consistent slots.

    Within a band, a position's match is the one nearest to the band's first offset.
    """
    by_shift: dict[int, list[dict]] = {}
    for m in matches:
        by_shift.setdefault(m["doc_at"] - m["at"], []).append(m)
    ranked = []
    for first in by_shift:
        seen: dict[int, str] = {}
        for shift in range(first, first + band + 1):
            seen.update((m["at"], m["counts"]) for m in by_shift.get(shift, ()))
        ways = [(n, of) for n, of in zip(covered(seen, width), (n_all, n_template)) if of and n >= max(1, math.ceil(of * share))]
        if ways:
            ranked.append((*max(ways, key=lambda w: (w[0] / w[1], w[0])), first))
    for n, of, first in sorted(ranked, key=lambda r: (-r[0] / r[1], -r[0], r[2])):
        placed: dict[int, int] = {}
        used = []
        for shift in range(first, first + band + 1):
            used += [m for m in by_shift.get(shift, ()) if placed.setdefault(m["at"], shift) == shift]
        if (found := slot_values(used)) is not None:
            return n, of, *found
    return None


def find_contamination(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, width: int = WIDTH, least: int = LEAST, block: int = BLOCK, band: int = BAND) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, n_slots, n_changed, kind (exact or re-parameterised) of every hit."""
    item_kind, doc_kind = (t.schema[c].dataType.simpleString() for t, c in ((benchmark, "item_id"), (docs, "doc_id")))
    items = map_texts(benchmark.select("item_id", "text"), "text", lambda b: item_windows(b, width, least), f"item_id {item_kind}, width int, at int, hash bigint, slots string, n_all int, n_template int, counts string")
    items = stored(items, "benchmark-windows")
    n = items.count()
    blocks = max(1, -(-n // block))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    found = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod("hash", F.lit(blocks)) == b)
        hashes = np.sort(own.select("hash").distinct().toArrow()["hash"].to_numpy().view(np.uint64))
        wanted = docs.sparkSession.sparkContext.broadcast(hashes)

        def scan(batch: pa.RecordBatch, wanted=wanted) -> pa.RecordBatch:
            if not len(wanted.value):
                return None
            if "known" not in scan.__dict__:
                scan.known, scan.marks = Words(), np.zeros(1 << 22, bool)
                scan.marks[wanted.value & np.uint64(len(scan.marks) - 1)] = True
            return document_windows(batch, widths, wanted.value, scan.marks, scan.known)

        hits = map_texts(docs.select("doc_id", "text"), "text", scan, f"doc_id {doc_kind}, text_id bigint, doc_at int, hash bigint, doc_slots string")
        found = hits if found is None else found.union(hits)
    hits = stored(found.distinct(), "window-hits")
    both = hits.join(items, "hash")
    pair = ["doc_id", "text_id", "item_id", "n_all", "n_template", "width"]
    groups = both.groupBy(*pair).agg(F.collect_list(F.struct("at", "counts", "doc_at", "slots", "doc_slots")).alias("matches"))
    # a matched window covers `width` positions at most
    most = F.size(F.array_distinct("matches.at")) * F.col("width")
    enough = lambda of: (F.col(of) > 0) & (most >= F.ceil(F.col(of) * share))
    groups = groups.where(enough("n_all") | enough("n_template"))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in ("matches", "n_all", "n_template", "width")]
        got = [aligned(*row, share, band) for row in zip(*columns)]
        rows = pa.array([i for i, g in enumerate(got) if g], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("item_id").take(rows), *(pa.array([g[i] for g in got if g], pa.int64()) for i in range(4))], ["doc_id", "item_id", "n_matched", "n_windows", "n_slots", "n_changed"])

    out = groups.mapInArrow(lambda batches: map(judge, batches), f"doc_id {doc_kind}, item_id {item_kind}, n_matched bigint, n_windows bigint, n_slots bigint, n_changed bigint")
    coverage = F.round(F.col("n_matched") / F.col("n_windows"), 4).alias("coverage")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct(coverage, "n_matched", "n_windows", "n_slots", (-F.col("n_changed")).alias("kept"))).alias("best"))
    best = best.select("doc_id", "item_id", "best.n_matched", "best.n_windows", "best.coverage", "best.n_slots", (-F.col("best.kept")).alias("n_changed"))
    return best.withColumn("kind", F.when(F.col("n_changed") > 0, "re-parameterised").otherwise("exact"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return find_contamination(read("documents"), read("benchmark"))
