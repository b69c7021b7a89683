"""Best-fit packing with certified bin counts.

Documents become token pieces of at most `size` tokens (a final end id included); pieces of exactly `size` fill a sequence
alone. The others are dealt by hash to partitions of about `pool` pieces, and each is packed by best-fit decreasing. Dual
feasible functions give a lower bound on the partition's bins: a partition whose count equals it is certified. From the rest
the bins with room go into common pools, so that partitions exchange documents, and are packed again; a pool keeps its old
bins if the new packing needs as many. This is done `exchanges` times.

A null text is empty: one piece, the end id alone. Rows are packed one by one, also repeated ones or those with a null doc_id.
Of pieces of equal length the smaller doc_id, then piece, comes first. A very long text is tokenised in slices cut at
lone spaces. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.llm.text_batches import map_texts
from vane.plans.shared import stored

SIZE = 2048
LONE = re.compile(r"(?<!\s) (?!\s)")
BLANKS = 100_000
BLANK = re.compile(r"(?<!\s)\s{%d}" % BLANKS)


def slices(text: str, chars: int = 1_000_000) -> Iterator[str]:
    """The text cut before the first lone space after every chars characters (nowhere, if there is none).

    The vocabulary's pattern never lets a token cross from one side of a lone space to the other, so the ids of a text are
    those of its slices.
    """
    at = 0
    while cut := LONE.search(text, at + chars):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Tokens:
    """Ids of the public byte-level vocabulary, equal to those of the tokenizers library without special tokens added."""

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("vane", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = fast.encode_ordinary

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        if any(s in text for s in self.special) or (len(text) >= BLANKS and BLANK.search(text)):  # tiktoken's stack overflows in long runs of blanks
            return pack(self.slow.encode(text, add_special_tokens=False).ids)
        return b"".join([pack(self.encode(part)) for part in slices(text)])


def token_pieces(docs: DataFrame, size: int, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. A document longer than size is cut so that only its first piece is shorter."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = work.__dict__.get("tokens") or work.__dict__.setdefault("tokens", Tokens(name))
        at, piece, start, length, crc = [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            ids = tokens.ids(text or "") + b"\0\0\0\0"
            n = len(ids) // 4
            end = (n - 1) % size + 1
            begin = k = 0
            while begin < n:
                at.append(row)
                piece.append(k)
                start.append(begin)
                length.append(end - begin)
                crc.append(zlib.crc32(ids[4 * begin : 4 * end]))
                begin, end, k = end, end + size, k + 1
        doc = batch.column("doc_id").take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each piece: longest first, each into the fullest bin that takes it."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin with room r exists
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        want = int(lengths[i])
        fits = rooms >> want
        if fits:
            room = want + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = size, n, n + 1
        bins[i] = b
        by_room[room - want].append(b)
        rooms |= 1 << (room - want)
    return bins


def bins_needed(lengths: np.ndarray, size: int) -> int:
    """A lower bound on the bins of any packing, by dual feasible functions on the counts of each length."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    best = -(-int((counts * x).sum()) // size)
    for k in range(1, 21):  # u(k): rounding to k-ths
        whole = (k + 1) * x % size == 0
        value = np.where(whole, x * k, (k + 1) * x // size * size)  # in 1 / (k * size)
        best = max(best, -(-int((counts * value).sum()) // (k * size)))
    for e in range(1, size // 2 + 1, max(1, size // 256)):  # pieces over size - e count as a bin, those under e as nothing
        value = np.where(x > size - e, size, np.where(x < e, 0, x))
        best = max(best, -(-int((counts * value).sum()) // size))
    return best


PACKED = "piece int, start bigint, length bigint, ids_crc32 bigint, pool bigint, bin bigint, offset bigint, loose boolean"


def packed(pieces: DataFrame, size: int) -> DataFrame:
    """pieces (with pool, and bin of an earlier packing or -1) after best-fit decreasing in each pool."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        lengths = pdf.length.to_numpy()
        bins = best_fit_decreasing(lengths, size)
        old = pd.factorize(pdf.pool_bin)[0]
        if (pdf.pool_bin >= 0).all() and old.max() <= bins.max():
            bins = old
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        loose = (bins.max() + 1 > bins_needed(lengths, size)) & (fill < size)
        order = np.argsort(bins, kind="stable")
        within = np.cumsum(lengths[order]) - lengths[order]
        offset = np.empty(len(bins), np.int64)
        offset[order] = within - (np.cumsum(fill) - fill)[bins[order]]
        return pdf.assign(bin=bins, offset=offset, loose=loose[bins])[["doc_id", "piece", "start", "length", "ids_crc32", "pool", "bin", "offset", "loose"]]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("pool").applyInPandas(pack, f"doc_id {kind}, {PACKED}")


def dealt(pieces: DataFrame, n: int, pool: int, *by: str) -> DataFrame:
    return pieces.withColumn("pool", F.pmod(F.xxhash64(*by), F.lit(max(1, -(-n // pool)))))


def pack_documents(docs: DataFrame, size: int = SIZE, pool: int = 20_000, exchanges: int = 2, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(token_pieces(docs, size, vocabulary), "pieces")
    full = pieces.where(F.col("length") == size)
    part = pieces.where(F.col("length") < size)
    first = dealt(part, part.count(), pool, "doc_id", "piece", "start").withColumn("pool_bin", F.lit(-1).cast("long"))
    state = stored(packed(first, size), "packed-0")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = []
    for k in range(1, exchanges + 1):
        loose = state.where("loose")
        n = loose.count()
        if not n:
            break
        done.append((k - 1, state.where("NOT loose")))
        again = loose.select(*columns, F.xxhash64("pool", "bin").bitwiseAND(F.lit(2**62 - 1)).alias("pool_bin"))  # pieces of one bin stay together
        state = stored(packed(dealt(again, n, pool, "pool_bin"), size), f"packed-{k}")
    last = done[-1][0] + 1 if done else 0
    done.append((last, state))
    sequence = lambda k: (F.lit(k + 1) * F.lit(2**58) + F.col("pool") * F.lit(2**20) + F.col("bin"))  # noqa: E731  a pool has fewer than 2^20 bins
    out = full.select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for k, rows in done:
        out = out.union(rows.select(*columns, sequence(k).alias("sequence_id"), "offset"))
    return out


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
