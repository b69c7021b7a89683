"""WARC archives of pages, and their capture index in global order.

Of the pages with equal payloads of at least `min_bytes` bytes the smallest page_id is the response and the others revisit it;
shorter payloads are all responses. Tasks write WARC/1.1 archives into the shared folder, one gzip member a record, so a
record can be read from its offset alone; a new archive begins after `max_bytes` (compressed) or `max_records`. An archive counts only if the
table of archives, which Spark commits, names it: what a lost or repeated task leaves behind is never read.

Reading inflates the archives member by member, checks payload digests, and sorts each archive's captures by URL key and time:
a local run. Captures are then dealt by range of (URL key, time, page_id) and every range merges its runs with a loser tree, so
that the ranges one after the other are the capture histories in global order. A task holds one record and one archive's captures.

A null html is an empty payload; a null url gives an empty target. Rows with equal page_id and payload are all responses.
A null page_id never becomes the response of others unless all are null. A very long payload is one record. Captures of equal
key, time and page_id stand in the order of archive and offset. An empty table writes and reads nothing. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vane.plans.shared import new_path, stored

EOL = "\r\n"
HTTP = f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}{EOL}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(sha1_hex: Column) -> Column:
    """Base32 of a 160-bit hexadecimal digest: four groups of 40 bits, eight digits each."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, sha1, refers_to (null for a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    full = pages.select("page_id", "url", payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("sha1"))
    equal = full.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies"))
    equal = stored(equal.where("copies > 1").select(F.col("sha1").alias("_sha1"), "first_page"), "equal-payloads")
    joined = full.join(equal, F.col("sha1") == F.col("_sha1"), "left")
    is_copy = F.col("_sha1").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.select("page_id", "url", "payload", "sha1", F.when(is_copy, F.col("first_page")).alias("refers_to"))


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI in the shared folder, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


ARCHIVE = "archive string, n_records bigint, n_bytes bigint"


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, max_records: int = 50_000, max_bytes: int = 64 << 20, start: str = "2024-01-01T00:00:00Z", spacing: int = 1) -> DataFrame:
    """A record a page under path, and the table of archives. Captures are dated start plus page_id times spacing seconds."""
    rows = with_roles(pages, min_bytes)
    date = F.date_format(F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(start))) + F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000 * spacing), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    target = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("X-Payload-Length", F.octet_length("payload")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = opened(path)
        files.create_dir(folder, recursive=True)
        done, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for head, payload in zip(batch.column("head"), batch.column("payload")):
                if out is not None and (n >= max_records or size >= max_bytes):
                    out.close()
                    done.append((name, n, size))
                    out = None
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                block = HTTP.encode() + (payload.as_py() or "").encode()
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(f"{head.as_py()}Content-Length: {len(block)}{EOL}{EOL}".encode()) + pack.compress(block) + pack.compress(EOL.encode() * 2) + pack.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            done.append((name, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], ["archive", "n_records", "n_bytes"])

    records = rows.select(head.alias("head"), F.when(~revisit, F.col("payload")).alias("payload"))
    return stored(records.mapInArrow(write, ARCHIVE), "archives")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, offset of the gzip member) of each record. The content may hold anything; one record is held at a time."""
    at, size, member, inflate = 0, 0, bytearray(), zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            member += inflate.decompress(chunk)
            size += len(chunk) - len(inflate.unused_data)
            chunk = inflate.unused_data
            if inflate.eof:
                end = member.index(b"\r\n\r\n")
                head = member[:end].decode().split(EOL)
                headers = dict(h.split(": ", 1) for h in head[1:])
                block = bytes(member[end + 4 : -4])
                if not head[0].startswith("WARC/") or int(headers["Content-Length"]) != len(block):
                    raise ValueError(f"no record at byte {at}")
                yield headers, block, at
                at, size, member, inflate = at + size, 0, bytearray(), zlib.decompressobj(31)
    if member or size:
        raise ValueError(f"the record at byte {at} is cut off")


def url_key(url: str) -> str:
    """Host labels in reverse order, then the path: captures of one site stand together."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?(.*)", url, re.DOTALL)
    if not m:
        return url
    return ",".join(reversed(m[1].lower().removeprefix("www.").split("."))) + ")" + (m[2].split("#")[0].lower() or "/")


CAPTURE = "url_key string, captured string, page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, archive string, offset bigint"


def read_archives(archives: DataFrame, path: str, chunk: int = 1 << 20) -> DataFrame:
    """Captures of the archives under path that the table of archives names, each archive's in the order of the index."""

    def number(urn: str | None) -> int | None:
        digits = (urn or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CAPTURE.split(", ")]
        kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in CAPTURE.split(", ")]
        files, folder = opened(path)
        for archive in (a for batch in batches for a in batch.column("archive").to_pylist()):
            run = []
            with files.open_input_stream(f"{folder}/{archive}", compression=None) as stream:
                for h, block, offset in records(iter(lambda: stream.read(chunk), b"")):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        payload = block.split(b"\r\n\r\n", 1)[1]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != length:
                            raise ValueError(f"{archive}: the record at byte {offset} is damaged")
                    run.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], number(h["WARC-Record-ID"]), h["WARC-Type"], number(h.get("WARC-Refers-To")), digest, length, archive, offset))
            run.sort(key=order_of)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*run), kinds)], names)

    return archives.select("archive").repartition("archive").mapInArrow(parse, CAPTURE)


def read_record(path: str, archive: str, offset: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, read from its offset on."""
    files, folder = opened(path)
    with files.open_input_file(f"{folder}/{archive}") as f:
        f.seek(offset)
        headers, block, _ = next(records(iter(lambda: f.read(1 << 16), b"")))
    return headers, block


def order_of(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """k-way merge: every inner node holds the loser of its match, so the next winner costs one path to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _head(self, i: int) -> tuple | None:
        return order_of(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._head(i), self._head(j)
        return b is None or (a is not None and (a, i) <= (b, j))

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            rival = self.losers[node]
            if rival < 0:  # the first to come waits for its rival
                self.losers[node] = winner
                return
            if not self._beats(winner, rival):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self._head(w := self.losers[0])) is not None:
            del head
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node, winner = (w + self.k) // 2, w
            while node > 0:
                rival = self.losers[node]
                if not self._beats(winner, rival):
                    self.losers[node], winner = winner, rival
                node //= 2
            self.losers[0] = winner


def merged_captures(captures: DataFrame, per_range: int = 50_000) -> DataFrame:
    """captures in global order: by merge_range, then merge_at. Each range merges the ascending runs it receives."""
    captures = stored(captures, "captures")
    n = captures.count()
    dealt = captures.repartitionByRange(max(1, -(-n // per_range)), "url_key", "captured", "page_id", "archive", "offset")
    dealt = dealt.select("*", F.spark_partition_id().alias("merge_range"))
    names = [c.split()[0] for c in CAPTURE.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple]] = []
        here = 0
        for batch in batches:
            here = batch.column("merge_range")[0].as_py() if batch.num_rows else here
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if runs and order_of(runs[-1][-1]) <= order_of(row):
                    runs[-1].append(row)
                else:
                    runs.append([row])
        out: list[tuple] = []
        at = 0
        for row in LoserTree(runs):
            out.append((*row, here, at))
            at += 1
            if len(out) == 10_000:
                yield rows_of(out)
                out = []
        if out:
            yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in CAPTURE.split(", ")] + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [*names, "merge_range", "merge_at"])

    return dealt.mapInArrow(merge, f"{CAPTURE}, merge_range int, merge_at bigint")


OP7_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT page_id, strlen(payload) AS payload_bytes, digest, min(page_id) OVER (PARTITION BY digest) AS first_page FROM p)
SELECT page_id, payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(digest, 5 * (i // 4) + 1, 5))::BIGINT >> (5 * (3 - i % 4))::INTEGER) & 31))::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest,
 CASE WHEN page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM r"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    captures = merged_captures(read_archives(archives, path))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
