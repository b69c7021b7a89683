"""Arrow helpers of the operators that read whole texts in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about max_chars bytes of text at most (a longer text comes alone)."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > max_chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(df: DataFrame, column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """work on every slice of df's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            out = work(batch)
            if out is not None and out.num_rows:
                yield out
        pa.default_memory_pool().release_unused()  # the worker process goes on to other stages

    return df.mapInArrow(run, schema)


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores behind it as it takes to be none of the columns (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_terms(digits: bool) -> bytes:
    """A table for bytes.translate: A-Z to a-z, other ASCII characters but letters (and digits) to blanks; bytes of non-ASCII characters stay."""
    kept = b"abcdefghijklmnopqrstuvwxyz" + b"0123456789" * digits
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in kept else 32 for b in range(256))
